import hashlib
import random

import pytest

from gridledger.llm import exact_dedup, near_dedup


def rows_of(frame, *names):
    return sorted(((tuple(r[n] for n in names)) for r in frame.collect()), key=str)


EDGES = [(1, "a b"), (2, "a b"), (2, "a b"), (5, "A b"), (None, "a b"), (7, None), (8, ""), (None, "lone"), (None, "lone"), (3, "a b ")]


def test_exact_marks(docs):
    got = exact_dedup.mark_copies(docs(EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    same = by[hashlib.sha256(b"a b").hexdigest()]
    assert {r.keep_id for r in same} == {2} and {r.group_size for r in same} == {4}
    assert sum(r.kept for r in same) == 1 and next(r for r in same if r.kept).doc_id == 2
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {8} and sorted((r.doc_id, r.kept) for r in empty) == [(7, False), (8, True)]
    lone = by[hashlib.sha256(b"lone").hexdigest()]
    assert {r.keep_id for r in lone} == {None} and sorted(r.kept for r in lone) == [False, True]


def test_exact_keeps_smallest_and_columns(docs):
    frame = docs(EDGES)
    kept = exact_dedup.drop_copies(frame, keep="min")
    assert kept.columns == frame.columns
    assert rows_of(kept, "doc_id", "text") == sorted([(None, "a b"), (5, "A b"), (7, None), (None, "lone"), (3, "a b ")], key=str)
    assert rows_of(exact_dedup.drop_copies(frame), "doc_id") == sorted([(2,), (5,), (8,), (None,), (3,)], key=str)


def test_exact_levels_and_collisions(spark, docs):
    frame = docs([(i, f"t{i % 7}") for i in range(200)]).repartition(9)
    for radix, levels in ((2, 5), (16, 3), (16, 1)):
        runs = exact_dedup.digests(frame).selectExpr("*", "monotonically_increasing_id() AS row")
        found = exact_dedup.groups(runs, radix=radix, levels=levels).collect()
        assert sorted(r.stay.id for r in found) == list(range(193, 200))
        assert sum(r.group_size for r in found) == 200
    clash = spark.sql("SELECT id, unhex('aa') AS digest, id + 1 AS n_bytes, id AS second, id AS row FROM range(2)")
    with pytest.raises(Exception, match="one digest"):
        exact_dedup.groups(clash).collect()


def test_exact_empty(docs):
    assert exact_dedup.mark_copies(docs([])).count() == 0 and exact_dedup.drop_copies(docs([])).count() == 0


def brute(texts):
    """Components by exact similarity of word shingles, all pairs."""
    sets = {}
    for i, text in texts:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                up[high] = low
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def corpus(seed=3):
    """Chains of ever more changed copies, large groups, shared passages, short and odd texts."""
    rng, out = random.Random(seed), []
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    for _ in range(12):
        text = [word() for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 25)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = word()
    for _ in range(40):
        out.append(" ".join([*[word() for _ in range(rng.randrange(5, 40))], *passage]))
    out += ["", None, "one", "ONE", "one two", "a b c d e", "A  b\tc\nd e", "a b c d f", "É b c d e", "é b c d e", "x " * 3000, "x " * 900]
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_copies_are_exactly_the_components(docs):
    texts = corpus()
    got = near_dedup.link(docs(texts))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(texts), key=str)


def test_near_copies_in_small_blocks(docs, monkeypatch):
    texts = corpus(5)
    for name in ("candidates", "confirmed"):
        whole = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda *a, f=whole, **k: f(*a, **(k | {"block": 4})))
    got = near_dedup.link(docs(texts))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(texts), key=str)


def test_near_copies_do_not_need_64_bit_hashes_to_differ(docs, monkeypatch):
    """Classes go by their 128-bit digest: the job stands when every 64-bit hash of one is the same."""
    real = near_dedup.F.xxhash64
    monkeypatch.setattr(near_dedup.F, "xxhash64", lambda *c: near_dedup.F.lit(1).cast("long") if "digest" in c else real(*c))
    texts = corpus(7)
    got = near_dedup.link(docs(texts))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(texts), key=str)


def test_near_null_and_repeated_ids(docs):
    text = "a b c d e f g h"
    got = near_dedup.link(docs([(4, text), (4, text), (None, text), (2, text.upper()), (9, None)]))
    assert rows_of(got, "doc_id", "component_id", "kept") == sorted(
        [(4, 2, False), (4, 2, False), (None, None, True), (2, 2, True), (9, 9, True)], key=str
    )
    assert near_dedup.link(docs([])).count() == 0
    kept = near_dedup.drop_near_copies(docs([(4, text), (2, text), (None, text)]))
    assert rows_of(kept, "doc_id") == [(2,), (None,)] and "_row" in kept.columns


def test_near_copies_with_different_texts_under_one_id(docs):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    texts = [(1, one), (4, one + " end"), (4, other), (4, other), (6, other + " end"), (6, "c d"), (1, one + " more")]
    got = near_dedup.link(docs(texts))
    # Of the smallest id's two near texts, 1 and 1, one stays.
    assert rows_of(got.filter("doc_id > 1"), "doc_id", "component_id", "kept") == sorted(
        [(4, 1, False), (4, 4, True), (4, 4, True), (6, 4, False), (6, 6, True)], key=str
    )
    assert sorted(r.kept for r in got.filter("doc_id = 1").collect()) == [False, True]
    kept = rows_of(near_dedup.drop_near_copies(docs(texts)), "doc_id", "text")
    assert len([x for x in kept if x[0] == 1]) == 1 and [x for x in kept if x[0] > 1] == [(4, other), (4, other), (6, "c d")]


def test_repeated_ids_do_not_multiply_band_rows(docs, monkeypatch):
    seen, whole = [], near_dedup.candidates
    monkeypatch.setattr(near_dedup, "candidates", lambda b, **k: seen.append(b.groupBy("band").count().agg({"count": "max"}).first()[0]) or whole(b, **k))
    text = [f"w{i}" for i in range(80)]
    near_dedup.link(docs([(3, " ".join([*text, f"end{k}"])) for k in range(12)]))
    assert seen == [12]


def test_components_of_hubs_chains_and_trees(spark):
    rng = random.Random(11)
    edges = [(k, 1000) for k in range(1001, 1300)] + [(k, k + 1) for k in range(1, 200)] + [(1299, 2000), (2000, 2001), (5, 5)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert rows_of(got, "node", "component") == sorted(((x, find(x)) for x in linked), key=str)

import gzip
import hashlib
import random
from collections import Counter

import pytest

from gridledger.llm import language_id, quality, secrets, warc
from gridledger.session import scratch_path


def brute_spans(text):
    import re

    either = "".join
    keys = ["password", "passwd", "secret", "token", "api_?key"]
    both = either("|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", k) for k in keys))
    assign = re.compile(rf"""({both})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def secret_texts():
    rng = random.Random(6)
    parts = ["password", "Token", "API_key", "apikey", "ſecret", "tokeK", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGHIJKLMNOPQ", "AKIA" * 5,
             "0123456789abcdef", "deadbeef", "é", "𝛼", "abcdefghijkl", "/+_.=-", "\n", "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(400)]


def test_spans(docs, spark):
    rows = [*enumerate(secret_texts()), (None, "token=abcdefghijklmn"), (1000, None), (1001, "token=abcdefghijklmn"), (1001, "token=abcdefghijklmn")]
    got = secrets.scan_versions(docs(rows), scratch_path(spark, "ledger")).collect()
    assert sorted([(r.doc_id, r.spans) for r in got], key=str) == sorted([(i, brute_spans(x or "")) for i, x in rows], key=str)
    assert all(r.n_hex == r.spans.count("hex:") and r.n_assign == r.spans.count("assign:") for r in got)
    assert secrets.scan_versions(docs([]), scratch_path(spark, "ledger")).count() == 0


def test_ledger_scans_only_what_is_new(docs, spark):
    ledger = scratch_path(spark, "ledger")
    size = lambda: spark.read.parquet(ledger).count()
    secrets.scan_versions(docs([(1, "a"), (2, "b"), (3, "a")]), ledger).count()
    assert size() == 2
    second = secrets.scan_versions(docs([(1, "a"), (2, "token=abcdefghijklmn")]), ledger)
    assert {r.doc_id: r.n_assign for r in second.collect()} == {1: 0, 2: 1} and size() == 3
    # A blob that is in the ledger is taken from there, whatever it says.
    blob = "unhex(sha2('z', 256)) AS blob, 7L AS n_assign, 0L AS n_access, 0L AS n_hex, 's' AS spans, 'base-1' AS rules"
    spark.sql(f"SELECT {blob}").write.mode("append").partitionBy("rules").parquet(ledger)
    assert secrets.scan_versions(docs([(9, "z")]), ledger).first().n_assign == 7
    assert secrets.scan_versions(docs([(9, "z")]), ledger, rules="base-2").first().n_assign == 0


PAGES = [
    (1, "http://a/", "x" * 1500), (4, "http://b/\r\nX: y", "x" * 1500), (None, None, "x" * 1500), (2, "u", "short"), (3, "u", "short"),
    (5, "u", None), (6, "u", ""), (7, "u", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "\r\n\r\n" * 400), (9, "u", "𝛼" * 1000), (4, "again", "x" * 1500),
    (None, "n", "y" * 2000), (None, "n", "y" * 2000), (10, "u", "z" * 999), (11, "u", "z" * 999),
]


@pytest.mark.parametrize("segment", [64, 65_536])
def test_warc_round_trip(spark, segment):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS n", "'k' AS keeper", "'d' AS digest")
    path = scratch_path(spark, "warc")
    got = warc.round_trip(pages, path, segment=segment).collect()
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        again = len(data) >= 1000 and same and page != max(same)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    whole = {}
    for r in warc.read_chunks(spark, path).collect():
        whole.setdefault((r.record_id, r.page_id), []).append((r.chunk_no, bytes(r.data)))
    for page, html in ((7, PAGES[7][2]), (8, PAGES[8][2]), (9, PAGES[9][2])):
        chunks = next(v for k, v in whole.items() if k[1] == page)
        assert b"".join(d for _, d in sorted(chunks)) == html.encode()
        assert segment > 64 or len(chunks) > 10


def test_warc_payload_of_a_third_of_all_pages(spark, monkeypatch):
    """The join on payloads reads both sides straight from a shuffle (or a small side whole): no aggregate between."""
    rows = [(i, "u", "hot " * 400 if i % 3 == 0 else f"page {i} " * 150) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    seen, write = [], warc.stored
    monkeypatch.setattr(warc, "stored", lambda df, name: seen.append(name) or write(df, name))
    got = warc.round_trip(pages, scratch_path(spark, "warc")).collect()
    assert seen == ["payload-groups"] and len(got) == 300
    hot = {r.page_id: r for r in got if r.page_id % 3 == 0}
    assert hot[297].record_type == "response" and all(r.refers_to == 297 for i, r in hot.items() if i != 297)
    assert {r.record_type for r in got if r.page_id % 3} == {"response"}


def test_warc_payloads_with_one_sha1_are_told_apart(spark, monkeypatch):
    """With a hash that is the same for all payloads, length and second hash still tell them apart."""
    monkeypatch.setattr(warc.F, "sha1", lambda c: warc.F.rpad(warc.F.lit("0"), 40, "0"))
    rows = [(1, "u", "a" * 1200), (2, "u", "b" * 1200), (3, "u", "a" * 1300), (4, "u", "a" * 1200)]
    path = scratch_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    heads = [r.value for r in spark.read.option("lineSep", "WARC/1.1").text(path).collect()]
    assert sum("WARC-Type: revisit" in h for h in heads) == 1 and sum("X-Refers-To-Page: 4" in h for h in heads) == 1


def test_warc_empty_and_damaged(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, scratch_path(spark, "warc")).count() == 0
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nX-Page: 1\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 43\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    with pytest.raises(ValueError, match="damaged"):
        list(warc._records(gzip.compress(good.replace(b"43", str(len(body)).encode()) + body + b"\r\n\r\n")))
    with pytest.raises(ValueError, match="within a record"):
        list(warc._records(gzip.compress(good + body)))


def test_big_payload_comes_in_chunks():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 1000000\r\n\r\n" + b"x" * 1_000_000
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(b'x' * 1_000_000).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n"
    rows = list(warc._records(gzip.compress(head.encode() + body + b"\r\n\r\n")))
    assert max(len(r[-1]) for r in rows) <= 2 * warc.CHUNK and sum(len(r[-1]) for r in rows) == 1_000_000 and rows[-1][7]


def test_ppm_code_lengths_by_hand():
    import pandas as pd

    grams = pd.DataFrame({"lang": ["a"] * 3, "gram": [0x20202078, 0x20202079, 0x20207878], "n": [3, 1, 2]})
    model = language_id._model(["a"], grams, 100)
    from math import log2

    # Context '   ' saw x three times and y once: x codes by 3 / 6; z escapes 2 / 6, then over ever shorter contexts.
    assert language_id.code_lengths(model, "x")[0] == pytest.approx(-log2(3 / 6), abs=1e-5)
    order2 = -log2(2 / 6)  # '  ' saw x 3, y 1
    order1 = -log2(2 / 6)
    order0 = -log2(2 / 8) + 8  # x 5, y 1 in all
    assert language_id.code_lengths(model, "z")[0] == pytest.approx(-log2(2 / 6) + order2 + order1 + order0, abs=1e-4)


def test_language(docs, spark):
    rng = random.Random(8)
    vocabulary = {"en": "the and of with thing reading over".split(), "fr": "le que dans été français très où".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(40)), x, "s") for i in range(120) for x in [("en", "fr")[i % 2]]]
    frame = docs(rows)
    model = language_id.fit(frame)
    got = language_id.predict(frame, model).collect()
    held = [r for r in got if r.held_out]
    assert 20 < len(held) < 60 and all(0 <= r.score <= 1 for r in got)
    right = {i: x for i, _, x, _ in rows}
    assert sum(r.lang_pred == right[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = language_id.predict(docs([(1, None), (2, ""), (3, "12 !?"), (None, "THE AND OF"), (5, "你好")]), model).collect()
    by = {r.doc_id: r for r in odd}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[None].lang_pred == "en" and by[None].held_out is False
    assert by[5].lang_pred in ("en", "fr") and by[1].score == 0
    assert language_id.predict(docs([]), model).count() == 0
    assert language_id.fit(docs([(1, "x y", None, None)])) is None
    assert language_id.predict(docs([(1, "x y")]), None).first().lang_pred == "und"


def brute_quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(threes)
    again = {i + k for i, t in enumerate(threes) if times[t] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_quality_counts_and_verdicts(docs):
    rng = random.Random(9)
    odd = ["".join(rng.choice(["a ", "b ", "é", "\n", "𝛼 ", "#", " ", "\x0b", "a a a "]) for _ in range(60)) for _ in range(60)]
    plain = [" ".join(rng.choice("the of and to in is that it was for words more many text".split()) for _ in range(120)) + "." for _ in range(60)]
    shouted = " ".join(f"{w.upper()}###" for w in plain[0].split())
    rows = [(i, x, "en", "s") for i, x in enumerate([*odd, *plain, shouted])] + [(None, None), (900, ""), (900, "a b")]
    frame = docs(rows)
    refs = quality.references(frame.filter("text LIKE '% the %' AND text NOT LIKE '%#%'"))
    got = quality.judge(frame, refs).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted([(r.doc_id, *[r[f] for f in fields]) for r in got], key=str) == sorted([(r[0], *brute_quality(r[1])) for r in rows], key=str)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(60, 120) if not by[i].base_failed) and not by[120].kept
    assert quality.judge(docs([]), refs).count() == 0 and quality.references(docs([(1, "a", None, None)])) == {}
    assert all(r.kept != r.base_failed for r in quality.judge(frame, {}).collect())


def test_common_words_are_exact(docs, monkeypatch):
    monkeypatch.setattr(quality, "HELD", 50)
    rows = [(i, "the cat, The dog. w%d" % i, "en", "s") for i in range(90)]
    refs = quality.references(docs(rows).repartition(7), common=3)
    assert refs["en"]["words"] == {b"the": 180, b"cat": 90, b"dog": 90} and refs["en"]["n"] == 450


def test_references_do_not_depend_on_partitioning(docs):
    # Every document repeats two words of its own; one word is in few documents but 5 % of all.
    rows = [(i, " ".join(f"own{i}x{k // 2}" for k in range(120)), "en", "s") for i in range(60)]
    rows[7] = (7, rows[7][1] + " zebra" * 400, "en", "s")
    frame = docs(rows)
    one, many = (quality.references(frame.repartition(n)) for n in (1, 60))
    assert list(one["en"]["words"].items()) == list(many["en"]["words"].items()) and one["en"]["words"][b"zebra"] == 400
    assert len(one["en"]["words"]) == 50 and (one["en"]["classes"] == many["en"]["classes"]).all() and one["en"]["n"] == many["en"]["n"]


def brute_verdicts(rows):
    """Kept or not of each (id, text, lang), by plain counting over all rows."""
    import math
    import re

    def classes(text):
        names = ["lower", "upper", "digit", "space", "mark", "symbol", "other"]
        found = Counter()
        for c in text:
            kind = "other" if ord(c) > 127 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else (
                "space" if c in " \t\n\x0b\x0c\r" else "mark" if c in ".,;:!?'\"()-" else "symbol")
            found[kind] += 1
        return [found[n] for n in names]

    def plain(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return [w for w in re.split(r"[\x20\x09-\x0D.,;:!?\"()]+", low) if w]

    def far(p, q):
        total = 0
        for a, b in zip(p, q, strict=True):
            m = (a + b) / 2
            total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
        return math.sqrt(max(0, total / 2))

    refs = {}
    for lang in {r[2] for r in rows if r[2] is not None}:
        texts = [t for _, t, x in rows if x == lang and t is not None]
        words = Counter(w for t in texts for w in plain(t))
        most = sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))[:50]
        marks = [sum(c) for c in zip(*map(classes, texts), strict=True)]
        n = sum(words.values())
        shares = [k / n for _, k in most]
        refs[lang] = ([k / sum(marks) for k in marks], [w for w, _ in most], [*shares, max(0, 1 - sum(shares))])
    out = []
    for i, text, _ in rows:
        text = text or ""
        n, *_, repeated = brute_quality(text)
        kept = n >= 50 and 100 * repeated <= 50 * n
        if kept:
            own, words = classes(text), Counter(plain(text))
            size = max(1, sum(words.values()))
            chars = min(far([k / sum(own) for k in own], r[0]) for r in refs.values())
            close = []
            for _, names, shares in refs.values():
                part = [words[w] / size for w in names]
                close.append(far([*part, 1 - sum(part)], shares))
            kept = chars <= 0.30 and min(close) <= 0.15 + 2.6 / math.sqrt(n)
        out.append((i, kept))
    return out


def test_verdicts_equal_plain_counting(docs):
    rng = random.Random(12)
    common = {"en": "the of and to in is that it was for".split(), "de": "der die und in den von zu das mit sich".split()}
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        share = rng.choice([0.5, 0.4, 0.15, 0.0])
        words = [rng.choice(common[lang]) if rng.random() < share else f"w{rng.randrange(900)}" for _ in range(rng.choice([40, 55, 90, 400, 1500]))]
        if i % 10 == 0:
            words = [w.upper() + "###" for w in words]
        rows.append((i, " ".join(words) + ".", lang))
    rows += [(200, "é" * 30_000 + " a" * 60, "en"), (201, "the of " * 40_000, None), (202, None, "en"), (203, "", "de")]
    frame = docs([(*r, "s") for r in rows])
    got = {(r.doc_id, r.kept) for r in quality.judge(frame, quality.references(frame)).collect()}
    want = brute_verdicts(rows)
    assert got == set(want) and 20 < sum(k for _, k in want) < 140


def test_distance():
    import numpy as np

    assert quality.distance(np.array([1.0, 0]), np.array([[0, 1.0], [1, 0]])).tolist() == [1.0, 0.0]

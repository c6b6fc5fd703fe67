import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from gridledger.llm import exact_dedup, mixing, near_dedup, packing, quality, sharding
from gridledger.llm.queries import tokenizer_file


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, the excess over the bound shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), sum(sizes.values())
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > most * sizes[s]}
        if not over:
            out |= {s: weight[s] * rate for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def mixed_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(0, 60)) if i % 9 else "", None, rng.choice(["b", "a", "é", None, "big", "big", "big", "z"])) for i in range(600)]
    return rows + [(7, "w w", None, "a"), (7, "w w", None, "a"), (None, "w w w", None, "b"), (601, None, None, "none"), (602, "tiny", None, "c")]


def test_mix(docs):
    rows = mixed_rows()
    got = mixing.mix(docs(rows).repartition(7)).collect()
    again = mixing.mix(docs(rows[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes, source = Counter(), {}
    for i, x, _, s in rows:
        sizes[s] += len((x or "").split())
        source.setdefault((i, len((x or "").split())), s)
    want = targets(sizes)
    assert sorted(r.size for r in got) == sorted(len((x or "").split()) for _, x, _, _ in rows)
    taken, seen = Counter(), {}
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        seen[s] = max(seen.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= seen[s] + 1
    assert 0 <= sum(taken.values()) - sum(sizes.values()) <= max(seen.values())


def test_mixed_documents_are_the_taken_copies(docs):
    frame = docs(mixed_rows(2))
    out = mixing.mixed_documents(frame)
    assert out.columns == frame.columns
    counts = Counter((r.doc_id, len((r.text or "").split())) for r in out.collect())
    want = Counter()
    for r in mixing.mix(frame).collect():
        want[(r.doc_id, r.size)] += r.taken // r.size if r.size else 0
    assert counts == +want


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed_documents(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([(1, ""), (2, None)])).collect()] == [0, 0]


def check_shards(got, shards, near):
    total, by = sum(r.size for r in got), {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append((r.slot, r.size))
    assert set(by) <= set(range(shards))
    for places in by.values():
        assert sorted(p for p, _ in places) == list(range(len(places)))
        assert abs(sum(s for _, s in places) - total / shards) <= near


def test_shards(docs):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(0, 200)) for i in range(3000)]
    got = sharding.place(docs(rows)).collect()
    check_shards(got, 8, 0.001 * sum(r.size for r in got) / 8 * 6 + 402)
    want = sorted((i, len(x.encode()) + 1, zlib.crc32(x.encode())) for i, x in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    # Copies stay together where their bytes allow it.
    shard = {}
    for r in got:
        shard.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shard.values()) <= 7


def test_groups_that_fit_are_not_cut(docs):
    rng = random.Random(8)
    rows = [(i, f"{i} " + "é" * rng.randrange(0, 200)) for i in range(3000)]
    copies = [9000, 700, 300, 260, 80, 20, 3, 2]  # the first is more than a shard
    rows += [(10_000 * (g + 1) + i, f"group {g} of equal texts") for g, n in enumerate(copies) for i in range(n)]
    got = sharding.place(docs(rows).repartition(7)).collect()
    check_shards(got, 8, 0.001 * sum(r.size for r in got) / 8 * 6 + 402)
    assert len(got) == len(rows)
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    cut = {c for c, s in homes.items() if len(s) > 1}
    assert cut == {zlib.crc32(b"group 0 of equal texts")}


def test_groups_beyond_what_equal_shards_hold(docs):
    """Nine groups that are each a ninth: eight stay whole, the ninth is cut so that shards come out equal."""
    rows = [(1000 * g + i, f"group {g}") for g in range(9) for i in range(400)]
    got = sharding.place(docs(rows)).collect()
    check_shards(got, 8, 0.001 * 3600 * 8 / 8 * 2 + 8)
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert sorted(len(s) for s in homes.values()) == [1] * 8 + [8]


def test_shards_of_very_long_texts(docs):
    rows = [(1, "long " * 200_000), (2, "long " * 200_000), (3, "ä" * 400_000), *[(i, "t" * i) for i in range(4, 300)]]
    got = {r.doc_id: r for r in sharding.place(docs(rows), 2).collect()}
    assert len(got) == len(rows) and got[3].size == 800_001 and got[1].text_crc32 == zlib.crc32(b"long " * 200_000)
    assert {s for s in (got[i].shard for i in got)} == {0, 1}


def test_shards_of_a_hot_text_nulls_and_repeats(docs):
    rows = [(i, "same text") for i in range(900)] + [(i, f"t{i}") for i in range(900, 1500)] + [(None, "n"), (None, None), (3, ""), (3, "")]
    got = sharding.place(docs(rows)).collect()
    assert len(got) == len(rows) and {r.size for r in got if r.doc_id is None} == {1, 2}
    check_shards(got, 8, 60)
    assert sharding.place(docs([])).count() == 0
    assert [(r.shard, r.slot) for r in sharding.place(docs([(1, "x")])).collect()][0][1] == 0


def test_pipeline_stages(docs, spark, tmp_path):
    rng = random.Random(5)
    common = "the of and to in is that it was for".split()
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else f"word{rng.randrange(3000)}" for _ in range(90)) + "."
    base = [text() for _ in range(60)]
    near = base[3].split()
    near[10] = "changed"
    rows = [(i, x, "en", f"s{i % 3}") for i, x in enumerate(base)]
    rows += [(100, base[0], "en", "s0"), (100, base[0], "en", "s0"), (101, " ".join(near), "en", "s1"), (102, "too short", "en", "s1"), (103, None, None, None), (None, base[1], "en", None)]
    frame = docs(rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    read = lambda: spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    now, seen = read(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns
        seen[name] = Counter(r.doc_id for r in now.collect())
    judged = {r.doc_id: r.kept for r in quality.judge(read(), quality.references(read())).collect()}
    assert 102 not in seen["quality"] and 103 not in seen["quality"]
    assert set(seen["quality"]) == {i for i, k in judged.items() if k}
    assert 0 not in seen["exact_dedup"] and seen["exact_dedup"][100] == 1 and None not in seen["exact_dedup"]
    assert 101 not in seen["near_dedup"] and 3 in seen["near_dedup"] and max(seen["near_dedup"].values()) == 1
    assert set(seen["mixing"]) <= set(seen["near_dedup"]) and max(seen["mixing"].values()) <= 3
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in packed.collect() if r.piece == 0) == seen["mixing"]
    assert packing.pack_documents(now, tokenizer_file()).count() == packed.count()
    assert exact_dedup.drop_copies(now).count() == near_dedup.drop_near_copies(exact_dedup.drop_copies(now)).count()


def test_pipeline_of_an_empty_table(docs, spark, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

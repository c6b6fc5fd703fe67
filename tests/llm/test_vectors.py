"""Whitening, SimHash and hard negatives against brute force."""

import math

import duckdb
import numpy as np
import pytest

from gridledger.llm import hard_negatives, queries, simhash, vectors, whitening

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def embedded(spark):
    """Rows of (vec_id, embedding, label), with columns that operators use inside."""
    def make(rows):
        frame = spark.createDataFrame(rows, VECTORS)
        for name in ("id", "x", "q", "row", "n", "h", "g", "score", "length"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return make


def random_rows(n, dim, seed=0, labels=4, copies=0):
    rng = np.random.default_rng(seed)
    spread = np.linspace(1.0, 0.2, dim)
    rows = [(i, (rng.standard_normal(dim) * spread / 4).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    return rows + [(n + i, rows[0][1], rows[0][2]) for i in range(copies)]


BAD = [(900, None, 1), (901, [], 1), (902, [0.1, None] + [0.0] * 10, 1), (903, [NAN] + [0.0] * 11, 1), (904, [INF] * 12, 1), (905, [0.5] * 5, 1)]


def whole(rows, scale, shift=0):
    return np.floor(scale * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + shift


def test_whitening_equals_a_dense_eigenvector_solver(embedded):
    rows = random_rows(300, 12, copies=40)
    got = whitening.whiten(embedded(rows + BAD)).toPandas()
    x = whole(rows, 1024, 100_000)
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, along = np.linalg.eigh(c.T @ c / n)
    values, along = values[::-1], along[:, ::-1]
    assert sorted(got.vec_id.unique()) == [r[0] for r in rows] and len(got) == 8 * n
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    first = got[got.component == 1].set_index("vec_id").sort_index()
    assert [int(v) for v in first.deviation] == exact and set(got.n) == {n}
    for k in range(8):
        part = got[got.component == k + 1].set_index("vec_id").sort_index()
        want = c @ along[:, k] / math.sqrt(values[k])
        sign = np.sign(want[0] * part.whitened.iloc[0])
        assert np.abs(sign * part.whitened.to_numpy() - want).max() < 1e-9
        assert math.isclose(part.explained.iloc[0], values[k] / values.sum(), rel_tol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, [0.5] * 4, 1)], [(1, [0.5] * 4, 1)] * 5, [(1, None, 1), (2, [], 2)]])
def test_whitening_of_what_does_not_vary_has_no_rows(embedded, rows):
    assert whitening.whiten(embedded(rows)).collect() == []


def test_whitening_gives_as_many_components_as_vary(embedded):
    rows = [(i, [0.1 * (i % 3), 0.0, 0.5, 0.1 * (i % 2)], 0) for i in range(12)] + [(None, [0.3, 0.0, 0.5, 0.0], 0)]
    got = whitening.whiten(embedded(rows)).toPandas()
    assert sorted(got.component.unique()) == [1, 2] and len(got) == 2 * 13
    assert got.vec_id.isna().sum() == 2 and got.identity_error.iloc[0] < 1e-9


def test_a_deviation_may_pass_the_range_of_a_long(embedded):
    rows = [(i, [float(i % 2) * 2e6, float(i)], 0) for i in range(6)]
    got = whitening.whiten(embedded(rows)).filter("component = 1").toPandas().set_index("vec_id")
    x = whole(rows, 1024, 100_000)
    want = [sum((6 * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    assert max(want) > 2**63 and [int(got.deviation[i]) for i in range(6)] == want


@pytest.mark.parametrize("dim", [1, 8, 13, 200])
def test_jacobi_davidson_on_matrices(dim):
    made = np.random.default_rng(dim).standard_normal((dim, 2 * dim))
    square = made @ made.T
    values, along = whitening.jacobi_davidson(lambda w: square @ w, dim, min(8, dim))
    assert np.allclose(values, np.linalg.eigvalsh(square)[::-1][: len(values)], rtol=1e-13)
    assert np.abs(along.T @ along - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(square @ along - along * values, axis=0).max() < 1e-13 * dim * values[0]


def test_jacobi_davidson_on_equal_eigenvalues():
    values, _ = whitening.jacobi_davidson(lambda w: np.diag([2.0] * 20 + [1.0] * 40) @ w, 60, 8)
    assert np.allclose(values, 2)


def brute_negatives(rows, every=50, k=5, m=3):
    q = whole(rows, 256)
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if anchor % every:
            continue
        score = [int(v) for v in q @ q[a]]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-score[i], rows[i][0], i))
        for p in [i for i in order if rows[i][2] == label][:k]:
            fit = [i for i in order if rows[i][2] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:m]
            out += [(anchor, rows[p][0], r + 1, rows[i][0], score[p], score[i]) for r, i in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("streams, held", [(64, 8192), (3, 4)])
def test_hard_negatives_equal_brute_force(embedded, streams, held):
    rows = random_rows(600, 12, seed=3, copies=30)  # equal vectors: ties
    rows += [(700, [0.0] * 12, 1), (750, [-v for v in rows[0][1]], 1)]
    frame = embedded(rows + BAD + [(950, rows[1][1], None), (None, rows[1][1], 1)])
    got = hard_negatives.mine(frame, streams=streams, held=held).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_hard_negatives_with_repeated_ids(embedded):
    rows = random_rows(60, 6, seed=5, labels=2)
    rows += [(0, rows[0][1], rows[0][2]), (50, rows[3][1], 1 - rows[50][2])]
    got = hard_negatives.mine(embedded(rows).coalesce(1)).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_hard_negatives_of_little(embedded):
    assert hard_negatives.mine(embedded([])).collect() == []
    assert hard_negatives.mine(embedded([(50, [0.5, 0.5], 1)])).collect() == []
    assert hard_negatives.mine(embedded(BAD)).collect() == []


def test_scores_are_exact_far_beyond_float32():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**21), 2**21, (40, 300)), rng.integers(-(2**21), 2**21, (50, 300))
    primes = hard_negatives.primes_over(300 * 2**43)
    got = hard_negatives.scores(hard_negatives.Residues(a, primes), hard_negatives.Residues(b, primes), primes)
    assert (got == a @ b.T).all() and math.prod(primes) < 2**63
    small = hard_negatives.primes_over(10)
    assert small == [1021] and len(primes) > 4


def test_first_of_takes_the_earlier_of_equals():
    values = np.array([[5, 7, 7, hard_negatives.NONE, 7], [1, 1, 1, 1, 1]])
    for bound in (10, 2**61):
        assert hard_negatives.first_of(values, 2, bound).tolist() == [[1, 2], [0, 1]]


def test_hard_negatives_query_equals_its_sql(spark, tmp_path):
    rows = random_rows(300, 8, seed=9, labels=10, copies=20) + [(r[0], (r[1] or [])[:8] if r[1] else None, r[2]) for r in BAD[:1]]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    made = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    want = con.execute(queries.ORACLES["op13_hard_negatives"]).df()
    assert sorted(map(tuple, made.select(*want.columns).collect())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_usual_size_prefers_the_longer_of_equals(spark):
    frame = spark.createDataFrame([([1, 2],), ([1, 2, 3],)], "v array<long>")
    assert vectors.usual_size(frame, "v") == 3 and vectors.usual_size(frame.limit(0), "v") == 0


def brute_print(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    prints = list(prints)
    part = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits and part[i] != part[j]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return part


def test_simhash_equals_brute_force(docs):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ÀB", "字"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 400))) for _ in range(60)]
    for base in texts[:15]:  # near copies: a word or two changed
        words = base.split()
        for _ in range(6):
            words[rng.integers(len(words))] = "new"
            texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), None, "", " \t\n ", "one", "One two", "a\x0bb\x0cc d", "a\xa0b c", "x " * 200_000 + "y"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash.link(docs(rows)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i]["fingerprint"] for i, _ in rows] == [f"{p:016x}" for p in prints]
    part = brute_components(prints)
    for (i, _), p in zip(rows, part, strict=True):
        assert got[i]["component_id"] == min(1000 - j for j, q in enumerate(part) if q == p)


def test_simhash_ids_may_be_null_or_repeat(docs):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "other words of a text"), (3, "other words of a text"), (None, "alone in the world")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.link(docs(rows)).collect())
    assert got == [(0, 0), (0, 5), (3, 3), (5, 3), (5, 5)]
    assert simhash.link(docs([]).limit(0)).collect() == []


def test_simhash_pieces_do_not_change_a_fingerprint():
    text = " ".join(f"w{i % 37}" for i in range(500))
    assert simhash.fingerprint(text, piece=7) == simhash.fingerprint(text) == brute_print(text)


def test_the_code_is_perfect():
    upper, errors, others = simhash.golay()
    assert len(set(errors.tolist())) == 2**11 and max(int(e).bit_count() for e in errors) == 3
    assert {int(e).bit_count() == 3 for e, o in zip(errors, others, strict=True) if o[0] < 0} == {False}


@pytest.mark.parametrize("errors", [0, 1, 2, 3, 4])
def test_prints_up_to_four_bits_apart_share_a_key(errors):
    rng = np.random.default_rng(errors)
    one = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000).astype(np.uint64)
    other = one.copy()
    for i in range(len(other)):
        for b in rng.choice(64, errors, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    shared = np.zeros(len(one), bool)
    (at, a), (by, b) = simhash.keys(one), simhash.keys(other)
    left, right = set(zip(at.tolist(), a.tolist(), strict=True)), set(zip(by.tolist(), b.tolist(), strict=True))
    for i, _ in left & right:
        shared[i] = True
    assert shared.all()


@pytest.mark.parametrize("block", [2048, 16])
def test_links_connect_a_dense_bucket(spark, block):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    prints = {base}
    for _ in range(300):  # a family around one print, most of it in the same buckets
        p = base
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    edges = simhash.links(frame, block=block).collect()
    at = {p: i for i, p in enumerate(signed)}
    part = list(range(len(prints)))
    for a, b in edges:
        x, y = part[at[a]], part[at[b]]
        part = [min(x, y) if p in (x, y) else p for p in part]
    assert part == brute_components(prints)

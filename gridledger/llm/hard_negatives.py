"""Hard negatives by exact integer scores from residue-number-system matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import gathered, matrix, usual_size, whole

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score lies within these percentages of its positive's.
LOW, HIGH = 50, 95
#: Streams the rows are dealt to; anchors that a task holds while a stream passes; anchors and rows of one product.
STREAMS, HELD, ANCHORS, ROWS = 64, 8192, 512, 1024
#: Dimensions summed in float32 before a reduction; the residues' primes lie below LIMIT: DIMS * (LIMIT / 2) ** 2 <= 2 ** 24.
DIMS, LIMIT = 64, 1022
#: Squared lengths from here on take no part: scores would leave the range that the primes and a long hold.
LONGEST = 1 << 58
NONE = np.iinfo(np.int64).min


def primes_over(bound: int) -> list[int]:
    """The greatest primes below LIMIT whose product is over twice ``bound``, so that it parts all scores up to it."""
    found, product, at = [], 1, LIMIT
    while product <= 2 * bound + 1:
        at -= 1
        if all(at % d for d in range(2, int(at**0.5) + 1)):
            found.append(at)
            product *= at
    return found


class Residues:
    """Rows of whole numbers as float32 matrices of their residues, centred at 0, one for each prime."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.parts = []
        for p in primes:
            r = np.mod(rows, p)
            self.parts.append(np.where(r > p // 2, r - p, r).astype(np.float32))

    def __getitem__(self, rows) -> Residues:
        some = object.__new__(Residues)
        some.parts = [x[rows] for x in self.parts]
        return some


def scores(one: Residues, other: Residues, primes: list[int]) -> np.ndarray:
    """All inner products of two lists of rows, exact, from float32 products modulo each prime.

    A product over DIMS dimensions stays below 2 ** 24, where float32 holds whole numbers;
    mixed-radix Chinese remaindering then gives the number in the primes' range, and its upper
    half stands for negative scores.
    """
    total, radix = None, 1
    for a, b, p in zip(one.parts, other.parts, primes, strict=True):
        rest = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], DIMS):
            rest += (a[:, at : at + DIMS] @ b[:, at : at + DIMS].T).astype(np.int32) % p
        if total is None:
            total = rest % p
        else:
            total += radix * ((rest - total) % p * pow(radix, -1, p) % p)
        radix *= p
    total[total > radix // 2] -= radix
    return total


def first_of(values: np.ndarray, k: int, bound: int) -> np.ndarray:
    """Columns of the k greatest values of each row, the earlier of equals first; NONE is below all others."""
    wide = values.shape[1]
    if k >= wide or bound >= 2**60 // wide:
        return np.argsort(~values, axis=1, kind="stable")[:, :k]
    keys = np.where(values == NONE, NONE, values * wide + (wide - 1 - np.arange(wide)))
    some = np.argpartition(keys, wide - k, axis=1)[:, wide - k :]
    order = np.argsort(~np.take_along_axis(keys, some, axis=1), axis=1)
    return np.take_along_axis(some, order, axis=1)


class _Best:
    """The best k (score, id, row) of each of some lists so far."""

    def __init__(self, lists: int, k: int):
        self.score = np.full((lists, k), NONE)
        self.id, self.row = np.zeros((lists, k), np.int64), np.zeros((lists, k), np.int64)

    def offer(self, at: slice | np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, bound: int) -> None:
        """Scores of rows in the order of their ids, for the lists ``at``."""
        k = self.score.shape[1]
        took = first_of(score, min(k, score.shape[1]), bound)
        s = np.concatenate([self.score[at], np.take_along_axis(score, took, axis=1)], axis=1)
        i, r = np.concatenate([self.id[at], ids[took]], axis=1), np.concatenate([self.row[at], rows[took]], axis=1)
        order = np.lexsort((r, i, -np.maximum(s, NONE + 1)), axis=1)[:, :k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(x, order, axis=1) for x in (s, i, r))

    def found(self):
        """(list, id, row, score) of all that are held."""
        at, place = np.nonzero(self.score != NONE)
        return at, self.id[at, place], self.row[at, place], self.score[at, place]


def mine(
    rows: DataFrame, *, scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, streams: int = STREAMS, held: int = HELD,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Per anchor, positive and rank: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; scores are inner products of whole numbers.  Anchors
    are the rows whose id is divisible by ``every``; the first ``positives`` other rows of an anchor's
    label are its positives, and for each the first ``negatives`` rows of other labels with
    ``low * p <= 100 * s <= high * p`` come back (p the positive's score), by falling score, then rising id.

    Rows with a null id, label or vector, a null or non-finite component, another length than most vectors have or a
    squared scaled length of 2**58 or more take no part; ids and labels are whole numbers.  Rows that
    repeat an id are rows of their own: each is an anchor, and the others may be
    its positives; equal rows keep the order of the table as written.  An empty table gives no rows.  Other columns are not read.

    Every anchor is scored against every row, twice: for its positives, then for its windows.
    A task holds ``held`` anchors and sees one of ``streams`` parts of the rows, a block at a time;
    what it passes on is a few rows an anchor, whatever the size of its part.
    """
    made = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole(F.col(vector_col), scale).alias("q")
    ).filter("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    length = F.aggregate("q", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    made = stored(made.withColumn("length", length).filter(F.col("length") < float(LONGEST)).withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    dim = usual_size(made, "q")
    whole_rows = made.filter(F.size("q") == dim).select("row", "id", "label", "q", "length")
    longest, anchors_n = whole_rows.agg(F.max("length"), F.count_if(F.col("id") % every == 0)).first()
    bound, parts = int(longest or 0) + 1, max(1, -(-(anchors_n or 0) // held))
    primes = primes_over(2 * bound)

    anchors = whole_rows.filter(F.col("id") % every == 0).drop("length")
    stream = stored(_packed(whole_rows.drop("length"), dim).withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(streams)).cast("int")), "vector-stream")
    near = _scan(anchors.withColumn("windows", F.lit(None).cast("array<long>")), stream, dim, primes, bound, parts, streams, positives, None)
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row")
    chosen = stored(
        near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).select(
            "anchor", (F.col("place") - 1).alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    # At most ``positives`` scores an anchor; a list's place in the array is its number.
    listed = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("list", "positive_score"))).alias("found"))
    asking = anchors.join(listed, anchors["row"] == listed["anchor"]).select(anchors["*"], F.col("found.positive_score").alias("windows"))
    hard = _scan(asking, stream, dim, primes, bound, parts, streams, negatives, (low, high))
    best = Window.partitionBy("anchor", "list").orderBy(F.col("score").desc(), "id", "row")
    ranked = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    named = ranked.join(chosen, ["anchor", "list"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _packed(rows: DataFrame, dim: int, size: int = ROWS, *more: str) -> DataFrame:
    """Blocks of ``size`` rows, packed: ``n, rows, ids, labels, q``."""
    def pack(batches) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, size):
            order = np.argsort(part.column(1).to_numpy(), kind="stable")
            columns = [part.column(k).to_numpy()[order] for k in range(3)] + [matrix(part.column(3), dim).astype(np.int32)[order]]
            packed = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), *packed], names=["n", "rows", "ids", "labels", "q"])

    return rows.select("row", "id", "label", "q").mapInArrow(pack, "n long, rows binary, ids binary, labels binary, q binary")


def _scan(
    anchors: DataFrame, stream: DataFrame, dim: int, primes: list[int], bound: int, parts: int, streams: int, k: int, window: tuple[int, int] | None,
) -> DataFrame:
    """The best k rows for each list of each anchor and stream: ``anchor, list, id, row, score``.

    Without ``window`` an anchor has one list, other rows of its label; with it, a list of rows of other
    labels for each positive score in ``windows``.
    """
    empty = F.lit(None)
    one = anchors.select(
        F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("g"),
        F.lit(0).alias("side"), F.lit(1).cast("long").alias("n"), "row", "id", "label", "windows",
        F.col("q").cast("array<int>").alias("q"), *[empty.cast("binary").alias(x) for x in ("rows", "ids", "labels", "packed")],
    )
    other = stream.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("h"), "g", F.lit(1).alias("side"), "n",
        *[empty.cast("long").alias(x) for x in ("row", "id", "label")], empty.cast("array<long>").alias("windows"),
        empty.cast("array<int>").alias("q"), "rows", "ids", "labels", F.col("q").alias("packed"),
    )

    def compare(batches) -> Iterator[pa.RecordBatch]:
        task, key = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}
                if (now := (r["h"].as_py(), r["g"].as_py())) != key:
                    if task is not None:
                        yield task.found()
                    task, key = _Task(dim, primes, bound, k, window), now
                if r["side"].as_py() == 0:
                    task.hold(r)
                else:
                    task.see(r)
        if task is not None:
            yield task.found()

    dealt = one.unionByName(other).repartition(parts * streams, "h", "g").sortWithinPartitions("h", "g", "side")
    return dealt.mapInArrow(compare, "anchor long, list int, id long, row long, score long")


class _Task:
    """Some anchors, held, and the best of the blocks of rows that pass by."""

    def __init__(self, dim: int, primes: list[int], bound: int, k: int, window: tuple[int, int] | None):
        self.dim, self.primes, self.bound, self.k, self.window = dim, primes, bound, k, window
        self.asked: list[tuple] = []
        self.best: list[_Best] | None = None

    def hold(self, r) -> None:
        self.asked.append((r["row"].as_py(), r["label"].as_py(), r["windows"].as_py() or [], r["q"].values.to_numpy()))

    def _ready(self) -> None:
        n = len(self.asked)
        self.row, self.label = (np.array([x[i] for x in self.asked], np.int64) for i in (0, 1))
        self.q = Residues(np.stack([x[3] for x in self.asked]) if n else np.zeros((0, self.dim), np.int32), self.primes)
        if self.window:
            low, high = self.window
            p = [np.array([x[2][i] if i < len(x[2]) else -1 for x in self.asked], np.int64) for i in range(max([len(x[2]) for x in self.asked], default=0))]
            # Whole-number bounds of low * p <= 100 * s <= high * p; a negative p has none.
            self.bounds = [(np.where(x < 0, 1, -((-low * x) // 100)), np.where(x < 0, 0, high * x // 100)) for x in p]
        self.best = [_Best(n, self.k) for _ in (self.bounds if self.window else [0])]
        self.asked = []

    def see(self, r) -> None:
        if self.best is None:
            self._ready()
        rows, ids, labels = (np.frombuffer(r[x].as_buffer(), np.int64) for x in ("rows", "ids", "labels"))
        q = Residues(np.frombuffer(r["packed"].as_buffer(), np.int32).reshape(-1, self.dim), self.primes)
        for at in range(0, len(self.row), ANCHORS):
            part = slice(at, at + ANCHORS)
            s = scores(self.q[part], q, self.primes)
            same = self.label[part][:, None] == labels[None, :]
            if not self.window:
                same &= self.row[part][:, None] != rows[None, :]
                self.best[0].offer(part, np.where(same, s, NONE), ids, rows, self.bound)
                continue
            for best, (low, high) in zip(self.best, self.bounds, strict=True):
                inside = ~same & (s >= low[part][:, None]) & (s <= high[part][:, None])
                some = np.flatnonzero((inside & (s >= best.score[part][:, -1:])).any(axis=1))
                if len(some):
                    best.offer(at + some, np.where(inside[some], s[some], NONE), ids, rows, self.bound)

    def found(self) -> pa.RecordBatch:
        if self.best is None:
            self._ready()
        columns = [np.empty(0, np.int64)] * 5
        for number, best in enumerate(self.best):
            at, ids, rows, score = best.found()
            new = (self.row[at], np.full(len(at), number), ids, rows, score)
            columns = [np.concatenate([x, y]) for x, y in zip(columns, new, strict=True)]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["anchor", "list", "id", "row", "score"])


def rotated(label: Column, vec_id: Column) -> Column:
    """The label of a table with moved labels: of every seventh id the next of ten."""
    return F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)

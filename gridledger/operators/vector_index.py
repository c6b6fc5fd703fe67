"""Top-k by cosine similarity over cells of near vectors.

Vectors are dealt to the nearest of some centroids.  A query is scored against the vectors of its
nearest cells, or of all cells, which is exact.  A cell is cut into parts of bounded size, so that no
task holds more than one part; queries stream past it and stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Vectors that centroids are fitted on, the smallest by a hash of their key; most centroids; rounds.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 12
#: Vectors of a part of a cell.
PART_ROWS = 4096


class VectorIndex(NamedTuple):
    """``rows`` (cell, part, turn, row struct, unit vector), ``parts`` (cell, parts), and the centroids.

    ``turn`` is 0 in a row's nearest cell, 1 in the next one, and so on.
    """

    rows: DataFrame
    parts: DataFrame
    centroids: np.ndarray
    key: str


def unit(rows) -> np.ndarray:
    """Rows scaled to length 1 in double precision; a zero row stays zero."""
    m = np.stack([np.asarray(r, dtype=float) for r in rows]) if len(rows) else np.empty((0, 0))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def centroids_of(sample: np.ndarray, cells: int, *, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Directions that split unit vectors into cells, by spherical k-means; a cell that empties keeps its direction."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norm > 0, sums / np.where(norm == 0, 1.0, norm), at)
    return at


def build_cells(rows: DataFrame, *, key: str, vector: str, columns: list[str] = (), cells: int | None = None, path: str | None = None,
                spill: int = 1, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> VectorIndex:
    """Write the vectors of a table, dealt to cells, to ``path`` (by default a fresh scratch folder).

    Centroids are fitted on at most ``sample`` vectors; there are as many as the root of the number of
    rows, ``MOST_CELLS`` at most, unless ``cells`` is given.  Every row is dealt to its ``spill`` nearest cells, so that one
    at the edge of a cell is found from either side; rows with a null vector are left out.
    """
    spark = rows.sparkSession
    kept = list(dict.fromkeys([key, *columns]))
    folder = path or scratch_path(spark, "vector-index")
    filled = rows.filter(F.col(vector).isNotNull())
    numbered = filled.select(F.struct(*kept, F.monotonically_increasing_id().alias("_row")).alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    numbered.write.parquet(f"{folder}/source")
    source = spark.read.schema(numbered.schema).parquet(f"{folder}/source")
    drawn = source.orderBy(F.xxhash64(F.col(f"row.{key}")), f"row.{key}").limit(sample).select("vector").toPandas()["vector"]
    if cells is None:
        cells = min(MOST_CELLS, max(1, round(source.count() ** 0.5)))
    at = centroids_of(unit(list(drawn)), cells) if len(drawn) else np.zeros((1, 1))

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit(batch.column(1).to_pylist())
            if not batch.num_rows:
                continue
            order = np.argsort(-(vectors @ at.T), axis=1, kind="stable")[:, :spill]
            for turn in range(order.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[:, turn].astype(np.int32)), pa.array(np.full(len(order), turn, np.int32)), batch.column(0),
                     pa.array(list(vectors), pa.list_(pa.float64()))],
                    names=["cell", "turn", "row", "vector"],
                )

    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("cell", "turn")] + source.schema.fields)
    source.mapInArrow(deal, schema).write.parquet(f"{folder}/cells")
    dealt = spark.read.schema(schema).parquet(f"{folder}/cells")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    split = dealt.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(F.col(f"row.{key}")), F.col("parts")).cast("int"))
    return VectorIndex(split.select("cell", "part", "turn", "row", "vector"), parts, at, key)


def search_cells(queries: DataFrame, index: VectorIndex, *, k: int, probes: int | None = None, query_id: str = "query_id",
                 query_vector: str = "query_vector") -> DataFrame:
    """Best ``k`` rows per query by cosine, with score and rank; ties go to the smaller key.

    ``probes`` is the number of nearest cells that a query looks into; None looks into all and is
    exact, each row in its nearest cell alone.  Every pair of a query and a cell's part is scored in the task that holds the part, and
    only the best ``k`` of each leave it.
    """
    asked = queries.select(query_id, F.col(query_vector).cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    id_type, row_type, key = asked.schema[query_id].dataType, index.rows.schema["row"].dataType, index.key
    held = index.rows.filter("turn = 0") if probes is None else index.rows
    if probes is None:
        near = asked.withColumn("cells", index.parts.agg(F.collect_list("cell")).scalar())
    else:
        near = _with_cells(asked, index.centroids, probes, query_id, id_type)
    pairs = near.select(query_id, "vector", F.explode("cells").alias("cell")).join(index.parts, "cell")
    pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = held.select("cell", "part", F.lit(0).alias("side"), "vector", "row", F.lit(None).cast(id_type).alias("query")).unionByName(
        pairs.select("cell", "part", F.lit(1).alias("side"), "vector", F.lit(None).cast(row_type).alias("row"), F.col(query_id).alias("query"))
    )

    def score(batches) -> Iterator[pa.RecordBatch]:
        held, now, ready = [], None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, z in zip(edges, edges[1:], strict=False):
                run = batch.slice(a, z - a)
                if (cell := tuple(keys[a, :2])) != now:
                    held, now, ready = [], cell, None
                if keys[a, 2] == 0:
                    held.append((run.column(4), run.column(3).to_pylist()))
                elif held:
                    ready = ready or _part(held, key)
                    yield from _best(run, ready, k)

    out = T.StructType([T.StructField("query", id_type), T.StructField("row", row_type), T.StructField("score", T.DoubleType())])
    found = sides.repartition("cell", "part").sortWithinPartitions("cell", "part", "side").mapInArrow(score, out)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col(f"row.{index.key}"))
    if probes is not None:  # a row may be met in several cells
        found = found.dropDuplicates(["query", "row"])
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), "row.*", "score", "rank").drop("_row")


def _with_cells(asked: DataFrame, at: np.ndarray, probes: int, query_id: str, id_type) -> DataFrame:
    """Queries with the numbers of their nearest cells."""
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = np.argsort(-(unit(list(batch["vector"])) @ at.T), axis=1, kind="stable")[:, :probes] if len(batch) else []
            yield batch.assign(cells=list(order))

    schema = T.StructType([T.StructField(query_id, id_type), asked.schema["vector"], T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return asked.mapInPandas(choose, schema)


def _part(held, key: str):
    """The rows of a part in the order of their keys, with their vectors as columns."""
    rows = pa.concat_arrays([r for r, _ in held])
    order = pc.sort_indices(rows.field(rows.type.get_field_index(key)))
    vectors = unit([v for _, part in held for v in part])[order.to_numpy()]
    return rows.take(order), vectors.T


def _best(run: pa.RecordBatch, part, k: int, rows_at_once: int = 512) -> Iterator[pa.RecordBatch]:
    rows, columns = part
    for first in range(0, run.num_rows, rows_at_once):
        asked = run.slice(first, rows_at_once)
        scores = unit(asked.column(3).to_pylist()) @ columns
        wide = scores.shape[1]
        if wide > k:
            bar = np.partition(scores, wide - k, axis=1)[:, wide - k, None]
            taken = [np.flatnonzero(s >= b) for s, b in zip(scores, bar, strict=True)]
            taken = [t[np.argsort(-s[t], kind="stable")[:k]] for s, t in zip(scores, taken, strict=True)]
        else:
            taken = [np.arange(wide)] * len(scores)
        which = np.repeat(np.arange(len(scores)), [len(t) for t in taken])
        at = np.concatenate(taken)
        yield pa.RecordBatch.from_arrays(
            [asked.column(5).take(pa.array(which)), rows.take(pa.array(at)), pa.array(scores[which, at])], names=["query", "row", "score"]
        )

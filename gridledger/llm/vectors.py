"""Embedding rows as whole numbers, and as blocks that a task reads at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: Column, scale: int, shift: int = 0) -> Column:
    """``floor(scale * c) + shift`` of each entry, as double first; null if the vector is null or an entry is null or not finite."""
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    doubles = vector.cast("array<double>")
    made = F.transform(doubles, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))
    return F.when(F.forall(doubles, finite), made)


def usual_size(vectors: DataFrame, name: str) -> int:
    """The length that most arrays of a column have, the greater one of equals; 0 if there are none."""
    found = vectors.groupBy(F.size(name).alias("size")).agg(F.count("*").alias("n"))
    first = found.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    return first["size"] if first else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def gathered(batches, rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined and cut so that each has ``rows`` rows, but for the last."""
    held, size = [], 0
    for batch in batches:
        while size + batch.num_rows >= rows:
            take = rows - size
            yield _joined([*held, batch.slice(0, take)])
            batch, held, size = batch.slice(take), [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield _joined(held)


def _joined(parts) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

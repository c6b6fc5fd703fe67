"""Joins that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL; the columns of ``left``, then the others of ``right``."""
    other = right.withColumnsRenamed({c: f"_same_{c}" for c in on})
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return left.join(other, test, how).drop(*[f"_same_{c}" for c in on])

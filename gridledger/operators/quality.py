"""Named data-quality rules: drop, warn, quarantine, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _holds(rule: str) -> Column:
    # A rule that evaluates to NULL counts as violated.
    return F.coalesce(F.expr(rule), F.lit(False))


def _all_hold(rules: dict[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [_holds(r) for r in rules.values()])


def violations(rules: dict[str, str]) -> Column:
    """Names of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(~_holds(r), F.lit(n)) for n, r in rules.items()]))


def expect(df: DataFrame, rules: dict[str, str], *, action: str = "drop", observation: Observation | str | None = None):
    """Apply named rules.

    ``drop`` keeps rows that satisfy all of them; ``warn`` keeps every row and
    counts violations in ``observation``, or for a stream under that
    name in its progress (``feeds.observed``); ``quarantine`` returns two frames, the
    good rows and the bad rows with the names of the rules they broke.
    """
    if action == "drop":
        return df.filter(_all_hold(rules))
    if action == "warn":
        counts = [F.count_if(~_holds(r)).alias(n) for n, r in rules.items()]
        return df.observe(observation if observation is not None else Observation(), *counts)
    if action == "quarantine":
        bad = df.withColumn("violations", violations(rules)).filter(F.size("violations") > 0)
        return df.filter(_all_hold(rules)), bad
    raise ValueError(f"unknown action {action!r}")


def expect_metrics(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per rule with the number of rows that pass and fail it; one scan for all rules."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(_holds(r)).alias(n) for n, r in rules.items()],
    )
    return counts.select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(n).alias("rule"), F.col(n).alias("passed"), (F.col("_n") - F.col(n)).alias("failed")
                )
                for n in rules
            ])
        )
    )


def nonempty_check(df: DataFrame, column: str) -> DataFrame:
    """One row with the number of filled rows; the job fails if there are none."""
    filled = F.count_if(F.col(column).isNotNull())
    return df.agg(filled.alias("n_filled")).select(
        F.when(F.col("n_filled") > 0, F.col("n_filled"))
        .otherwise(F.raise_error(F.lit(f"no rows with {column}")).cast("bigint"))
        .alias("n_filled")
    )

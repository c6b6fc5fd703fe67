"""Runs of rows that follow each other without a gap (sessions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from .joins import join_same


def _breaks(ts: str, previous: Column, gap_seconds: int) -> Column:
    step = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))
    return F.coalesce((step > gap_seconds * 1_000_000).cast("int"), F.lit(0))


def gap_island(df: DataFrame, *, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Add ``island``, the running number of the run a row belongs to within its key.

    A new run starts when the step from the row before is longer than
    ``gap_seconds``.  Rows are ordered within (key, day) only; what the days
    before add comes from a table with one row per key and day.
    """
    day = [*keys, "_day"]
    rows = df.withColumn("_day", F.to_date(ts))
    within = Window.partitionBy(*day).orderBy(ts)
    rows = rows.withColumn("_broke", _breaks(ts, F.lag(ts).over(within), gap_seconds)).withColumn(
        "_inside", F.sum("_broke").over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    days = rows.groupBy(*day).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_broke").alias("_n")
    )
    order = Window.partitionBy(*keys).orderBy("_day")
    days = days.withColumn("_open", _breaks("_first", F.lag("_last").over(order), gap_seconds))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_open") + F.col("_n")).over(past), F.lit(0)) + F.col("_open")
    return join_same(rows, days.select(*day, before.alias("_before")), day).select(
        *df.columns, (F.col("_before") + F.col("_inside")).alias("island")
    )


def _join_runs(runs: DataFrame, keys: list[str], bucket: str | None, gap_seconds: int) -> DataFrame:
    """Join runs that touch within their bucket, and mark as ``_done`` those that no other bucket can extend.

    Between the first and the last run of a bucket nothing can grow any more: those
    runs go on as groups of their own, so they spread over all tasks.
    """
    open_bucket = F.lit(None).cast("timestamp") if bucket is None else F.date_trunc(bucket, "window_start")
    runs = runs.withColumn("_bucket", F.when(F.col("_done"), F.col("window_start")).otherwise(open_bucket))
    part = [*keys, "_done", "_bucket"]
    w = Window.partitionBy(*part).orderBy("window_start")
    marked = (
        runs.withColumn("_broke", _breaks("window_start", F.lag("window_end").over(w), gap_seconds))
        .withColumn("_run", F.sum("_broke").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_last", F.max("_run").over(Window.partitionBy(*part)))
    )
    joined = marked.groupBy(*part, "_run", "_last").agg(
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.sum("_sum").alias("_sum"),
        F.min("min_price").alias("min_price"),
        F.sum("hours_count").alias("hours_count"),
    )
    inside = (F.col("_run") > 0) & (F.col("_run") < F.col("_last"))
    return joined.withColumn("_done", F.col("_done") | inside).drop("_run", "_last", "_bucket")


def sessions(df: DataFrame, *, keys: list[str], ts: str, value: str, gap_seconds: int,
             levels: tuple[str, ...] = ("day", "month", "year")) -> DataFrame:
    """Aggregate runs: start, end, mean, minimum and number of rows.

    Runs are found within each (key, day), then runs that touch are joined
    within each (key, month) and (key, year), then across years.  From each bucket only
    the first and the last run are compared with those of other buckets, so a task
    sees a day of rows, two runs a day of a month, two runs a month of a year, and in the last
    step two runs a year of one key.
    """
    runs = df.select(
        *keys,
        F.col(ts).cast("timestamp").alias("window_start"),
        F.col(ts).cast("timestamp").alias("window_end"),
        F.col(value).alias("_sum"),
        F.col(value).alias("min_price"),
        F.lit(1).cast("bigint").alias("hours_count"),
        F.lit(False).alias("_done"),
    )
    for bucket in (*levels, None):
        runs = _join_runs(runs, keys, bucket, gap_seconds)
    return runs.select(
        *keys, "window_start", "window_end", (F.col("_sum") / F.col("hours_count")).alias("avg_price"),
        "min_price", "hours_count",
    )


def negative_windows(prices: DataFrame, *, gap_seconds: int = V.SESSION_GAP_SECONDS,
                     keys: list[str] = ("market",), ts: str = "delivery_ts",
                     value: str = "price_eur_mwh") -> DataFrame:
    """Spells of consecutive negative hours; ``window_end`` is the start of the last hour."""
    return sessions(prices.filter("is_negative"), keys=list(keys), ts=ts, value=value, gap_seconds=gap_seconds)


def imbalance_trigger(periods: DataFrame, *, period_seconds: int, ratio: float = V.IMBALANCE_RATIO,
                      min_periods: int = V.IMBALANCE_PERIODS) -> DataFrame:
    """Spells of at least ``min_periods`` consecutive periods priced above ``ratio`` times day-ahead."""
    flagged = periods.filter(F.col("imbalance_price") > F.lit(ratio) * F.col("price_eur_mwh"))
    runs = sessions(flagged, keys=["market"], ts="delivery_ts", value="imbalance_price", gap_seconds=period_seconds)
    return runs.filter(F.col("hours_count") >= min_periods).select(
        "market", "window_start", "window_end", F.col("hours_count").alias("periods"),
        F.col("avg_price").alias("avg_imbalance_price"),
    )



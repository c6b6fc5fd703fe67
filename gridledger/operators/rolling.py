"""Row and time frames over long series with few keys.

A plain window over ``partitionBy(market)`` puts a whole market into one task.  Here a series is cut
into blocks that are windowed one by one: for row frames, so many rows by their place in the series,
and the last rows of the block before; for time frames, calendar blocks with the block before.  The
result is exactly that of the plain window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..session import written
from .joins import join_same


def with_blocks(df: DataFrame, *, keys: list[str], ts: str, block_rows: int, halo_rows: int) -> DataFrame:
    """Rows with ``_place`` in their series, ``_block`` and ``_own``; a block's last rows appear in the next one too, not owned.

    The table is sorted into ranges by key and time, however many rows a day or an instant has, and written,
    so that a row number holds.  A row's place is its number within its key and range, and what the ranges
    before have of the key: only those counts are windowed as a whole.  A block of ``block_rows`` places, more than
    ``halo_rows``, hands its last ``halo_rows`` on.  A NULL key or time sorts first and stays.
    """
    ranged = df.repartitionByRange(*keys, ts).sortWithinPartitions(*keys, ts).withColumn("_row", F.monotonically_increasing_id())
    rows = written(ranged, "ranged").withColumn("_range", F.shiftright("_row", 33))
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    placed = join_same(rows, starts, [*keys, "_range"]).withColumn("_place", F.col("_row") + F.col("_start")).drop("_row", "_range", "_start")
    home = F.floor(F.col("_place") / block_rows)
    handed = F.col("_place") % block_rows >= block_rows - halo_rows
    return placed.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(handed, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    ).withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")


def partitioned_rolling(df: DataFrame, *, keys: list[str], ts: str, frames: dict[str, tuple[Column, int]],
                        block_rows: int = 4096) -> DataFrame:
    """Add trailing row-frame aggregates: ``frames`` maps a name to (aggregate, frame length in rows)."""
    halo = max(n for _, n in frames.values()) - 1
    blocks = with_blocks(df, keys=keys, ts=ts, block_rows=max(block_rows, halo + 1), halo_rows=halo)
    w = Window.partitionBy(*keys, "_block").orderBy("_place")
    added = {name: agg.over(w.rowsBetween(1 - n, 0)) for name, (agg, n) in frames.items()}
    return blocks.withColumns(added).filter("_own").drop("_block", "_own", "_place")


def hourly_price_features(prices: DataFrame, *, keys: list[str] = ("market",), ts: str = "delivery_ts",
                          value: str = "price_eur_mwh", short: int = V.SHORT_WINDOW_ROWS,
                          long: int = V.LONG_WINDOW_ROWS, z: float = V.VOLATILITY_Z,
                          block_rows: int = 4096) -> DataFrame:
    """Rolling means and sample deviation over the last 24 and 168 rows, and the volatility flag.

    Both frames share one order, so the windows need one shuffle and one sort.
    The deviation of a first row is NULL, and so is its flag.
    """
    out = partitioned_rolling(
        prices, keys=list(keys), ts=ts, block_rows=block_rows,
        frames={
            "rolling_avg_24h": (F.avg(value), short),
            "rolling_avg_7d": (F.avg(value), long),
            "rolling_stddev_24h": (F.stddev_samp(value), short),
        },
    )
    off = F.col(value) - F.col("rolling_avg_7d")
    return out.select(
        ts, "delivery_date", "hour", *keys, value, "is_negative",
        "rolling_avg_24h", "rolling_avg_7d", "rolling_stddev_24h",
        off.alias("price_vs_7d_avg"),
        (F.abs(off) > F.lit(z) * F.col("rolling_stddev_24h")).alias("volatility_flag"),
    )


def time_rolling(df: DataFrame, *, keys: list[str], ts: str, aggregates: dict[str, tuple[Column, int]],
                 block_days: int | None = None) -> DataFrame:
    """Trailing time-frame aggregates: ``aggregates`` maps a name to (aggregate, days).

    A frame covers the ``days`` up to and including the row.  Series are cut into
    calendar blocks at least as long as the longest frame, so a row's frame
    touches its own block and the one before: each row is sent to two blocks.  Rows without
    a time are each other's frame.
    """
    span = max(days for _, days in aggregates.values())
    second = F.unix_timestamp(ts)
    placed = _calendar_blocks(df, ts, max(block_days or span, span))
    w = Window.partitionBy(*keys, "_block").orderBy(second)
    added = {n: agg.over(w.rangeBetween(1 - days * 86_400, 0)) for n, (agg, days) in aggregates.items()}
    return placed.withColumns(added).filter(F.col("_block").eqNullSafe(F.col("_home"))).drop("_block", "_home")


def _calendar_blocks(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows in the calendar block ``_home`` of their time and in the next one; without a time, once, in a block of their own."""
    placed = df.withColumn("_home", F.floor(F.unix_timestamp(ts) / (days * 86_400)))
    blocks = F.when(F.col("_home").isNull(), F.array("_home")).otherwise(F.array("_home", F.col("_home") + 1))
    return placed.withColumn("_block", F.explode(blocks))


def feat_rolling_30_90(prices: DataFrame, *, short_days: int = 30, long_days: int = 90) -> DataFrame:
    mean, dev = F.avg("price_eur_mwh"), F.stddev_samp("price_eur_mwh")
    return time_rolling(
        prices, keys=["market"], ts="delivery_ts",
        aggregates={
            "rolling_30d_mean": (mean, short_days), "rolling_30d_std": (dev, short_days),
            "rolling_90d_mean": (mean, long_days), "rolling_90d_std": (dev, long_days),
        },
    ).select("market", "delivery_ts", "price_eur_mwh", "rolling_30d_mean", "rolling_30d_std",
             "rolling_90d_mean", "rolling_90d_std")


def feat_percentile_90d(prices: DataFrame, *, days: int = 90) -> DataFrame:
    """Share of the prices of the last ``days`` days (this hour included) that are not above this hour's.

    A task holds two calendar blocks of a market as columns and counts all its rows at once
    (``counts_at_most``); no row carries its frame.  Rows without a time are each other's frame; a row
    without a price, which counts in no frame, has none.
    """
    span = days * 86_400

    def rank(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_second", kind="stable", na_position="first")
        price = batch["price_eur_mwh"].to_numpy(dtype=float, na_value=np.nan)
        known = ~np.isnan(price)
        second = np.nan_to_num(batch["_second"].to_numpy(dtype=float)[known], nan=0.0)
        low, high = np.searchsorted(second, second - span, side="right"), np.searchsorted(second, second, side="right")
        share = np.full(len(batch), np.nan)
        if known.any():
            share[known] = counts_at_most(price[known], low, high) / (high - low)
        return batch.assign(share=share)[batch["_own"]][["market", "delivery_ts", "price_eur_mwh", "share"]]

    blocks = _calendar_blocks(prices.select("market", "delivery_ts", "price_eur_mwh"), "delivery_ts", days)
    kinds = [prices.schema[c] for c in ("market", "delivery_ts", "price_eur_mwh")]
    ranked = blocks.withColumns({
        "_second": F.unix_timestamp("delivery_ts").cast("double"), "_own": F.col("_block").eqNullSafe(F.col("_home")),
    }).groupBy("market", "_block").applyInPandas(rank, T.StructType([*kinds, T.StructField("share", T.DoubleType())]))
    return ranked.select("market", "delivery_ts", "price_eur_mwh", F.nanvl("share", F.lit(None).cast("double")).alias("price_percentile_90d"))


def counts_at_most(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each i, how many of ``values[low[i]:high[i]]`` are at most ``values[i]``.

    A wavelet matrix over the ranks: per bit of a rank, all frames are followed at once, with running
    counts of the zeros, so the work is a number of passes that grows with the logarithm of the length.
    """
    rank = np.unique(values, return_inverse=True)[1].reshape(-1)
    bound, low, high, found = rank + 1, low.copy(), high.copy(), np.zeros(len(values), np.int64)
    for bit in range(int(bound.max()).bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        z_low, z_high = zeros[low], zeros[high]
        up = (bound >> bit & 1).astype(bool)
        found += np.where(up, z_high - z_low, 0)
        low, high = np.where(up, zeros[-1] + low - z_low, z_low), np.where(up, zeros[-1] + high - z_high, z_high)
        rank = np.concatenate([rank[~one], rank[one]])
    return found


def daily_neg_count(prices: DataFrame) -> DataFrame:
    return (
        prices.groupBy("market", "delivery_date")
        .agg(F.count_if("is_negative").alias("neg_hours_per_day"))
    )


def rolling_90d_neg(daily: DataFrame, *, rows: int = 90, min_obs: int = 30) -> DataFrame:
    """Sum over the last ``rows`` days present, NULL before ``min_obs`` of them (one row per day and market)."""
    w = Window.partitionBy("market").orderBy("delivery_date").rowsBetween(1 - rows, 0)
    total = F.when(F.count(F.lit(1)).over(w) >= min_obs, F.sum("neg_hours_per_day").over(w))
    return daily.withColumn("rolling_90d", total)

"""Streaming twins: incremental ingest, bounded-state dedupe, windows, late rows, keyed merge.

Every query takes its checkpoint from the caller, so it resumes after a loss of
executors or of the driver, and every stateful operator has a watermark, so
its state does not grow with the stream.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as V
from ..operators.quality import expect
from ..operators.silver import latest_by_key
from ..sources.snapshots import upsert

MARKET_REFRESH = {"processingTime": "15 minutes"}
DRAIN = {"availableNow": True}


def append_stream(df: DataFrame, path: str, *, checkpoint: str, trigger: dict = DRAIN,
                  partition_by: list[str] = ()) -> StreamingQuery:
    """Append a stream to a parquet table; each input row is written once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**trigger).start(path)


def batch_folders(df: DataFrame, path: str, *, checkpoint: str, trigger: dict = DRAIN) -> StreamingQuery:
    """Write each micro-batch to its own folder ``batch=N`` of ``path``; a replayed batch overwrites its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def observed(query: StreamingQuery, name: str) -> dict[str, int]:
    """Sums of the counts that the batches of a query's recent progress observed under ``name``."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        counts = progress.observedMetrics.get(name)
        for key, n in counts.asDict().items() if counts else ():
            total[key] = total.get(key, 0) + int(n)
    return total


def checked_rows(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    return expect(df, rules, action="drop")


def stream_dedupe(events: DataFrame, *, key: list[str] = ("event_id",), event_time: str = "start_time",
                  delay: str = "7 days") -> DataFrame:
    """First delivery of each event; re-deliveries within ``delay`` of event time are dropped."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def stream_tumbling_negative(prices: DataFrame, *, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Mean, minimum and count of negative prices per market and tumbling window."""
    negative = prices.filter("is_negative").withWatermark("delivery_ts", delay)
    grouped = negative.groupBy(F.window("delivery_ts", width).alias("_w"), "market").agg(
        F.avg("price_eur_mwh").alias("avg_negative_price"),
        F.min("price_eur_mwh").alias("min_price"),
        F.count(F.lit(1)).alias("negative_hours_in_window"),
    )
    return grouped.select(
        "market", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        "avg_negative_price", "min_price", "negative_hours_in_window",
    )


def stream_session_negative(prices: DataFrame, *, gap_seconds: int = V.SESSION_GAP_SECONDS,
                            delay: str = "2 hours") -> DataFrame:
    """Spells of consecutive negative hours, emitted once no later row can extend them."""
    negative = prices.filter("is_negative").withWatermark("delivery_ts", delay)
    grouped = negative.groupBy(
        F.session_window("delivery_ts", f"{gap_seconds} seconds").alias("_w"), "market"
    ).agg(
        F.max("delivery_ts").alias("window_end"),
        F.avg("price_eur_mwh").alias("avg_price"),
        F.min("price_eur_mwh").alias("min_price"),
        F.count(F.lit(1)).alias("hours_count"),
    )
    return grouped.select(
        "market", F.col("_w.start").alias("window_start"), "window_end", "avg_price", "min_price", "hours_count"
    )


def split_batch(batch: DataFrame, batch_id: int, *, event_time: str, delay: str, path: str, late_path: str, bounds: str) -> None:
    """Write one batch of ``split_late`` into its own folders; written twice it leaves the same."""
    kind, own = batch.schema[event_time].dataType, f"batch_id={batch_id}"
    try:
        past = batch.sparkSession.read.parquet(bounds).filter(F.col("batch_id") < batch_id)
        bound = past.agg(F.max("newest").alias("newest")).first()["newest"]
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
            raise
        bound = None
    limit = F.lit(bound).cast(kind) - F.expr(f"INTERVAL {delay}")
    late = F.coalesce(F.col(event_time) < limit, F.lit(False))
    batch.filter(late).write.mode("overwrite").parquet(f"{late_path}/{own}")
    batch.filter(~late).write.mode("overwrite").parquet(f"{path}/{own}")
    batch.agg(F.max(event_time).alias("newest")).write.mode("overwrite").parquet(f"{bounds}/{own}")


def split_late(df: DataFrame, *, event_time: str, delay: str, path: str, late_path: str, checkpoint: str,
               trigger: dict = DRAIN) -> StreamingQuery:
    """Write rows in time to ``path`` and rows that come too late to ``late_path``, each batch in its ``batch_id`` folder.

    Too late means more than ``delay`` behind the newest row of earlier
    batches.  That bound is kept as one row per batch beside the checkpoint, so
    neither table is read back and a restart does not forget it.  A batch that is
    replayed looks at earlier batches only and writes its own folders again.
    """
    write = functools.partial(
        split_batch, event_time=event_time, delay=delay, path=path, late_path=late_path,
        bounds=f"{checkpoint.rstrip('/')}-bounds",
    )
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows the stateful operators of a query dropped as too late so far."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )


def stream_upsert(df: DataFrame, path: str, *, key: list[str], checkpoint: str, order: list[str] = (),
                  trigger: dict = DRAIN) -> StreamingQuery:
    """Merge each micro-batch into the keyed table at ``path``.

    Of rows of a batch with the same key the latest by ``order`` is merged; without
    ``order`` a repeated key fails the batch.  Merging a batch twice gives the same
    table, so a replay after a failure is harmless.
    """
    def merge(batch: DataFrame, _batch_id: int) -> None:
        rows = latest_by_key(batch, keys=list(key), order=list(order)) if order else batch
        upsert(batch.sparkSession, path, rows, key=key)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_to_end(*queries: StreamingQuery) -> None:
    """Wait for queries started with an available-now trigger; raises what they raised."""
    for query in queries:
        query.awaitTermination()


def parquet_stream(spark: SparkSession, path: str, schema, *, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)

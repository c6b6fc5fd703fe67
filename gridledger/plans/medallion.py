"""Raw files to raw, conformed and derived tables, as a batch or as streams.

A lake holds ``bronze`` (rows as delivered, kept for good), ``silver`` (conformed), ``gold``
(derived) and ``metrics`` (rule counts).  Streamed tables are one folder a micro-batch,
``batch=N``, that a replay of the batch writes again; ``read_table`` reads them whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import schemas as S
from ..operators import gold, rolling, sections
from ..operators.quality import expect
from ..operators.silver import latest_by_key, silver_congestion, silver_generation, silver_imbalance, silver_prices
from ..sources.envelopes import RESCUED, read_envelopes
from ..sources.files import METADATA_TASKS, read_documents
from ..streaming.feeds import DRAIN, append_stream, batch_folders, run_to_end

FEEDS = {
    "prices": (S.PRICE_ENVELOPE, silver_prices, V.PRICE_RULES),
    "generation": (S.GENERATION_ENVELOPE, silver_generation, V.GENERATION_RULES),
    "congestion": (S.CONGESTION_ENVELOPE, silver_congestion, V.CONGESTION_RULES),
    "imbalance": (S.IMBALANCE_ENVELOPE, silver_imbalance, V.IMBALANCE_RULES),
}
#: The feeds of a run that names none.
CORE = ("prices", "generation", "congestion")
Extractor = Callable[[bytes], Iterable[tuple[int, str]]]
#: Files whose metadata one task writes, where a batch has a bound.
FILES_PER_TASK = 1000


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of the lake without the column that names its batches."""
    df = spark.read.parquet(path)
    return df.drop("batch") if "batch" in df.columns else df


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if not {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"} & {(missing.getCondition() or "").split(".")[0]}:
            raise
        return None


# --- price, generation and congestion feeds -------------------------------------------------------


def append_raw(spark: SparkSession, in_dir: str, out_dir: str, feeds: Iterable[str] = CORE) -> None:
    """Append the envelopes of files that the raw tables do not hold yet; what is there is never rewritten.

    A line that is no envelope keeps its text in ``_rescued``.
    """
    for name in feeds:
        schema = FEEDS[name][0]
        raw = read_envelopes(spark, f"{in_dir}/{name}", schema=schema, rescue=True)
        seen = _known(spark, f"{out_dir}/bronze/{name}")
        if seen is not None:
            raw = raw.join(seen.select("_source_file").distinct(), "_source_file", "left_anti").select(*seen.columns)
        raw.write.mode("append").parquet(f"{out_dir}/bronze/{name}")


def conformed(name: str, raw: DataFrame) -> DataFrame:
    """The conformed rows of a feed's raw rows; rows that break a rule are left out."""
    _schema, parse, rules = FEEDS[name]
    return expect(parse(raw), rules)


def repaired(name: str, raw: DataFrame, repair: Callable[[Column], Column]) -> DataFrame:
    """Raw rows with those that could not be read parsed again after ``repair`` of their text; NULL gives a row up."""
    schema = FEEDS[name][0]
    again = raw.filter(F.col(RESCUED).isNotNull()).withColumn("_row", F.from_json(repair(F.col(RESCUED)), schema))
    fixed = again.filter(F.col("_row").isNotNull()).select(
        *[F.col(f"_row.{f.name}").alias(f.name) if f.name in schema.fieldNames() else f.name for f in raw.schema]
    )
    return raw.filter(F.col(RESCUED).isNull()).unionByName(fixed)


def rebuild(spark: SparkSession, out_dir: str, name: str, *, repair: Callable[[Column], Column] | None = None) -> None:
    """Make a conformed table anew from its raw table, after a parser fix; the tables derived from it follow.

    Run it between drains of the streams: the next one adds what is new since.
    """
    raw = spark.read.parquet(f"{out_dir}/bronze/{name}")
    rows = conformed(name, raw if repair is None else repaired(name, raw, repair))
    _replace(rows, f"{out_dir}/silver/{name}")
    finish(spark, out_dir)


def _replace(rows: DataFrame, path: str) -> None:
    """All rows as the first batch; those of streams to come are later ones."""
    rows.withColumn("batch", F.lit(0)).write.mode("overwrite").partitionBy("batch").parquet(path)
    rows.limit(0).write.mode("append").parquet(f"{path}/batch=0")  # a table without rows still has its columns


# --- contract documents ---------------------------------------------------------------------------


def plain_text(content: bytes) -> list[tuple[int, str]]:
    """Lines of a UTF-8 text as blocks; a form feed begins a page."""
    pages = content.decode("utf-8").split("\f")
    return [(number, line) for number, page in enumerate(pages, 1) for line in page.split("\n") if line]


def write_document_batch(files: DataFrame, batch: int | str, *, out_dir: str, extractor: Extractor, attempt: int = 0,
                         chunked: Callable[[DataFrame], DataFrame] | None = None, most: int | None = None) -> None:
    """One batch of document files to raw metadata, decoded blocks, tagged chunks and rule counts.

    Each goes to the batch's own folder, so that a batch written twice leaves the same.  A
    file that can not be decoded keeps a row with the error and NULL blocks.  Of files with one contract id the
    latest of the batch is decoded.  ``chunked`` makes the chunks; a stream builds it once for all its batches.
    ``most`` is the number of files that a batch has at most, if it has a bound.
    """
    spark, own = files.sparkSession, f"batch={batch}"
    tasks = METADATA_TASKS if most is None else min(METADATA_TASKS, -(-most // FILES_PER_TASK))
    meta = files.drop("content").withColumn("attempt", F.lit(attempt)).coalesce(tasks)
    meta.write.mode("overwrite").parquet(f"{out_dir}/bronze/documents/{own}")
    latest = latest_by_key(spark.read.schema(meta.schema).parquet(f"{out_dir}/bronze/documents/{own}"), keys=["contract_id"], order=["last_modified", "path"])
    chosen = files.join(latest.select("path", "last_modified"), ["path", "last_modified"], "left_semi")
    decoded = sections.extract_blocks(chosen, extractor=extractor)
    decoded.write.mode("overwrite").parquet(f"{out_dir}/silver/contract_blocks/{own}")
    blocks = spark.read.schema(decoded.schema).parquet(f"{out_dir}/silver/contract_blocks/{own}")
    seen = Observation()
    chunks = (chunked or sections.chunker())(blocks.filter(F.col("error").isNull()))
    expect(chunks, V.CHUNK_RULES, action="warn", observation=seen).write.mode("overwrite").parquet(f"{out_dir}/silver/contract_chunks/{own}")
    counts = [F.struct(F.lit(rule).alias("rule"), F.lit(int(n)).cast("long").alias("failed")) for rule, n in seen.get.items()]
    # Literals in one task: rows from a list would go through Python workers, slice by slice.
    metrics = spark.range(0, 1, 1, 1).select(F.lit("contract_chunks").alias("table"), F.inline(F.array(*counts)))
    metrics.write.mode("overwrite").parquet(f"{out_dir}/metrics/{own}")


def drain_documents(spark: SparkSession, in_dir: str, out_dir: str, *, extractor: Extractor, trigger: dict = DRAIN, **reading) -> None:
    """Document files that are new in the folder ``contracts`` or below, as micro-batches.

    A path is read once: a new version of a contract comes under a new path, with the same file name.
    """
    files = read_documents(spark, f"{in_dir}/contracts", stream=True, content=True, **reading)
    write = functools.partial(
        write_document_batch, out_dir=out_dir, extractor=extractor, chunked=sections.chunker(), most=reading.get("max_files")
    )
    run_to_end(files.writeStream.foreachBatch(write).option("checkpointLocation", f"{out_dir}/_checkpoints/documents").trigger(**trigger).start())


_META = "path string, last_modified timestamp, file_size_bytes long, contract_id string, ingestion_ts timestamp, attempt int, batch string"


def current_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest file of each contract, with the batch that holds its blocks and chunks."""
    every = spark.read.schema(_META).parquet(f"{out_dir}/bronze/documents")
    return latest_by_key(every, keys=["contract_id"], order=["last_modified", "attempt", "path"])


def _of_current(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    batch = spark.read.parquet(f"{out_dir}/silver/{name}")
    rows = batch.withColumn("batch", F.col("batch").cast("string"))
    return rows.join(current_documents(spark, out_dir).select("contract_id", "batch"), ["contract_id", "batch"], "left_semi").drop("batch")


def contract_chunks(spark: SparkSession, out_dir: str) -> DataFrame:
    """Tagged chunks of the latest file of each contract."""
    return _of_current(spark, out_dir, "contract_chunks").select(*[f.name for f in S.CHUNK])


def document_errors(spark: SparkSession, out_dir: str) -> DataFrame:
    """Contracts whose latest file could not be decoded, with the error."""
    return _of_current(spark, out_dir, "contract_blocks").filter(F.col("error").isNotNull()).select("contract_id", "error")


def replay_documents(spark: SparkSession, in_dir: str, out_dir: str, *, extractor: Extractor, **reading) -> None:
    """Decode the files that failed once more, with a mended decoder, as a batch of their own."""
    latest = current_documents(spark, out_dir)
    failed = latest.join(document_errors(spark, out_dir), "contract_id")
    attempt = (latest.agg(F.max("attempt")).first()[0] or 0) + 1
    files = read_documents(spark, f"{in_dir}/contracts", content=True, **reading).join(failed.select("path"), "path", "left_semi")
    write_document_batch(files, f"replay-{attempt}", out_dir=out_dir, extractor=extractor, attempt=attempt)


# --- runs -------------------------------------------------------------------------------------------


def derived(prices: DataFrame, generation: DataFrame) -> dict[str, DataFrame]:
    """The derived tables; re-delivered rows are reduced to the latest first."""
    prices = latest_by_key(prices, keys=["market", "delivery_ts"], order=["ingestion_ts"])
    generation = latest_by_key(generation, keys=["delivery_ts"], order=["ingestion_ts"])
    signals = gold.market_risk_signals(prices, generation)
    return {
        "market_risk_signals": signals,
        "hourly_price_features": rolling.hourly_price_features(prices),
        "portfolio_exposure_daily": gold.portfolio_exposure_daily(signals),
    }


def run(
    spark: SparkSession, in_dir: str, out_dir: str, *, extractor: Extractor | None = None, feeds: Iterable[str] = CORE, **reading
) -> None:
    """One batch run over all files: raw tables take what is new, the others are made from them.

    With ``extractor`` the folder ``contracts`` is read too; ``reading`` goes to ``read_documents``.
    """
    append_raw(spark, in_dir, out_dir, feeds)
    for name in feeds:
        _replace(conformed(name, spark.read.parquet(f"{out_dir}/bronze/{name}")), f"{out_dir}/silver/{name}")
    if extractor is not None:
        files = read_documents(spark, f"{in_dir}/contracts", content=True, **reading)
        write_document_batch(files, 0, out_dir=out_dir, extractor=extractor)
    finish(spark, out_dir)


def run_streams(
    spark: SparkSession, in_dir: str, out_dir: str, *, trigger: dict = DRAIN, extractor: Extractor | None = None,
    feeds: Iterable[str] = CORE, **reading
) -> None:
    """Drain the raw folders into the raw and conformed tables, then recompute the derived ones.

    Started again, it picks up only files that are new.  Congestion events come in many
    deliveries, and the latest counts: the conformed table is made from all raw rows, as in
    the batch.  Documents go from files to chunks in one step a micro-batch.
    """
    raw = [
        append_stream(
            read_envelopes(spark, f"{in_dir}/{name}", schema=FEEDS[name][0], stream=True, rescue=True), f"{out_dir}/bronze/{name}",
            checkpoint=f"{out_dir}/_checkpoints/raw-{name}", trigger=trigger,
        )
        for name in feeds
    ]
    run_to_end(*raw)
    if extractor is not None:
        drain_documents(spark, in_dir, out_dir, extractor=extractor, trigger=trigger, **reading)
    run_to_end(*[
        batch_folders(
            conformed(name, spark.readStream.schema(spark.read.parquet(f"{out_dir}/bronze/{name}").schema).parquet(f"{out_dir}/bronze/{name}")),
            f"{out_dir}/silver/{name}", checkpoint=f"{out_dir}/_checkpoints/{name}", trigger=trigger,
        )
        for name in feeds if name != "congestion"
    ])
    if "congestion" in feeds:
        _replace(conformed("congestion", spark.read.parquet(f"{out_dir}/bronze/congestion")), f"{out_dir}/silver/congestion")
    finish(spark, out_dir)


def finish(spark: SparkSession, out_dir: str) -> None:
    tables = derived(read_table(spark, f"{out_dir}/silver/prices"), read_table(spark, f"{out_dir}/silver/generation"))
    for name, df in tables.items():
        # A date's rows (hours per market) go to one file, not one file per task.
        df.repartition("delivery_date").write.mode("overwrite").partitionBy("delivery_date").parquet(f"{out_dir}/gold/{name}")

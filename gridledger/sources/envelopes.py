"""Raw feeds: JSON envelopes whose payload is a JSON array in a string field."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.joins import join_same

#: Column with the text of a line that could not be read.
RESCUED = "_rescued"


def read_envelopes(spark: SparkSession, path: str, *, schema: T.StructType = S.PRICE_ENVELOPE,
                   stream: bool = False, max_files: int | None = None, rescue: bool = False) -> DataFrame:
    """Envelopes with the time they were read and the file they came from.

    As a stream, a directory is read incrementally: each file once.  With ``rescue`` a line
    that is no envelope keeps its text in a column ``_rescued``, NULL for all others.
    """
    if rescue:
        schema = T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if rescue:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RESCUED)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumns({
        "_ingested_at": F.current_timestamp(), "_source_file": F.col("_metadata.file_path"),
    })


def infer_envelope_schema(spark: SparkSession, path: str) -> str:
    """Schema of the files at ``path`` as JSON text, to be kept and given to later reads."""
    return spark.read.json(path).schema.json()


def load_schema(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def daily_envelopes(df: DataFrame, *, date_col: str = "delivery_date", order_by: list[str],
                    keys: list[str] = (), constants: dict[str, Column] | None = None,
                    ingestion_ts: Column | None = None, max_rows: int | None = None) -> DataFrame:
    """Group rows by day (and ``keys``) into envelopes, rows in ``order_by`` order inside.

    Hourly feeds hold a few dozen rows per day and key.  For feeds without such
    a bound give ``max_rows``: a day is spread, by a hash of the order columns, over
    as many envelopes as its own number of rows needs to keep them to about that many
    rows each.  Other days play no part in that.
    """
    payload = [c for c in df.columns if c != date_col]
    rest = [c for c in payload if c not in order_by]
    item = F.struct(*order_by, *rest)
    part = F.lit(0)
    if max_rows is not None:
        day = [date_col, *keys]
        df = join_same(df, df.groupBy(*day).agg(F.ceil(F.count(F.lit(1)) / max_rows).alias("_parts")), day)
        part = F.pmod(F.xxhash64(*order_by), F.col("_parts"))
    grouped = df.groupBy(F.col(date_col).alias("_day"), *keys, part.alias("_part")).agg(
        F.sort_array(F.collect_list(item)).alias("_rows")
    )
    fields = {name: value for name, value in (constants or {}).items()}
    stamp = F.current_timestamp() if ingestion_ts is None else ingestion_ts
    return grouped.select(
        *[v.alias(n) for n, v in fields.items()],
        *keys,
        F.col("_day").cast("string").alias("fetch_date"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ingestion_ts"),
        F.to_json("_rows").alias("raw_payload"),
    )


def write_daily_envelopes(envelopes: DataFrame, path: str) -> None:
    """Write envelopes under one folder per day; the date also stays a field of the file."""
    envelopes.withColumn("day", F.col("fetch_date")).write.mode("append").partitionBy("day").json(path)

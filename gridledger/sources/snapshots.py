"""Keyed tables on plain parquet: merge, snapshots, and the difference of two snapshots."""

from __future__ import annotations

import functools
import operator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unique_source(source: DataFrame, key: list[str]) -> DataFrame:
    """The same rows; the job fails if a key occurs twice.

    Duplicates meet in a partial aggregate, so a key with very many copies is
    one row per task by the time it is shuffled.
    """
    rest = [c for c in source.columns if c not in key]
    counted = source.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*rest)).alias("_row"))
    message = F.concat(F.lit("several source rows for key "), F.concat_ws(",", *[F.col(k).cast("string") for k in key]))
    row = F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_row"))
    checked = counted.select(*key, row.alias("_row"))
    return checked.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in source.columns])


def upsert_anti_join(target: DataFrame, source: DataFrame, *, key: list[str]) -> DataFrame:
    """The target rows a merge leaves alone; a NULL in a key matches a NULL."""
    gone = source.select(*[F.col(k).alias(f"_source_{k}") for k in key])
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_source_{k}")) for k in key])
    return target.join(gone, same, "left_anti")


def upsert_union(target: DataFrame, source: DataFrame, *, key: list[str]) -> DataFrame:
    """Target after a merge: matched keys take the source row, unmatched source rows are added."""
    return upsert_anti_join(target, source, key=key).unionByName(unique_source(source, key).select(*target.columns))


#: Buckets of a new table.  Each merge reads and writes the buckets that its keys fall into.
BUCKETS = 16
_COLUMN = "_bucket_of_"


def _bucket(columns: list[str]) -> str | None:
    """The partition column of a keyed table; its name ends in the number of buckets."""
    return next((c for c in columns if c.startswith(_COLUMN)), None)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if (missing.getCondition() or "").split(".")[0] not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    table = _table(spark, path)
    if table is None:
        raise FileNotFoundError(path)
    return table.drop(_bucket(table.columns))


def upsert(spark: SparkSession, path: str, source: DataFrame, *, key: list[str], buckets: int = BUCKETS) -> None:
    """Merge ``source`` into the Parquet table at ``path``, partitioned by a hash of the key.

    A merge reads and overwrites only the partitions that a source key falls into; later merges follow the
    number of buckets the table was made with.  Spark writes all new partitions aside and
    moves them in when the job commits; a merge that fails before leaves the table as it was, and one that is run
    again gives the same table.  One writer at a time.
    """
    table = _table(spark, path)
    name = _bucket(table.columns) if table is not None else f"{_COLUMN}{buckets}"
    n = int(name.removeprefix(_COLUMN))
    # As text, so that a key hashes alike whatever integer type a batch brings.
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(n)).cast("int")
    if table is None:
        merged = unique_source(source, key)
    else:
        touched = source.select(bucket.alias(name)).distinct()
        merged = upsert_union(table.join(touched, name, "left_semi").drop(name), source, key=key)
    writer = merged.withColumn(name, bucket).repartition(name).write.option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").partitionBy(name).parquet(path)
    if table is None:  # an empty table still has its columns
        merged.limit(0).write.mode("append").parquet(f"{path.rstrip('/')}/{name}=0")


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: list[str]) -> DataFrame:
    """Change rows between two snapshots: ``_change`` is insert, update or delete; a NULL in a key equals a NULL.

    Only keys and a 64-bit hash per row meet in the join, plus the new row for
    output; deleted rows carry NULLs outside the key.  The hash covers which
    columns are NULL, as hashing alone passes over them.
    """
    rest = [c for c in new.columns if c not in key]
    marked = [x for c in rest for x in (F.col(c).isNull(), F.col(c))]
    a = old.select(*[F.col(k).alias(f"_old_{k}") for k in key], F.xxhash64(F.lit(0), *marked).alias("_old"))
    b = new.select(*key, F.xxhash64(F.lit(0), *marked).alias("_new"), *rest)
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in key])
    change = (
        F.when(F.col("_old").isNull(), F.lit("insert"))
        .when(F.col("_new").isNull(), F.lit("delete"))
        .when(F.col("_old") != F.col("_new"), F.lit("update"))
    )
    named = [F.when(F.col("_new").isNull(), F.col(f"_old_{k}")).otherwise(F.col(k)).alias(k) for k in key]
    return a.join(b, same, "full_outer").withColumn("_change", change).filter(F.col("_change").isNotNull()).select(*named, "_change", *rest)


def apply_changes(derived: DataFrame, changes: DataFrame, make, *, key: list[str]) -> DataFrame:
    """A table derived row by row from another, after the changes of that one (``snapshot_diff``).

    ``make`` derives rows from source rows; only inserted and updated ones go through it.  Rows of
    changed and deleted keys are taken out, NULL keys included; all others stay as they are.
    """
    kept = upsert_anti_join(derived, changes.select(*key), key=key)
    made = make(changes.filter(F.col("_change") != "delete").drop("_change"))
    return kept.unionByName(made.select(*derived.columns))

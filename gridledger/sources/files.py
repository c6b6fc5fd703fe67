"""Plain file sources: documents, chunk tables, CSV prices, evaluation items, HTML tables."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterable, Sequence
from html.entities import name2codepoint
from urllib.parse import unquote, urlsplit

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"
#: Tasks that read the metadata of files, however many files there are.  A task otherwise gets a few
#: files, whatever they hold, because opening a file counts as reading megabytes.
METADATA_TASKS = 256
#: Folders that the folders of written texts are dealt to: each is listed by a task of its own.
TEXT_FOLDERS = 256
#: The folder of texts without a key, as Spark's writers name it.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def read_documents(spark: SparkSession, path: str, *, stream: bool = False, glob: str = "*.pdf",
                   keep: list[str] | DataFrame | None = None, content: bool = False,
                   id_pattern: str | None = None, max_files: int | None = None) -> DataFrame:
    """Document files as (path, last_modified, file_size_bytes, contract_id, ingestion_ts).

    The contract id is the file's stem, or the first group of ``id_pattern`` in its path.
    File contents are read only with ``content``; without it many files share a task.  ``keep``
    restricts to the named contract ids; a long list comes as a frame with a contract_id column.
    """
    reader = (spark.readStream.schema(_BINARY) if stream else spark.read).format("binaryFile")
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    suffix = glob.rsplit(".", 1)[-1]
    out = files.select(
        "path",
        F.col("modificationTime").alias("last_modified"),
        F.col("length").alias("file_size_bytes"),
        F.regexp_extract("path", id_pattern or rf"([^/]+)\.{suffix}$", 1).alias("contract_id"),
        F.current_timestamp().alias("ingestion_ts"),
        *(["content"] if content else []),
    )
    if not content:
        out = out.coalesce(METADATA_TASKS)
    if isinstance(keep, DataFrame):
        return out.join(keep.select("contract_id"), "contract_id", "left_semi")
    return out.filter(F.col("contract_id").isin(keep)) if keep else out


def _shared_disk(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme if it is on a disk that all machines mount; None for another store."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    found = urlsplit(path)
    local = (found.scheme or urlsplit(default).scheme) == "file"
    return unquote(found.path) if found.scheme and local else path if local else None


def _write_lines(rows: Iterable, *, path: str, key: str) -> None:
    """Rows of (folder, key, text), sorted by key, as one file a key.  Another attempt of the task replaces it by the same."""
    mark = TaskContext.get().taskAttemptId()
    for (folder, name), lines in itertools.groupby(rows, key=lambda r: (r[0], r[1])):
        value = re.sub(r"""["#%'*/:=?\\{\[\]^\x01-\x1f\x7f]""", lambda c: f"%{ord(c[0]):02X}", name)  # as Spark's writers do
        at = f"{path}/folder={folder}/{key}={value}"
        os.makedirs(at, exist_ok=True)
        with open(f"{at}/.{mark}", "wb") as file:
            for line in lines:
                file.write(line[2] or b"")
                file.write(b"\n")
        os.replace(file.name, f"{at}/text.txt")


def write_texts(rows: DataFrame, path: str, *, key: str, text: str, order: Sequence[str] = ()) -> None:
    """One text file a key, in a folder ``KEY=value`` of its own, with the key's texts as lines in the given order.

    The folders of the keys lie in ``TEXT_FOLDERS`` folders, so that a reader lists them in that many tasks and not in one
    a file.  On a disk the tasks write the files themselves: Hadoop's local file system starts several
    processes (chmod) for each file and folder.  In other stores Spark's writer writes them.
    """
    spark, by = rows.sparkSession, [f"_order{i}" for i in range(len(order))]
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(NO_KEY))
    named = rows.select(
        F.pmod(F.xxhash64(name), F.lit(TEXT_FOLDERS)).alias("folder"), name.alias(key), F.col(text).alias("value"),
        *[F.col(c).alias(o) for c, o in zip(order, by, strict=True)],
    )
    dealt = named.repartition(key).sortWithinPartitions("folder", key, *by).select("folder", key, "value")
    disk = _shared_disk(spark, path)
    if disk is None:
        dealt.write.partitionBy("folder", key).text(path)
    else:
        os.makedirs(disk)
        lines = dealt.withColumn("value", F.col("value").cast("binary"))
        lines.foreachPartition(functools.partial(_write_lines, path=disk, key=key))


def files_sorted(documents: DataFrame) -> DataFrame:
    return documents.orderBy("path")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table at ``path``, or an empty table of the same columns if there is none yet."""
    try:
        return spark.read.schema(S.CHUNK).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
            raise
        return spark.createDataFrame([], S.CHUNK)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def feedback_table(spark: SparkSession) -> DataFrame:
    """The empty feedback table."""
    return spark.createDataFrame([], S.FEEDBACK)


def feedback_append(rows: DataFrame, path: str) -> None:
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.FEEDBACK]).write.mode("append").parquet(path)


def read_csv_prices(spark: SparkSession, path: str) -> DataFrame:
    """All price CSVs under ``path`` in one scan, with the short column names."""
    raw = spark.read.option("header", True).schema(
        "delivery_start timestamp, market string, price_eur_mwh double"
    ).csv(path)
    return raw.withColumnsRenamed({"delivery_start": "ts", "price_eur_mwh": "price"})


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack frames by column name; columns some of them lack are NULL there."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def read_eval_items(spark: SparkSession, path: str, *, schema: T.StructType = S.EVAL_ITEM) -> DataFrame:
    """Evaluation items from files that each hold one JSON array over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _first_table(html: Column) -> Column:
    """What lies between the first table's tags, tables inside it included; empty without a table."""
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    # Each part ends where a table does: the first table ends where as many have ended as begun.
    parts = F.split(F.regexp_extract(clean, r"(?is)<table\b.*", 0), r"(?i)</table\s*>")
    start = F.struct(F.lit(0).alias("open"), F.lit(False).alias("done"), F.lit("").alias("text"))

    def step(so_far: Column, part: Column) -> Column:
        left = so_far["open"] + F.regexp_count(part, F.lit(r"(?i)<table\b")) - 1
        more = F.struct(left.alias("open"), (left <= 0).alias("done"), F.concat(so_far["text"], part).alias("text"))
        return F.when(so_far["done"], so_far).otherwise(more)

    return F.aggregate(parts, start, step)["text"]


def _plain(markup: Column) -> Column:
    """Text of a piece of HTML: without tags, with characters for entities, without white space at its ends."""
    named = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, code)])
    pieces = F.split(F.regexp_replace(markup, r"(?s)<[^>]*>", ""), "&")

    def decoded(piece: Column) -> Column:
        entity = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = (
            F.when(entity.rlike("^#[xX]"), F.conv(F.substr(entity, F.lit(3)), 16, 10).cast("int"))
            .when(F.startswith(entity, F.lit("#")), F.substr(entity, F.lit(2)).cast("int"))
            .otherwise(F.try_element_at(named, entity))
        )
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.when(known, F.concat(letter, F.substr(piece, F.length(entity) + 2))).otherwise(F.concat(F.lit("&"), piece))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.regexp_replace(F.concat(pieces[0], F.array_join(rest, "")), r"^[\s\u00A0]+|[\s\u00A0]+$", "")


def parse_html_tables(df: DataFrame, *, key: str, html_col: str, columns: list[str]) -> DataFrame:
    """Rows of the first table of each page, as text columns named in its header row.

    Expressions alone, so pages stay in the JVM and a page's cells are one array of arrays.  A cell ends at
    its end tag or where the next cell or row begins.  A short row has NULL in the columns it lacks, and so has a column
    that the header does not name; a page without a table, or NULL, gives no row.
    """
    rows = F.split(_first_table(F.col(html_col)), r"(?i)<tr\b[^>]*>")
    cells = F.transform(
        F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))),
        lambda row: F.transform(
            F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</?t[dhr]\b|\z)"), F.lit(1)), _plain
        ),
    )
    read = df.select(key, cells.alias("_cells")).filter(F.size("_cells") > 1)
    body = read.select(
        key, F.col("_cells")[0].alias("_header"), F.posexplode(F.slice("_cells", 2, F.size("_cells") - 1)).alias("row_no", "_row")
    )
    at = lambda c: F.array_position("_header", F.lit(c)).cast("int")
    return body.select(key, "row_no", *[F.when(at(c) > 0, F.get("_row", at(c) - 1)).alias(c) for c in columns])

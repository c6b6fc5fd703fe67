"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content, slices, stored

#: Version of the rules below; findings are kept per version, so a new one scans every blob again.
RULES = "base-1"

# The base rules, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
KINDS = ("assign", "access", "hex")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_assign = re.compile(ASSIGN, re.I | re.A)
# The runs are maximal, so those that fail the length can be left out by the pattern.
_access, _hex = re.compile("AKIA[A-Z0-9]{14,}"), re.compile("[0-9a-f]{16,}")


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every finding, by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), m.end(), 0) for m in _assign.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _access.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _hex.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _scan(batches):
    for part in slices(batches):
        rows = [spans_of(x) for x in part.column(1).to_pylist()]
        count = lambda k: pa.array([sum(s[2] == k for s in r) for r in rows], pa.int64())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0), count(0), count(1), count(2),
                pa.array([",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in r) for r in rows]),
            ],
            names=["blob", "n_assign", "n_access", "n_hex", "spans"],
        )


_LEDGER = "blob binary, n_assign long, n_access long, n_hex long, spans string, rules string"


def read_ledger(docs: DataFrame, ledger: str, rules: str) -> DataFrame:
    """Blobs scanned by this version of the rules, with their findings; no rows before the first scan."""
    spark = docs.sparkSession
    try:
        return spark.read.schema(_LEDGER).parquet(ledger).filter(F.col("rules") == rules).drop("rules")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER).drop("rules")


def scan_versions(
    versions: DataFrame, ledger: str, *, rules: str = RULES, path_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scan what the ledger has not seen; per row of ``versions``: ``path_col, blob, n_assign, n_access, n_hex, spans``.

    A blob is a text by its SHA-256 (null: the empty text), however many paths or
    versions hold it.  ``ledger`` is a table folder of (blob, rules) with findings.  A
    blob that it has under ``rules`` is not read again; of each other blob one
    row's text goes to the scan, and its findings are appended, also when there
    are none.  Then findings are joined back to all rows by blob; they are written
    before, so that both sides come straight from a shuffle and the adaptive skew join
    can split the rows of a blob with many paths.

    What decides is narrow (path, blob); only texts to be scanned are taken
    on.  A scan that is run twice at once may append a blob twice; equal rows are
    read as one.  Null paths and repeated rows each get their findings; an empty table
    gives no rows.  Other columns are not read.
    """
    text = content(text_col)
    named = versions.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"))
    refs = stored(named, "refs")
    unseen = stored(
        refs.groupBy("blob").agg(F.min("path").alias("owner")).join(read_ledger(versions, ledger, rules), "blob", "left_anti"),
        "unseen",
    ).withColumnRenamed("blob", "_blob")
    texts = versions.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    new = texts.join(unseen, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("owner")), "left_semi")
    scanned = new.select("blob", "text").mapInArrow(_scan, _LEDGER.rpartition(",")[0])
    scanned.withColumn("rules", F.lit(rules)).write.mode("append").partitionBy("rules").parquet(ledger)
    found = stored(read_ledger(versions, ledger, rules).dropDuplicates(["blob"]), "findings")
    return refs.join(found, "blob").select(
        F.col("path").alias(path_col), F.lower(F.hex("blob")).alias("blob"), "n_assign", "n_access", "n_hex", "spans"
    )

"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import content, stored

#: The tree has RADIX ** LEVELS nodes; many nodes share a task, so the number only bounds a node's size.
RADIX, LEVELS = 16, 3


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, SHA-256 of the text (null: empty), and what verifies it (bytes, a second hash)."""
    text = content(text_col)
    return docs.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("second"),
    )


def groups(runs: DataFrame, *, keep: str = "max", radix: int = RADIX, levels: int = LEVELS) -> DataFrame:
    """Per digest: the staying row (``stay``: id and row number) and ``group_size``.

    A run starts at the node of its input partition.  In round t each node deals
    its run out by digit t of the digests and merges what it gets: rows of equal
    digest become one row that holds the staying identifier, so a group of copies
    is at most one row per node from the first round on, and shrinks by the radix
    in each further one.  The merge is Spark's sort aggregation: each task sorts
    its run by digest and merges it before the exchange, and merges the sorted
    runs after it.  After the last round the node is the digest's own, so groups
    are whole.  At every level the merged rows must agree in length and second
    hash, else the job fails: digests that collide are never joined.
    """
    pick = F.max if keep == "max" else F.min
    level = runs.select(
        F.spark_partition_id().alias("node"), "digest", "n_bytes", "second", F.lit(1).cast("long").alias("n"),
        F.struct("id", "row").alias("stay"),
    )
    head = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    for t in range(levels):
        unit = radix**t
        digit = lambda x, u=unit: F.floor(x / F.lit(u)) % radix
        dealt = level.withColumn(
            "node", ((F.col("node") % radix**levels) + (digit(head) - digit(F.col("node"))) * unit).cast("long")
        )
        merged = dealt.groupBy("node", "digest").agg(
            pick("stay").alias("stay"), F.sum("n").alias("n"), F.min("n_bytes").alias("n_bytes"),
            F.max("n_bytes").alias("_bytes"), F.min("second").alias("second"), F.max("second").alias("_second"),
        )
        same = (F.col("n_bytes") == F.col("_bytes")) & (F.col("second") == F.col("_second"))
        level = merged.select(
            "node", "digest", "n_bytes", "second", "stay",
            F.when(same, F.col("n")).otherwise(F.raise_error(F.lit("different texts have one digest"))).alias("n"),
        )
    return level.select("digest", "stay", F.col("n").alias("group_size"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests with a row number that holds once they are written: it tells repeated rows apart."""
    rows = digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return stored(rows, "digests")


def mark_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max"
) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of rows with equal texts (null equals empty) the one with the largest id
    stays (``keep="min"``: the smallest).  Of rows that repeat that id exactly one
    is kept.  Null ids are smaller than all others; a group that has no other id
    keeps one of its rows, and its keep_id is null.  An empty table gives no rows.
    Other columns are not read.  The table is read once; what moves is digests.
    """
    rows = _numbered(docs, id_col, text_col)
    found = groups(rows, keep=keep)
    return rows.join(found, "digest").select(
        F.col("id").alias(id_col), F.col("stay.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stay.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns; see ``mark_copies``.

    Rows that repeat the staying id and text are cut to one at the end, where
    only they are left of a group.
    """
    found = groups(_numbered(docs, id_col, text_col), keep=keep)
    stay = found.select(F.col("digest").alias("_d"), F.col("stay.id").alias("_i"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.unhex(F.sha2(content(text_col), 256)).alias("_digest"),
        F.col(id_col).alias("_id"),
    )
    left = rows.join(stay, (F.col("_digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    one = Window.partitionBy("_digest").orderBy("_id")
    return left.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_row.*")

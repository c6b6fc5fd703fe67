"""A corpus made ready for training: quality, exact and near copies, mix of sources, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import exact_dedup, mixing, near_dedup, packing, quality
from gridledger.llm.common import stored, table
from gridledger.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept.

    The verdict depends on the text (and the table's references) alone, so it is
    joined by id and text hash; that also serves null and repeated ids.
    """
    judged = quality.judge(
        docs.select(F.struct(F.xxhash64("text").alias("h"), "doc_id").alias("key"), "text"), quality.references(docs), id_col="key"
    )
    bad = stored(judged.filter(~F.col("kept")).select("key.*").distinct(), "rejected")
    gone = bad.select(F.col("h").alias("bad_h"), F.col("doc_id").alias("bad_id"))
    # Whole rows go in one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("text").alias("_h"), F.col("doc_id").alias("_id"))
    return rows.join(gone, (F.col("_h") == F.col("bad_h")) & F.col("_id").eqNullSafe(F.col("bad_id")), "left_anti").select("_row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Shingle sets, queue order and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

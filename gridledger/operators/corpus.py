"""Counts and keyword statistics over tagged chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X


def corpus_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count_distinct("contract_id").alias("n_contracts"), F.count_distinct("clause_id").alias("n_clauses")
    )


def category_distribution(chunks: DataFrame) -> DataFrame:
    """Chunks per category and their share of all chunks; the total is the sum over the few groups."""
    counts = chunks.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    shares = counts.select("risk_category", "n", F.round(F.col("n") / total * 100, 1).alias("pct"))
    return shares.filter(F.col("risk_category").isNotNull())


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Totals per contract, per category, untagged and overall.

    The chunks are read once, into counts per contract and category; subtotals
    and the grand total come from those.
    """
    base = chunks.groupBy("contract_id", "risk_category").agg(F.count(F.lit(1)).alias("_n"))
    counts = base.groupingSets(
        [[F.col("contract_id")], [F.col("risk_category")], []], F.col("contract_id"), F.col("risk_category")
    ).agg(F.grouping_id().alias("_level"), F.sum("_n").alias("n_chunks"))
    level = (
        F.when(F.col("_level") == 3, F.lit("total"))
        .when(F.col("_level") == 1, F.lit("contract"))
        .when(F.col("risk_category").isNull(), F.lit("untagged"))
        .otherwise(F.lit("category"))
    )
    total = base.agg(F.sum("_n")).scalar()
    return counts.select(
        level.alias("level"),
        F.coalesce("contract_id", "risk_category", F.lit("")).alias("name"),
        "n_chunks",
        F.round(F.col("n_chunks") / total * 100, 1).alias("pct"),
    )


def top_keywords(chunks: DataFrame, *, n: int = 10, min_len: int = V.KEYWORD_MIN_CHARS) -> DataFrame:
    """Most frequent words per category, stopwords left out; ties go to the earlier word."""
    runs = F.regexp_extract_all(F.lower("chunk_text"), F.lit("([a-z]+)"), F.lit(1))
    tokens = chunks.filter(F.col("risk_category").isNotNull()).select(
        "risk_category", F.explode(runs).alias("keyword")
    ).filter((F.length("keyword") >= min_len) & ~F.col("keyword").isin(V.STOPWORDS))
    counts = tokens.groupBy("risk_category", "keyword").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("risk_category").orderBy(F.desc("n"), "keyword")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def floor_coverage(chunks: DataFrame, *, category: str = "price_risk", examples: int = 3) -> DataFrame:
    """Price clauses with and without floor wording: count, share and the first few chunk ids."""
    rows = chunks.filter(F.col("risk_category") == category).select(
        X.has_floor_simple(F.col("chunk_text")).alias("has_floor"), "contract_id", "chunk_id"
    )
    counts = rows.groupBy("has_floor").agg(F.count(F.lit(1)).alias("n_clauses"))
    w = Window.partitionBy("has_floor").orderBy("contract_id", "chunk_id")
    first = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= examples).groupBy("has_floor").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_r", "chunk_id"))), lambda x: x["chunk_id"]), ","
        ).alias("examples")
    )
    total = F.sum("n_clauses").over(Window.partitionBy())
    return counts.select(
        "has_floor", "n_clauses", F.round(F.col("n_clauses") / total * 100, 1).alias("pct")
    ).join(first, "has_floor")

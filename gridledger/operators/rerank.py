"""Second-stage ranking of retrieved passages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions import text as X
from ..session import written
from .joins import join_same

K1, B = 1.2, 0.75


def bm25_scores(hits: DataFrame, *, query_id: str = "query_id", query: str = "query",
                passage: str = "chunk_text") -> DataFrame:
    """Add ``rerank_score``: BM25 of each passage within the candidates of its query.

    Number and mean length of a query's candidates and, per term, how many of them hold it are
    counted per query and joined back: the work is linear in the candidates, however many a query has.
    """
    counted = hits.withColumn("_words", X.words(F.lower(passage))).withColumns({
        "_n": F.size("_words"),
        # What taking a word out leaves shorter: no test per word of the passage is interpreted.
        "_tf": F.transform(X.token_set(F.col(query)), lambda t: F.size("_words") - F.size(F.array_remove("_words", t))),
    }).drop("_words")
    counted = written(counted, "term-counts")  # read three times below
    sizes = counted.groupBy(query_id).agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"))
    held = counted.select(query_id, F.posexplode("_tf").alias("_i", "_t")).groupBy(query_id, "_i").agg(F.count_if(F.col("_t") > 0).alias("_df"))
    listed = held.groupBy(query_id).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_df"))), lambda x: x["_df"]).alias("_held")
    )
    seen = join_same(join_same(counted, sizes, [query_id]), listed, [query_id], "left")
    norm = K1 * (1 - B + B * F.col("_n") / F.col("_mean"))

    def part(tf, i):
        df = F.get("_held", i)
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(F.lit(0.0))

    total = F.aggregate(F.transform("_tf", part), F.lit(0.0), lambda acc, x: acc + x)
    return seen.withColumn("rerank_score", total).drop("_tf", "_n", "_docs", "_held", "_mean")


def rerank(hits: DataFrame, *, n: int = V.RERANK_TOP_N,
           scorer: str | Callable[[pd.Series, pd.Series], pd.Series] = "bm25",
           keep_order: bool = False, query_id: str = "query_id", query: str = "query",
           passage: str = "chunk_text") -> DataFrame:
    """Keep the best ``n`` candidates per query as ``rerank_rank`` and ``rerank_score``.

    ``scorer`` is "bm25", "identity" (candidate order, falling scores) or a
    function of two series, query and passage, called per Arrow batch.  With
    ``keep_order`` the chosen ones are numbered in candidate order.
    """
    if scorer == "identity":
        scored = hits.withColumn("rerank_score", F.lit(0.0))
        best = Window.partitionBy(query_id).orderBy("rank")
        picked = scored.withColumn("rerank_rank", F.row_number().over(best)).filter(F.col("rerank_rank") <= n)
        return picked.withColumn("rerank_score", 1.0 - F.col("rerank_rank") * V.IDENTITY_SCORE_STEP)
    if scorer == "bm25":
        scored = bm25_scores(hits, query_id=query_id, query=query, passage=passage)
    else:
        scored = hits.withColumn("rerank_score", F.pandas_udf(scorer, T.DoubleType())(F.col(query), F.col(passage)))
    # Scores are compared at ten digits, so that the order does not hang on the
    # order in which a cluster added up the parts.
    best = Window.partitionBy(query_id).orderBy(F.desc(F.round("rerank_score", 10)), "rank")
    picked = scored.withColumn("rerank_rank", F.row_number().over(best)).filter(F.col("rerank_rank") <= n)
    if keep_order:
        again = Window.partitionBy(query_id).orderBy("rank")
        picked = picked.withColumn("rerank_rank", F.row_number().over(again))
    return picked


def rerank_texts(df: DataFrame, *, n: int = 5, scorer="bm25", query_id: str = "query_id", query: str = "query",
                 texts: str = "texts") -> DataFrame:
    """Rank the strings of an array column: (query_id, orig_index, rerank_score, text)."""
    rows = df.select(query_id, query, F.posexplode(texts).alias("orig_index", "text")).withColumn(
        "rank", F.col("orig_index") + 1
    )
    ranked = rerank(rows, n=n, scorer=scorer, query_id=query_id, query=query, passage="text")
    return ranked.select(query_id, "rerank_rank", "orig_index", "rerank_score", "text")

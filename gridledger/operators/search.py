"""Retrieval: the best chunks of a query by shared words, the best vectors by cosine, text to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .. import schemas as S
from ..functions import text as X
from .token_index import TokenIndex, index_of, search_index
from .vector_index import VectorIndex, build_cells, search_cells


def contract_category_filter(chunks: DataFrame, *, contract_ids: list[str] | DataFrame | None = None,
                             categories: list[str] | None = None) -> DataFrame:
    """Keep the named contracts and categories; an empty or missing list does not filter.

    A long list of contracts comes as a one-column frame and is a semi join.
    """
    if isinstance(contract_ids, DataFrame):
        chunks = chunks.join(contract_ids.select("contract_id"), "contract_id", "left_semi")
    elif contract_ids:
        chunks = chunks.filter(F.col("contract_id").isin(contract_ids))
    if categories:
        chunks = chunks.filter(F.col("risk_category").isin(categories))
    return chunks


def token_overlap_search(queries: DataFrame, chunks: DataFrame | TokenIndex, *, k: int = V.SEARCH_TOP_K,
                         contract_ids=None, categories=None, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Best ``k`` chunks per query by shared words; chunks without a shared word fill up with score 0.

    ``chunks`` is an index or a chunk table; a filter leaves a part of it.
    """
    if contract_ids or categories or not isinstance(chunks, TokenIndex):
        rows = chunks.rows if isinstance(chunks, TokenIndex) else chunks
        rows = contract_category_filter(rows, contract_ids=contract_ids, categories=categories)
        chunks = index_of(rows, key="chunk_id", text="chunk_text", columns=S.HIT_COLUMNS)
    return search_index(queries, chunks, k=k, query_id=query_id, query=query)


def token_intersect(queries: DataFrame, docs: DataFrame, *, query_id: str = "query_id", query: str = "query",
                    row_key: str = "contract_id", text: str = "text") -> DataFrame:
    """Number of distinct words that a query and a row share, for every pair that shares one.

    Pairs meet by an equality join on the words, so pairs without a common word are never rows.
    ``row_key`` names a row: the table has one row per key.
    """
    asked = queries.select(query_id, F.explode(X.token_set(F.col(query))).alias("_token"))
    held = docs.select(row_key, F.explode(X.token_set(F.col(text))).alias("_token"))
    return held.join(asked, "_token").groupBy(query_id, row_key).agg(F.count(F.lit(1)).alias("shared"))


def token_intersect_top(queries: DataFrame, docs: DataFrame | TokenIndex, *, k: int = 10, query_id: str = "query_id",
                        query: str = "query", row_key: str = "contract_id", text: str = "text") -> DataFrame:
    """The ``k`` rows that share most distinct words with a query, with that number; ties go to the smaller key.

    Exact: counts are added up where a block of rows meets the queries, so a word that most rows hold makes no
    pairs that leave a task.  At most ``k`` rows a query; rows that share nothing are no rows.
    """
    if not isinstance(docs, TokenIndex):
        docs = index_of(docs, key=row_key, text=text, columns=[row_key])
    best = search_index(queries.select(query_id, query), docs, k=k, query_id=query_id, query=query)
    asked = queries.select(query_id, F.size(X.token_set(F.col(query))).alias("_n"))
    shared = F.round(F.col("score") * F.col("_n")).cast("bigint")
    return best.filter("score > 0").join(asked, query_id).select(query_id, row_key, shared.alias("shared"), "rank")


def vector_search(queries: DataFrame, vectors: DataFrame | VectorIndex, *, k: int = V.SEARCH_TOP_K,
                  filters: Column | None = None, probes: int | None = None, query_id: str = "query_id",
                  query_vector: str = "query_vector", row_key: str = "vec_id", vector: str = "embedding",
                  columns: list[str] = (), **cells) -> DataFrame:
    """Cosine top ``k`` per query vector, optionally over a filtered part of the table.

    Exact by default; with ``probes`` each query looks into so many nearest cells only.
    ``vectors`` is a written index or a table, which is dealt to cells first.
    """
    if not isinstance(vectors, VectorIndex):
        rows = vectors if filters is None else vectors.filter(filters)
        vectors = build_cells(rows, key=row_key, vector=vector, columns=list(columns), **cells)
    elif filters is not None:
        raise ValueError("filter the table before it is indexed")
    return search_cells(queries, vectors, k=k, probes=probes, query_id=query_id, query_vector=query_vector)


def query_contract_clauses(queries: DataFrame, chunks: DataFrame, *, risk_category: str | None = None,
                           k: int = 8, n: int = 3) -> DataFrame:
    """Clauses of the contract a question is about: ``k`` by shared words, ``n`` after reranking.

    Questions carry a contract each, so candidates come from an equality join on
    the contract; only chunks of asked contracts are scored.
    """
    from ..functions.text import token_set
    from .rerank import rerank

    rows = contract_category_filter(chunks, categories=[risk_category] if risk_category else None)
    asked = queries.select("query_id", "query", "contract_id", token_set(F.col("query")).alias("_q"))
    pairs = rows.join(asked, "contract_id")
    share = F.size(F.array_intersect("_q", token_set(F.col("chunk_text")))) / F.greatest(F.size("_q"), F.lit(1))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    hits = pairs.withColumn("score", share).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return rerank(hits.select("query_id", "query", *S.HIT_COLUMNS, "score", "rank"), n=n, scorer="identity")


def embed_text(df: DataFrame, *, key: str, text: str, dim: int = 256,
               model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Text to unit vectors (``embedding``), by a user's model or by hashed word counts.

    The model maps a series of texts to a series of float lists and is called
    with one Arrow batch at a time.  A word's slot is its MD5 modulo ``dim``,
    an expression; only slot numbers go to Python, where a batch is counted at once.
    """
    if model is not None:
        embed = F.pandas_udf(model, T.ArrayType(T.DoubleType()))
        return df.select(key, embed(F.col(text)).alias("embedding"))
    slot = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int")
    slots = df.select(key, F.transform(X.words(F.lower(F.coalesce(text, F.lit("")))), slot).alias("_slots"))

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column(1)
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            at = row * dim + lists.flatten().to_numpy()
            counts = np.bincount(at, minlength=n * dim).reshape(n, dim).astype(float)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = counts / np.where(norm == 0, 1.0, norm)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(unit.reshape(-1)))], names=[key, "embedding"])

    kind = df.schema[key].dataType
    return slots.mapInArrow(count, T.StructType([T.StructField(key, kind), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))

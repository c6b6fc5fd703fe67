"""Queries that apply each operator to its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import exact_dedup, hard_negatives, language_id, mixing, near_dedup, packing, quality, secrets, sharding, simhash, token_counts, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    """Register a query under its name, with its check SQL where SQL can express it."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def tokenizer_file() -> str:
    """The public tokenizer that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@add("op1_token_counts")
def _(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), tokenizer_file())


@add("op2_near_dedup")
def _(spark, sf):
    return near_dedup.link(table(spark, sf, "documents"))


@add("op3_secrets")
def _(spark, sf):
    found = secrets.scan_versions(table(spark, sf, "documents"), scratch_path(spark, "blob-ledger"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


@add("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def _(spark, sf):
    return exact_dedup.mark_copies(table(spark, sf, "documents"))


@add("op5_warc", """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN big AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN big AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, h, octet_length(encode(h)) >= 1000 AS big, max(page_id) OVER (PARTITION BY h) AS last
  FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""")
def _(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"), scratch_path(spark, "warc"))


@add("op6_sharding")
def _(spark, sf):
    return sharding.place(table(spark, sf, "documents"))


@add("op7_language")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return language_id.predict(docs, language_id.fit(docs))


@add("op8_quality")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.judge(docs, quality.references(docs))


@add("op9_packing")
def _(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_file())


@add("op10_mixing")
def _(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@add("op11_whitening")
def _(spark, sf):
    # A deviation beyond a long's range is null here; the operator has it as a decimal.
    made = whitening.whiten(table(spark, sf, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


@add("op12_simhash")
def _(spark, sf):
    return simhash.link(table(spark, sf, "documents"))


@add("op13_hard_negatives", """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", hard_negatives.rotated(F.col("label"), F.col("vec_id"))))

"""Queries over contract text, retrieval and evaluation, each with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from .. import schemas as S
from ..operators import corpus, evaluation, rerank, search, sections, token_index, vector_index
from ..session import written
from . import views as D
from .reference_sql import (
    any_of, has_floor, head_case, in_category, strip, tag_case, text_list, with_tables, words,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema
    ])


def add(name: str, sql: str | None = None):
    """Register a query under its name, together with its check SQL."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return keep


# --- blocks, sections, chunks ---------------------------------------------------------


@add("not_heading_noise", "SELECT contract_id, page, block_no, text FROM raw_blocks WHERE length("
     + strip("text") + ") >= 5")
def _(spark, sf):
    return sections.not_heading_noise(D.blocks(spark, sf))


@add("detect_clause", f"""
SELECT contract_id, block_no, {head_case('line', 'clause')} AS clause_id, {head_case('line', 'title')} AS section_title
FROM (SELECT contract_id, block_no, {strip("string_split(text, chr(10))[1]")} AS line FROM raw_blocks)""")
def _(spark, sf):
    head = X.detect_clause(F.col("text"))
    return D.blocks(spark, sf).select("contract_id", "block_no", head.alias("_h")).select(
        "contract_id", "block_no", "_h.clause_id", "_h.section_title"
    )


@add("split_sections", "SELECT * FROM sections")
def _(spark, sf):
    return sections.split_sections(D.contract_documents(spark, sf))


@add("section_carry_forward", """
SELECT contract_id, page, block_no, text,
       CAST(count(h_clause) OVER w AS BIGINT) AS headings_so_far,
       coalesce(last_value(h_clause IGNORE NULLS) OVER w, 'PREAMBLE') AS clause_id,
       coalesce(last_value(h_title IGNORE NULLS) OVER w, 'Preamble') AS section_title
FROM headed WINDOW w AS (PARTITION BY contract_id ORDER BY block_no ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return sections.section_carry_forward(D.blocks(spark, sf))


_CHUNKS_SQL = "SELECT * EXCLUDE (section_ord) FROM plain_chunks"


@add("chunk_words", _CHUNKS_SQL)
def _(spark, sf):
    return D.untagged_chunks(spark, sf).drop("risk_category")


@add("chunk_id", """
SELECT contract_id, clause_id, section_ord, pos, substr(md5(concat(contract_id, ':', clause_id, ':', pos)), 1, 16) AS legacy_id,
       substr(md5(concat(contract_id, ':', section_ord, ':', clause_id, ':', pos)), 1, 16) AS chunk_id
FROM (SELECT contract_id, clause_id, section_ord, CAST(section_ord * 344 AS INT) AS pos FROM sections)""")
def _(spark, sf):
    rows = sections.split_sections(D.contract_documents(spark, sf)).select(
        "contract_id", "clause_id", "section_ord", (F.col("section_ord") * 344).alias("pos")
    )
    ids = [F.col(c) for c in ("contract_id", "clause_id", "pos")]
    return rows.withColumns({"legacy_id": X.chunk_id(*ids), "chunk_id": X.chunk_id(*ids, F.col("section_ord"))})


@add("parse_documents", """
SELECT chunk_id, contract_id, clause_id, page_number, token_count, char_start, risk_category, md5(chunk_text) AS text_hash
FROM chunks""")
def _(spark, sf):
    # The stored text is the file content; the decoder cuts it back into lines with page numbers.
    def lines(data: bytes):
        for number, line in enumerate(data.decode("utf-8").split("\x1e")):
            yield number // 40 + 1, line

    files = D.contract_documents(spark, sf).select(
        "contract_id",
        F.encode(F.array_join(F.transform("blocks", lambda b: b["text"]), "\x1e"), "UTF-8").alias("content"),
    )
    chunks, _failed = sections.parse_documents(files, extractor=lines)
    return chunks.select("chunk_id", "contract_id", "clause_id", "page_number", "token_count", "char_start",
                         "risk_category", F.md5("chunk_text").alias("text_hash"))


@add("contract_metadata", """
SELECT contract_id, ppa_type, concat(contract_id, ' Wind') AS asset, counterparty AS seller,
       CASE WHEN volume_mw > 20 THEN counterparty END AS buyer, delivery_point, strike_price_eur, volume_mw, tenor_years,
       CAST(DATE '2024-01-01' + tenor_years AS DATE) AS start_date FROM contracts""")
def _(spark, sf):
    book = D.contracts(spark, sf)
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("tenor_years"))
    cover = F.concat_ws(
        "\n",
        F.concat(F.lit("("), F.upper("ppa_type"), F.lit(" PPA)")),
        F.concat(F.lit("Asset: "), F.col("contract_id"), F.lit(" Wind")),
        F.concat(F.lit("Seller: "), F.col("counterparty")),
        F.concat(F.lit("Buyer: "), F.when(F.col("volume_mw") > 20, F.col("counterparty")).otherwise(F.lit(""))),
        F.concat(F.lit("Delivery Point: "), F.col("delivery_point")),
        F.concat(F.lit("Strike Price: €"), F.call_function("format_number", "strike_price_eur", F.lit("0.00")), F.lit("/MWh")),
        F.concat(F.lit("Contract Volume: "), F.col("volume_mw").cast("string"), F.lit(" MW")),
        F.concat(F.lit("Tenor: "), F.col("tenor_years").cast("string"), F.lit(" years")),
        F.concat(F.lit("Start Date: "), F.date_format(start, "d MMMM yyyy")),
    )
    return sections.contract_metadata(book.select("contract_id", cover.alias("cover_text")))


@add("contract_id_from_name", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL
                        ELSE concat('ppa-', replace(lower(o_orderpriority), ' ', '-'), '-', o_orderkey) END AS contract_id
FROM orders""")
def _(spark, sf):
    suffix = F.when(F.col("o_orderkey") % 3 == 0, F.lit(".txt")).otherwise(F.lit(".pdf"))
    name = F.concat(F.lit("PPA "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string"), suffix)
    return D.table(spark, sf, "orders").select("o_orderkey", X.contract_id_from_name(name).alias("contract_id"))


# --- tags -----------------------------------------------------------------------------------


@add("tag_chunk", "SELECT chunk_id, risk_category FROM chunks")
def _(spark, sf):
    rows = D.untagged_chunks(spark, sf)
    return rows.select("chunk_id", X.tag_chunk(F.col("chunk_text")).alias("risk_category"))


@add("tag_text", "SELECT chunk_id, risk_category FROM chunks")
def _(spark, sf):
    X.register_tag_text(spark)
    rows = D.untagged_chunks(spark, sf)
    rows.createOrReplaceTempView("untagged_chunks")
    return spark.sql("SELECT chunk_id, tag_text(chunk_text) AS risk_category FROM untagged_chunks")


@add("tag_all", f"""
SELECT chunk_id, array_to_string(list_filter([{', '.join(
    f"CASE WHEN {in_category('lower(chunk_text)', r)} THEN '{c}' END" for c, r in V.RISK_TAXONOMY.items())}],
    lambda x: x IS NOT NULL), ',') AS categories FROM plain_chunks""")
def _(spark, sf):
    rows = D.untagged_chunks(spark, sf)
    return rows.select("chunk_id", F.array_join(X.tag_all(F.col("chunk_text")), ",").alias("categories"))


@add("tag_batch", f"""
SELECT chunk_id, CASE WHEN page_number > 1 THEN 'later_page' ELSE {tag_case('lower(chunk_text)')} END AS risk_category
FROM plain_chunks""")
def _(spark, sf):
    # Some chunks come with a category already; it stays.
    rows = D.untagged_chunks(spark, sf).withColumn(
        "risk_category", F.when(F.col("page_number") > 1, F.lit("later_page"))
    )
    return sections.tag_batch(rows).select("chunk_id", "risk_category")


@add("title_case_category", """
SELECT DISTINCT risk_category, CASE risk_category WHEN 'curtailment_risk' THEN 'Curtailment Risk' WHEN 'price_risk' THEN 'Price Risk'
       WHEN 'volume_risk' THEN 'Volume Risk' WHEN 'basis_risk' THEN 'Basis Risk' WHEN 'counterparty_risk' THEN 'Counterparty Risk'
       WHEN 'legal_regulatory' THEN 'Legal Regulatory' END AS title FROM chunks WHERE risk_category IS NOT NULL""")
def _(spark, sf):
    rows = D.chunks(spark, sf).filter("risk_category IS NOT NULL").select("risk_category").distinct()
    return rows.withColumn("title", X.title_case_category(F.col("risk_category")))


@add("has_floor", f"SELECT chunk_id, {has_floor('chunk_text')} AS has_floor FROM plain_chunks")
def _(spark, sf):
    return D.untagged_chunks(spark, sf).select("chunk_id", X.has_floor(F.col("chunk_text")).alias("has_floor"))


@add("has_floor_simple", f"SELECT chunk_id, {any_of('chunk_text', V.FLOOR_WORDS)} AS has_floor FROM plain_chunks")
def _(spark, sf):
    return D.untagged_chunks(spark, sf).select("chunk_id", X.has_floor_simple(F.col("chunk_text")).alias("has_floor"))


@add("no_compensation", f"""
SELECT chunk_id, {any_of('chunk_text', V.NO_COMPENSATION_PHRASES)} AS no_compensation FROM plain_chunks""")
def _(spark, sf):
    return D.untagged_chunks(spark, sf).select("chunk_id", X.no_compensation(F.col("chunk_text")).alias("no_compensation"))


# --- corpus statistics ---------------------------------------------------------------


@add("corpus_counts", "SELECT count(DISTINCT contract_id) AS n_contracts, count(DISTINCT clause_id) AS n_clauses FROM plain_chunks")
def _(spark, sf):
    return corpus.corpus_counts(D.untagged_chunks(spark, sf))


@add("category_distribution", """
SELECT risk_category, count(*) AS n, round(count(*) / (SELECT count(*) FROM chunks) * 100, 1) AS pct
FROM chunks WHERE risk_category IS NOT NULL GROUP BY risk_category""")
def _(spark, sf):
    return corpus.category_distribution(D.chunks(spark, sf))


@add("chunk_stats", """
SELECT level, name, n AS n_chunks, round(n / (SELECT count(*) FROM chunks) * 100, 1) AS pct FROM (
  SELECT 'total' AS level, '' AS name, count(*) AS n FROM chunks
  UNION ALL SELECT 'contract', contract_id, count(*) FROM chunks GROUP BY contract_id
  UNION ALL SELECT CASE WHEN risk_category IS NULL THEN 'untagged' ELSE 'category' END, coalesce(risk_category, ''), count(*)
            FROM chunks GROUP BY risk_category)""")
def _(spark, sf):
    return corpus.chunk_stats(D.chunks(spark, sf))


@add("top_keywords", f"""
SELECT risk_category, keyword, n, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY risk_category ORDER BY n DESC, keyword) AS INT) AS rank FROM (
    SELECT risk_category, keyword, count(*) AS n
    FROM (SELECT risk_category, unnest(regexp_extract_all(lower(chunk_text), '[a-z]+')) AS keyword FROM chunks
          WHERE risk_category IS NOT NULL)
    WHERE length(keyword) > 3 AND NOT list_contains({text_list(V.STOPWORDS)}, keyword) GROUP BY ALL)) WHERE rank <= 10""")
def _(spark, sf):
    return corpus.top_keywords(D.chunks(spark, sf))


@add("floor_coverage", f"""
SELECT has_floor, count(*) AS n_clauses, round(count(*) / sum(count(*)) OVER () * 100, 1) AS pct,
       array_to_string(list(chunk_id ORDER BY contract_id, chunk_id)[1:3], ',') AS examples
FROM (SELECT *, {any_of('chunk_text', V.FLOOR_WORDS)} AS has_floor FROM chunks WHERE risk_category = 'price_risk')
GROUP BY has_floor""")
def _(spark, sf):
    return corpus.floor_coverage(D.chunks(spark, sf))


# --- lexical retrieval ----------------------------------------------------------------

_HIT = "query_id, chunk_id, contract_id, clause_id, section_title, risk_category, round(score, 9) AS score, rank"


def _hits(spark, sf, k):
    found = search.token_overlap_search(D.questions(spark, sf), D.chunk_index(spark, sf), k=k)
    return rounded(sections.tag_batch(written(found, "hits")).drop("chunk_text"), 9)


@add("token_overlap_search", f"SELECT {_HIT} FROM hits WHERE rank <= 10")
def _(spark, sf):
    return _hits(spark, sf, V.SEARCH_TOP_K)


@add("retrieve_topk", f"SELECT {_HIT} FROM hits")
def _(spark, sf):
    return _hits(spark, sf, V.RETRIEVE_TOP_K)


@add("query_chunk_cross", f"SELECT {_HIT} FROM hits WHERE rank <= 5")
def _(spark, sf):
    # An index of its own, in small blocks.
    index = token_index.index_of(D.untagged_chunks(spark, sf), key="chunk_id", text="chunk_text", columns=S.HIT_COLUMNS, block_bits=5)
    found = token_index.search_index(D.questions(spark, sf), index, k=5)
    return rounded(sections.tag_batch(written(found, "hits")).drop("chunk_text"), 9)


@add("token_intersect", """
SELECT query_id, contract_id, len(list_intersect(q, c)) AS shared FROM (
  SELECT query_id, q, concat('doc-', query_id) AS contract_id FROM query_tokens) JOIN (
  SELECT contract_id, list_distinct(""" + words("lower(text)") + """) AS c
  FROM (SELECT concat('doc-', doc_id) AS contract_id, text FROM documents)) USING (contract_id)""")
def _(spark, sf):
    # Each question against the document of the same number.
    docs = D.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("contract_id"), X.token_set(F.col("text")).alias("_c")
    )
    asked = D.questions(spark, sf).select(
        "query_id", F.concat(F.lit("doc-"), F.col("query_id").cast("string")).alias("contract_id"),
        X.token_set(F.col("query")).alias("_q"),
    )
    shared = F.size(F.array_intersect("_q", "_c")).cast("bigint")
    return asked.join(docs, "contract_id").select("query_id", "contract_id", shared.alias("shared"))


@add("token_intersect_all", """
SELECT query_id, contract_id, len(list_intersect(q, c)) AS shared FROM query_tokens, (
  SELECT contract_id, list_distinct(""" + words("lower(text)") + """) AS c
  FROM (SELECT concat('doc-', doc_id) AS contract_id, text FROM documents))
WHERE len(list_intersect(q, c)) > 0""")
def _(spark, sf):
    # Every question against every document that shares a word with it.
    docs = D.table(spark, sf, "documents").repartition("doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("contract_id"), "text"
    )
    return search.token_intersect(D.questions(spark, sf), docs)


@add("token_intersect_top", """
SELECT query_id, contract_id, shared, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, contract_id) AS INT) AS rank FROM (
    SELECT query_id, contract_id, len(list_intersect(q, c)) AS shared FROM query_tokens, (
      SELECT contract_id, list_distinct(""" + words("lower(text)") + """) AS c
      FROM (SELECT concat('doc-', doc_id) AS contract_id, text FROM documents))
    WHERE len(list_intersect(q, c)) > 0))
WHERE rank <= 10""")
def _(spark, sf):
    # The documents that share most words with a question, out of all.
    docs = D.table(spark, sf, "documents").repartition("doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("contract_id"), "text"
    )
    return search.token_intersect_top(D.questions(spark, sf), docs)


@add("contract_category_filter", """
SELECT chunk_id, contract_id, risk_category FROM chunks
WHERE contract_id IN (SELECT concat('doc-', doc_id) FROM labels WHERE quality = 1)
  AND risk_category IN ('price_risk', 'curtailment_risk')""")
def _(spark, sf):
    keep = D.table(spark, sf, "labels").filter("quality = 1").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("contract_id")
    )
    rows = search.contract_category_filter(
        D.chunks(spark, sf), contract_ids=keep, categories=["price_risk", "curtailment_risk"]
    )
    return rows.select("chunk_id", "contract_id", "risk_category")


@add("query_contract_clauses", """
SELECT query_id, chunk_id, contract_id, clause_id, rank AS rerank_rank, round(1.0::DOUBLE - 0.01::DOUBLE * rank, 6) AS rerank_score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM (
    SELECT query_id, chunk_id, contract_id, clause_id, len(list_intersect(q, c))::DOUBLE / greatest(len(q), 1) AS score
    FROM (SELECT query_id, q, concat('doc-', query_id) AS contract_id FROM query_tokens)
    JOIN (SELECT * FROM chunks JOIN chunk_tokens USING (chunk_id)) USING (contract_id))) WHERE rank <= 3""")
def _(spark, sf):
    asked = D.questions(spark, sf).select(
        "query_id", "query", F.concat(F.lit("doc-"), F.col("query_id").cast("string")).alias("contract_id")
    )
    best = search.query_contract_clauses(asked, D.chunks(spark, sf))
    return rounded(best.select("query_id", "chunk_id", "contract_id", "clause_id", "rerank_rank", "rerank_score"))


# --- reranking -----------------------------------------------------------------------------

_RANKED = "query_id, chunk_id, rank, round(rerank_score, 6) AS rerank_score, rerank_rank"


def _ranked(df):
    return rounded(df.select("query_id", "chunk_id", "rank", "rerank_score", "rerank_rank"))


@add("rerank", f"SELECT {_RANKED} FROM clauses")
def _(spark, sf):
    return _ranked(D.clauses(spark, sf))


@add("rerank_topn", f"SELECT {_RANKED} FROM clauses WHERE rerank_rank <= 3")
def _(spark, sf):
    return _ranked(rerank.rerank(D.hits(spark, sf), n=3))


@add("rank_topn", """
SELECT query_id, chunk_id, rank, round(score, 6) AS rerank_score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rerank_rank
FROM (SELECT query_id, chunk_id, rank, n / 400.0::DOUBLE AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY n DESC, rank) AS best
      FROM (SELECT query_id, chunk_id, rank, length(chunk_text) AS n FROM hits)) WHERE best <= 3""")
def _(spark, sf):
    # A scorer of the user's own, and the chosen ones numbered in candidate order.
    def longest(_query, passage):
        return passage.str.len() / 400.0

    return _ranked(rerank.rerank(D.hits(spark, sf), n=3, scorer=longest, keep_order=True))


@add("rerank_identity", """
SELECT query_id, chunk_id, rank, round(1.0::DOUBLE - 0.01::DOUBLE * rank, 6) AS rerank_score, rank AS rerank_rank FROM hits WHERE rank <= 6""")
def _(spark, sf):
    return _ranked(rerank.rerank(D.hits(spark, sf), n=6, scorer="identity"))


@add("rerank_texts", f"""
WITH cand AS (SELECT query_id, query, unnest(texts) AS txt, generate_subscripts(texts, 1) - 1 AS orig_index
              FROM (SELECT query_id, query, string_split(query, '.') AS texts FROM questions)),
t AS (SELECT query_id, orig_index, txt, words, len(words) AS n, unnest(list_distinct({words('lower(query)')})) AS term
      FROM (SELECT *, {words('lower(txt)')} AS words FROM cand)),
c AS (SELECT *, len(list_filter(words, lambda w: w = term)) AS tf FROM t),
s AS (SELECT query_id, count(*) AS docs, avg(n) AS mean_n FROM (SELECT DISTINCT query_id, orig_index, n FROM c) GROUP BY query_id),
d AS (SELECT c.*, s.docs, s.mean_n, count(*) FILTER (WHERE tf > 0) OVER (PARTITION BY c.query_id, term) AS df FROM c JOIN s USING (query_id)),
r AS (SELECT query_id, orig_index, any_value(txt) AS text, sum(CASE WHEN tf = 0 THEN 0 ELSE
             ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_n)) END) AS score
      FROM d GROUP BY query_id, orig_index)
SELECT query_id, rank AS rerank_rank, CAST(orig_index AS INT) AS orig_index, round(score, 6) AS rerank_score, text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, orig_index) AS INT) AS rank FROM r) WHERE rank <= 5""")
def _(spark, sf):
    rows = D.questions(spark, sf).select("query_id", "query", F.split("query", r"\.").alias("texts"))
    return rounded(rerank.rerank_texts(rows))


# --- vectors -------------------------------------------------------------------------------


def _vectors(spark, sf):
    """One query per label, the mean vector of the label, and the table they search."""
    table = D.table(spark, sf, "embeddings")
    means = table.select("label", F.posexplode("embedding").alias("_i", "_x")).groupBy("label", "_i").agg(
        F.avg(F.col("_x").cast("double")).alias("_x")
    )
    vector = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda v: v["_x"])
    return means.groupBy(F.col("label").alias("query_id")).agg(vector.alias("query_vector")), table


_COSINE = """
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
  SELECT q.query_id, b.vec_id, b.label, list_cosine_similarity(q.v, b.embedding::DOUBLE[]) AS score
  FROM (SELECT label AS query_id, list(x ORDER BY i) AS v FROM (
          SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
                                             FROM embeddings) GROUP BY ALL) GROUP BY label) q, embeddings b {where})"""


@add("vector_search", f"SELECT query_id, vec_id, label, round(score, 6) AS score, rank FROM ({_COSINE.format(where='')}) WHERE rank <= 10")
def _(spark, sf):
    asked, table = _vectors(spark, sf)
    return rounded(search.vector_search(asked, table, k=10, columns=["label"]))


@add("vector_topk_join", f"""
SELECT query_id, vec_id, label, round(score, 6) AS score, rank FROM ({_COSINE.format(where='WHERE b.label < 5')}) WHERE rank <= 5""")
def _(spark, sf):
    # Only some categories, in small cells that are cut into parts.
    asked, table = _vectors(spark, sf)
    return rounded(search.vector_search(
        asked, table, k=5, filters=F.col("label") < 5, columns=["label"], cells=7, part_rows=50
    ))


@add("vector_search_recall", f"""
SELECT query_id, true AS recalled, count(*) AS n FROM ({_COSINE.format(where='')}) WHERE rank <= 10 GROUP BY query_id""")
def _(spark, sf):
    # The near cells alone, held against the exact scan: nine of ten for each query.
    asked, table = _vectors(spark, sf)
    index = vector_index.build_cells(table, key="vec_id", vector="embedding", spill=3)
    exact = search.vector_search(asked, index, k=10)
    near = search.vector_search(asked, index, k=10, probes=-(-11 * len(index.centroids) // 20))
    both = exact.select("query_id", "vec_id").join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") >= 0.9 * F.count("*")).alias("recalled"), F.count("*").alias("n"))


@add("embed_text", f"""
SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
  SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS INT) AS slot, count(*) AS n
  FROM (SELECT doc_id, unnest({words('lower(text)')}) AS token FROM documents) GROUP BY ALL)""")
def _(spark, sf):
    vectors = search.embed_text(D.table(spark, sf, "documents").repartition("doc_id"), key="doc_id", text="text", dim=64)
    long = vectors.select("doc_id", F.posexplode("embedding").alias("slot", "weight")).filter("weight > 0")
    return rounded(long)


# --- evaluation ------------------------------------------------------------------------------


def _results(spark, sf):
    """Questions answered by lexical search; each expects the documents its text was taken into.

    A question's category is its market; it expects the chunks of the document of
    its own number and of the next one.
    """
    asked = D.questions(spark, sf)
    wanted = F.array(*[F.concat(F.lit("doc-"), (F.col("query_id") + i).cast("string")) for i in (0, 1)])
    expected = asked.select("query_id", F.col("market").alias("category"), wanted.alias("expected_ids"))
    found = search.token_overlap_search(asked, D.chunk_index(spark, sf), k=V.RETRIEVE_TOP_K)
    return evaluation.eval_expected_join(expected, found.withColumnRenamed("contract_id", "item_id"))


_RESULT_SQL = """
SELECT q.query_id, q.market AS category, min(h.rank) AS first_rank
FROM questions q LEFT JOIN hits h ON h.query_id = q.query_id
     AND h.contract_id IN (concat('doc-', q.query_id), concat('doc-', q.query_id + 1))
GROUP BY q.query_id, q.market"""


@add("eval_expected_join", _RESULT_SQL)
def _(spark, sf):
    return _results(spark, sf)


_HITS = ", ".join(f"round(avg((coalesce(first_rank, 99) <= {k})::INT), 6) AS hit{k}" for k in range(1, 6))


@add("retrieval_metrics", f"""
SELECT coalesce(category, 'overall') AS category, count(*) AS n_questions, {_HITS},
       round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr
FROM ({_RESULT_SQL}) GROUP BY GROUPING SETS ((category), ())""")
def _(spark, sf):
    return rounded(evaluation.retrieval_metrics(_results(spark, sf)))


@add("retrieval_failures", f"""
SELECT category, count(*) AS total, count(*) FILTER (WHERE coalesce(first_rank, 99) > 3) AS failures,
       round(avg((coalesce(first_rank, 99) > 3)::INT), 6) AS fail_rate FROM ({_RESULT_SQL}) GROUP BY category""")
def _(spark, sf):
    return rounded(evaluation.retrieval_failures(_results(spark, sf)))


def _samples(spark, sf):
    """Question and answer from the conversations; the contexts are the whole answer and the question."""
    pairs = evaluation.question_answer_pairs(D.table(spark, sf, "conversations"))
    return pairs.select("id", "question", "answer", F.col("question").alias("ground_truth"),
                        F.array("answer", "question").alias("contexts"))


def _overlap(a: str, b: str) -> str:
    wa, wb = (f"list_distinct(regexp_extract_all(lower({x}), '[\\pL\\pN_]+'))" for x in (a, b))
    return f"CASE WHEN len({wb}) = 0 THEN 0 ELSE len(list_intersect({wa}, {wb}))::DOUBLE / len({wb}) END"


_SCORES_SQL = f"""
SELECT id, CASE WHEN {strip('ctx')} = '' THEN 0.5 ELSE {_overlap('answer', 'ctx')} END AS faithfulness,
       {_overlap('answer', 'question')} AS answer_relevancy,
       CASE WHEN {strip('ctx')} = '' THEN 0.5 ELSE {_overlap('ctx', 'question')} END AS context_precision
FROM (SELECT *, concat(answer, ' ', question) AS ctx FROM pairs)"""
_MEANS_SQL = f"""
SELECT round_even(avg(faithfulness), 3) AS faithfulness, round_even(avg(answer_relevancy), 3) AS answer_relevancy,
       round_even(avg(context_precision), 3) AS context_precision FROM ({_SCORES_SQL})"""


@add("ragas_token_overlap", f"""
SELECT id, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy,
       round(context_precision, 6) AS context_precision FROM ({_SCORES_SQL})""")
def _(spark, sf):
    return rounded(evaluation.ragas_token_overlap(_samples(spark, sf)))


@add("eval_heuristics", _MEANS_SQL)
def _(spark, sf):
    return evaluation.eval_heuristics(_samples(spark, sf))


@add("eval_gate", "SELECT *, CASE WHEN score >= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM ("
     + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS score, {t}::DOUBLE AS threshold FROM ({_MEANS_SQL})"
                          for m, t in V.EVAL_THRESHOLDS.items()) + ")")
def _(spark, sf):
    return evaluation.eval_gate(evaluation.eval_heuristics(_samples(spark, sf)))


def _retrieved(spark, sf):
    """Questions answered by their best clause; the contexts are the retrieved chunks, best first."""
    hits = D.hits(spark, sf)  # written: one search for the contexts and the answers
    best = rerank.rerank(hits, n=V.RERANK_TOP_N).filter("rerank_rank = 1").select("query_id", F.col("chunk_text").alias("answer"))
    return evaluation.retrieved_samples(hits).join(best, F.col("id") == F.col("query_id")).drop("query_id")


_RETRIEVED_SQL = f"""
SELECT id, CASE WHEN {strip('ctx')} = '' THEN 0.5 ELSE {_overlap('answer', 'ctx')} END AS faithfulness,
       {_overlap('answer', 'question')} AS answer_relevancy,
       CASE WHEN {strip('ctx')} = '' THEN 0.5 ELSE {_overlap('ctx', 'question')} END AS context_precision
FROM (SELECT query_id AS id, query AS question, string_agg(chunk_text, ' ' ORDER BY rank) AS ctx FROM hits GROUP BY ALL)
JOIN (SELECT query_id AS id, chunk_text AS answer FROM clauses WHERE rerank_rank = 1) USING (id)"""
_RETRIEVED_MEANS_SQL = f"""
SELECT round_even(avg(faithfulness), 3) AS faithfulness, round_even(avg(answer_relevancy), 3) AS answer_relevancy,
       round_even(avg(context_precision), 3) AS context_precision FROM ({_RETRIEVED_SQL})"""


@add("ragas_retrieved", f"""
SELECT id, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy,
       round(context_precision, 6) AS context_precision FROM ({_RETRIEVED_SQL})""")
def _(spark, sf):
    return rounded(evaluation.ragas_token_overlap(_retrieved(spark, sf)))


@add("eval_heuristics_retrieved", _RETRIEVED_MEANS_SQL)
def _(spark, sf):
    return evaluation.eval_heuristics(_retrieved(spark, sf))


@add("eval_gate_retrieved", "SELECT *, CASE WHEN score >= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM ("
     + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS score, {t}::DOUBLE AS threshold FROM ({_RETRIEVED_MEANS_SQL})"
                          for m, t in V.EVAL_THRESHOLDS.items()) + ")")
def _(spark, sf):
    return evaluation.eval_gate(evaluation.eval_heuristics(_retrieved(spark, sf)))


@add("answer_length_breakdown", """
SELECT id, substr(question, 1, 60) AS question, CAST(length(answer) AS INT) AS answer_len,
       CAST(length(question) AS INT) AS ground_truth_len FROM pairs""")
def _(spark, sf):
    return evaluation.answer_length_breakdown(_samples(spark, sf))


@add("max_samples", "SELECT id, question FROM pairs ORDER BY id LIMIT 20")
def _(spark, sf):
    return evaluation.max_samples(_samples(spark, sf), 20).select("id", "question")

"""Queries over sources, sinks and streams: they write derived feeds to the shared folder and read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import gold, search, silver
from ..operators.evaluation import question_answer_pairs
from ..operators.quality import expect
from ..session import scratch_path
from ..sources import envelopes as E
from ..sources import files, snapshots
from ..streaming import feeds
from . import medallion
from . import views as D
from .checks_market import _IMBALANCE, _WINDOWS, TIGHT, TIGHT_SQL
from .reference_sql import PREPARED, hourly, tag_case, text_list, with_tables, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def stamp():
    """The ingestion time of all made feeds."""
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def add(name: str, sql: str | None = None):
    """Register a query under its name, together with its check SQL."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return keep


# --- feeds made from the given tables -----------------------------------------------


def price_envelopes(spark, sf) -> DataFrame:
    """One envelope per market and day; the payload carries epoch milliseconds."""
    rows = D.prices(spark, sf).select(
        "market", "delivery_date", "hour", F.unix_millis("delivery_ts").alias("delivery_ts"), "price_eur_mwh",
        "is_negative",
    ).withColumn("_m", F.col("market"))
    feed = rows.select("delivery_ts", "hour", "price_eur_mwh", "is_negative", F.col("_m").alias("market"), "delivery_date")
    out = E.daily_envelopes(feed.withColumn("feed", F.col("market")), order_by=["delivery_ts"], keys=["feed"],
                            constants={"source_api": F.lit("day-ahead")}, ingestion_ts=stamp())
    return out.withColumnRenamed("feed", "market").select(*[f.name for f in S.PRICE_ENVELOPE])


def generation_envelopes(spark, sf) -> DataFrame:
    iso = F.date_format("delivery_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = D.generation(spark, sf).withColumn("delivery_ts", iso)
    return E.daily_envelopes(rows, order_by=["delivery_ts"], ingestion_ts=stamp(), constants={
        "source_api": F.lit("generation"), "country": F.lit("NL"),
    }).select(*[f.name for f in S.GENERATION_ENVELOPE])


def congestion_envelopes(spark, sf) -> DataFrame:
    """Event announcements; a day is spread over several envelopes, as its number of events has no bound."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    rows = D.congestion(spark, sf).withColumns({
        "day": F.to_date("start_time"), "start_time": F.date_format("start_time", iso),
        "end_time": F.date_format("end_time", iso),
    })
    return E.daily_envelopes(rows, date_col="day", order_by=["event_id"], max_rows=500, ingestion_ts=stamp(), constants={
        "source": F.lit("congestion"),
    }).select(*[f.name for f in S.CONGESTION_ENVELOPE])


def imbalance_envelopes(spark, sf) -> DataFrame:
    """One envelope per market and day with the last event value of each hour, delivered twice."""
    late = D.hourly(D.events(spark, sf), latest=True)
    rows = late.select(
        F.unix_millis("delivery_ts").alias("delivery_ts"), "market", F.col("price_eur_mwh").alias("imbalance_price"), "delivery_date",
        F.col("market").alias("feed"),
    )
    first = rows.withColumn("imbalance_price", F.col("imbalance_price") + 1)  # an earlier delivery, since corrected
    made = [
        E.daily_envelopes(df, order_by=["delivery_ts"], keys=["feed"], constants={"source_api": F.lit("imbalance")}, ingestion_ts=at)
        for df, at in ((first, stamp() - F.expr("INTERVAL 1 DAY")), (rows, stamp()))
    ]
    return made[0].unionByName(made[1]).withColumnRenamed("feed", "market").select(*[f.name for f in S.IMBALANCE_ENVELOPE])


def _written(envelopes: DataFrame, spark, name: str) -> str:
    path = scratch_path(spark, name)
    envelopes.write.json(path)
    return path


def _drained(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything there is and read the table it wrote."""
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    feeds.run_to_end(feeds.append_stream(stream, out, checkpoint=state))
    return spark.read.schema(stream.schema).parquet(out)


_PRICE_ROWS = "market, delivery_ts, delivery_date, hour, price_eur_mwh, is_negative"
_SILVER_PRICE_SQL = f"SELECT {_PRICE_ROWS}, delivery_date AS fetch_date, TIMESTAMP '2024-02-01 00:00:00' AS ingestion_ts FROM prices"
_SILVER_GENERATION_SQL = "SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS ingestion_ts FROM generation"
_SILVER_CONGESTION_SQL = "SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS ingestion_ts FROM congestion"


# --- conformed rows ----------------------------------------------------------------------


@add("silver_prices", _SILVER_PRICE_SQL)
def _(spark, sf):
    return silver.silver_prices(price_envelopes(spark, sf))


@add("silver_generation", _SILVER_GENERATION_SQL)
def _(spark, sf):
    return silver.silver_generation(generation_envelopes(spark, sf))


@add("silver_congestion", _SILVER_CONGESTION_SQL)
def _(spark, sf):
    twice = congestion_envelopes(spark, sf)
    return silver.silver_congestion(twice.unionByName(twice))


@add("payload_explode", "SELECT market, hour, price_eur_mwh FROM prices")
def _(spark, sf):
    rows = silver.payload_rows(price_envelopes(spark, sf), S.PRICE_ROW, ["fetch_date"])
    return rows.select("row.market", "row.hour", "row.price_eur_mwh")


@add("imbalance_feed", f"SELECT * FROM ({_IMBALANCE})")
def _(spark, sf):
    # From envelopes in files to conformed rows, the latest delivery next to the day-ahead price.
    path = _written(imbalance_envelopes(spark, sf), spark, "imbalance")
    rows = medallion.conformed("imbalance", E.read_envelopes(spark, path, schema=S.IMBALANCE_ENVELOPE, rescue=True))
    return gold.imbalance_prices(D.prices(spark, sf), rows)


@add("sink_daily_envelopes", """
SELECT market, CAST(delivery_date AS VARCHAR) AS fetch_date, count(*) AS n_rows,
       CAST(min(epoch_ms(delivery_ts)) AS BIGINT) AS first_ms, round(sum(price_eur_mwh), 6) AS price_sum
FROM prices GROUP BY market, delivery_date""")
def _(spark, sf):
    path = scratch_path(spark, "envelopes")
    E.write_daily_envelopes(price_envelopes(spark, sf), path)
    back = E.read_envelopes(spark, path).select(
        "market", "fetch_date",
        F.from_json("raw_payload", "array<struct<delivery_ts:bigint,price_eur_mwh:double>>").alias("_p"),
    )
    return back.select(
        "market", "fetch_date", F.size("_p").cast("bigint").alias("n_rows"),
        F.get("_p", F.lit(0))["delivery_ts"].alias("first_ms"),
        F.round(F.aggregate("_p", F.lit(0.0), lambda a, r: a + r["price_eur_mwh"]), 6).alias("price_sum"),
    )


# --- sources ---------------------------------------------------------------------------------

_FEED_SQL = "SELECT {0}, count(*) AS n_envelopes, true AS has_file FROM (SELECT DISTINCT {1} FROM {2}) GROUP BY {0}"


def _arrivals(spark, envelopes: DataFrame, schema, name: str, by: str) -> DataFrame:
    path = _written(envelopes, spark, name)
    raw = _drained(spark, E.read_envelopes(spark, path, schema=schema, stream=True), f"{name}-bronze")
    return raw.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_envelopes"), F.bool_and(F.col("_source_file").isNotNull()).alias("has_file")
    )


@add("src_price_stream", _FEED_SQL.format("market", "market, delivery_date", "prices"))
def _(spark, sf):
    return _arrivals(spark, price_envelopes(spark, sf), S.PRICE_ENVELOPE, "prices", "market")


@add("src_generation_stream", _FEED_SQL.format("country", "country, delivery_date", "generation"))
def _(spark, sf):
    return _arrivals(spark, generation_envelopes(spark, sf), S.GENERATION_ENVELOPE, "generation", "country")


@add("src_congestion_stream", "SELECT count(*) AS n_events, count(DISTINCT event_id) AS n_ids FROM congestion")
def _(spark, sf):
    path = _written(congestion_envelopes(spark, sf), spark, "congestion")
    raw = _drained(spark, E.read_envelopes(spark, path, schema=S.CONGESTION_ENVELOPE, stream=True), "congestion-bronze")
    events = silver.congestion_rows(raw)
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("event_id").alias("n_ids"))


@add("src_envelope_schema", """
SELECT market, count(DISTINCT delivery_date) AS n_envelopes,
       'fetch_date,ingestion_ts,market,raw_payload,source_api' AS columns FROM prices GROUP BY market""")
def _(spark, sf):
    path = _written(price_envelopes(spark, sf), spark, "inferred")
    schema = E.load_schema(E.infer_envelope_schema(spark, path))
    names = ",".join(sorted(schema.fieldNames()))
    raw = E.read_envelopes(spark, path, schema=schema)
    return raw.groupBy("market").agg(F.count(F.lit(1)).alias("n_envelopes")).withColumn("columns", F.lit(names))


#: Pages of one file where pages are bound into files.
PAGES_PER_FILE = 40


def _document_folder(spark, sf, *, pages: int = 1) -> str:
    """Pages as text files, ``pages`` to a file, a folder each, whose name has the number."""
    path = scratch_path(spark, "documents")
    bound = D.table(spark, sf, "pages").select(F.expr(f"page_id div {pages}").alias("file"), "html")
    files.write_texts(bound, path, key="file", text="html")
    return path


def _files_of(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("contract_id").try_cast("bigint").alias("file"), "file_size_bytes", F.col("last_modified").isNotNull().alias("dated"),
        F.endswith("path", F.lit(".txt")).alias("is_text"),
    )


_READ = {"glob": "*.txt", "id_pattern": r"file=([^/]+)/"}
_DOCUMENT_SQL = """
SELECT page_id // {0} AS file, CAST(sum({1}) AS BIGINT) AS file_size_bytes, true AS dated, true AS is_text
FROM pages {2} GROUP BY ALL"""
#: A file a page; a page without HTML is a file with an empty line.
_PAGE_SQL = _DOCUMENT_SQL.format(1, "coalesce(strlen(html), 0) + 1", "")


@add("src_document_stream", _PAGE_SQL)
def _(spark, sf):
    found = files.read_documents(spark, _document_folder(spark, sf), stream=True, **_READ)
    return _files_of(_drained(spark, found, "documents-bronze"))


@add("files_sorted", _PAGE_SQL)
def _(spark, sf):
    return _files_of(files.files_sorted(files.read_documents(spark, _document_folder(spark, sf), **_READ)))


@add("src_pdf_dir_filtered", _DOCUMENT_SQL.format(
    PAGES_PER_FILE, "strlen(html) + 1", f"WHERE page_id // {PAGES_PER_FILE} IN (SELECT item_id FROM benchmark WHERE item_id % 3 <> 0)"))
def _(spark, sf):
    # The keep-list names some of the files that are there, and some that are not.
    keep = D.table(spark, sf, "benchmark").filter("item_id % 3 <> 0").select(F.col("item_id").cast("string").alias("contract_id"))
    return _files_of(files.read_documents(spark, _document_folder(spark, sf, pages=PAGES_PER_FILE), keep=keep, **_READ))


@add("src_parquet_chunks", f"SELECT chunk_id, contract_id, {tag_case('lower(chunk_text)')} AS risk_category, false AS missing FROM plain_chunks")
def _(spark, sf):
    path = scratch_path(spark, "chunks")
    before = files.read_chunks(spark, path)
    files.write_chunks(D.chunks(spark, sf), path)
    both = before.unionByName(files.read_chunks(spark, path))
    return both.select("chunk_id", "contract_id", "risk_category", F.lit(False).alias("missing"))


@add("sink_parquet", "SELECT contract_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_words FROM plain_chunks GROUP BY contract_id")
def _(spark, sf):
    path = scratch_path(spark, "chunks")
    files.write_chunks(D.chunks(spark, sf), path)
    return files.read_chunks(spark, path).groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_words")
    )


def _csv_folder(spark, sf) -> str:
    path = scratch_path(spark, "csv")
    D.prices(spark, sf).select(F.col("delivery_ts").alias("delivery_start"), "market", "price_eur_mwh").repartition(
        "market"
    ).write.option("header", True).csv(path)
    return path


@add("src_csv_union", "SELECT market, delivery_ts AS ts, price_eur_mwh AS price FROM prices")
def _(spark, sf):
    return files.read_csv_prices(spark, _csv_folder(spark, sf))


@add("csv_union_all", f"""
SELECT market, ts, price, source FROM (
  SELECT market, delivery_ts AS ts, price_eur_mwh AS price, NULL AS source FROM prices
  UNION ALL SELECT market, delivery_ts, price_eur_mwh, 'late' FROM ({hourly('last')}))""")
def _(spark, sf):
    late = D.hourly(D.events(spark, sf), latest=True).select(
        "market", F.col("delivery_ts").alias("ts"), F.col("price_eur_mwh").alias("price"), F.lit("late").alias("source")
    )
    return files.union_all(files.read_csv_prices(spark, _csv_folder(spark, sf)), late)


@add("src_eval_json", "SELECT id, question, answer AS ground_truth, 2 AS n_expected FROM pairs")
def _(spark, sf):
    pairs = question_answer_pairs(D.table(spark, sf, "conversations"))
    item = F.struct(
        "id", "question", F.array(F.lit("7.1"), F.lit("7.2")).alias("expected_clause_ids"),
        F.col("answer").alias("ground_truth"),
    )
    # One pretty-printed JSON array per file, in a fixed number of files.
    arrays = pairs.groupBy(F.pmod(F.xxhash64("id"), F.lit(32)).alias("_b")).agg(F.collect_list(item).alias("_items"))
    path = scratch_path(spark, "eval")
    text = F.to_json("_items", {"pretty": "true"})
    arrays.select(text.alias("value"), F.col("_b").alias("bucket")).repartition("bucket").write.partitionBy("bucket").text(path)
    items = files.read_eval_items(spark, path)
    return items.select("id", "question", "ground_truth", F.size("expected_clause_ids").alias("n_expected"))


@add("src_html_table", """
SELECT event_id, 0 AS row_no, dso_zone AS "Zone", direction AS "Direction", strftime(start_time, '%Y-%m-%d %H:%M:%S') AS "Start",
       CAST(mw_needed AS VARCHAR) AS "MW" FROM congestion""")
def _(spark, sf):
    # One results page per event, as the public page shows it.
    cell = [F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in ("dso_zone", "direction", "start_time", "mw_needed")]
    page = F.concat(
        F.lit("<html><body><p>Results</p><table><tr><th>Zone</th><th>Direction</th><th>Start</th><th>MW</th></tr><tr>"),
        *cell, F.lit("</tr></table><table><tr><td>other</td></tr></table></body></html>"),
    )
    pages = D.congestion(spark, sf).select("event_id", page.alias("html"))
    return files.parse_html_tables(pages, key="event_id", html_col="html", columns=["Zone", "Direction", "Start", "MW"])


# --- keyed tables ---------------------------------------------------------------------------

_OLD_END, _NEW_START = "2024-01-20 00:00:00", "2024-01-10 00:00:00"
_OLD_SQL = f"SELECT market, delivery_ts, price_eur_mwh FROM ({hourly('first', f'''ts < TIMESTAMP '{_OLD_END}' ''')})"
_NEW_SQL = f"SELECT market, delivery_ts, price_eur_mwh FROM ({hourly('last', f'''ts >= TIMESTAMP '{_NEW_START}' ''')})"
_KEY = ["market", "delivery_ts"]


def _old_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Prices up to one day, and their revision from an earlier day on."""
    events = D.events(spark, sf)
    old = D.hourly(events.filter(F.col("ts") < F.lit(_OLD_END)))
    new = D.hourly(events.filter(F.col("ts") >= F.lit(_NEW_START)), latest=True)
    return old.select(*_KEY, "price_eur_mwh"), new.select(*_KEY, "price_eur_mwh")


_MERGED_SQL = f"""
SELECT * FROM ({_NEW_SQL}) UNION ALL
SELECT o.* FROM ({_OLD_SQL}) o WHERE NOT EXISTS (SELECT 1 FROM ({_NEW_SQL}) n
  WHERE n.market = o.market AND n.delivery_ts = o.delivery_ts)"""


@add("sink_upsert", _MERGED_SQL)
def _(spark, sf):
    old, new = _old_new(spark, sf)
    path = scratch_path(spark, "keyed")
    snapshots.upsert(spark, path, old, key=_KEY)
    snapshots.upsert(spark, path, new, key=_KEY)
    return snapshots.read_snapshot(spark, path)


@add("upsert_union", _MERGED_SQL)
def _(spark, sf):
    old, new = _old_new(spark, sf)
    return snapshots.upsert_union(old, new, key=_KEY)


@add("upsert_anti_join", f"""
SELECT o.* FROM ({_OLD_SQL}) o WHERE NOT EXISTS (SELECT 1 FROM ({_NEW_SQL}) n
  WHERE n.market = o.market AND n.delivery_ts = o.delivery_ts)""")
def _(spark, sf):
    old, new = _old_new(spark, sf)
    return snapshots.upsert_anti_join(old, new, key=_KEY)


@add("sink_kv_upsert", """
SELECT concat('contract.', contract_id) AS config_key, CAST(strike_price_eur AS VARCHAR) AS config_value,
       TIMESTAMP '2024-02-01 00:00:00' AS updated_ts FROM contracts""")
def _(spark, sf):
    path = scratch_path(spark, "settings")
    key = F.concat(F.lit("contract."), F.col("contract_id")).alias("config_key")
    book = D.contracts(spark, sf)
    draft = book.select(key, F.lit("unset").alias("config_value"), F.to_timestamp(F.lit("2024-01-01")).alias("updated_ts"))
    final = book.select(key, F.col("strike_price_eur").cast("string").alias("config_value"), stamp().alias("updated_ts"))
    snapshots.upsert(spark, path, draft, key=["config_key"])
    snapshots.upsert(spark, path, final, key=["config_key"])
    return snapshots.read_snapshot(spark, path)


@add("cdf_incremental_refresh", f"""
SELECT coalesce(o.market, n.market) AS market, coalesce(o.delivery_ts, n.delivery_ts) AS delivery_ts, n.price_eur_mwh,
       CASE WHEN o.market IS NULL THEN 'insert' WHEN n.market IS NULL THEN 'delete' ELSE 'update' END AS "_change"
FROM ({_OLD_SQL}) o FULL JOIN ({_NEW_SQL}) n ON o.market = n.market AND o.delivery_ts = n.delivery_ts
WHERE o.market IS NULL OR n.market IS NULL OR o.price_eur_mwh <> n.price_eur_mwh""")
def _(spark, sf):
    return snapshots.snapshot_diff(*_old_new(spark, sf), key=_KEY)


@add("cdf_vector_refresh", f"""
SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
  SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % 32 AS INT) AS slot, count(*) AS n
  FROM (SELECT doc_id, unnest({words('lower(text)')}) AS token FROM documents) GROUP BY ALL)""")
def _(spark, sf):
    # Vectors of an older state of the documents, brought up to date by the difference alone.
    new = D.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" older"))).otherwise(F.col("text"))
    old = new.filter("doc_id % 7 <> 0").withColumn("text", changed)
    gone = new.filter("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    vectors = lambda rows: search.embed_text(rows, key="doc_id", text="text", dim=32)
    old = old.unionByName(gone)
    changes = snapshots.snapshot_diff(old, new, key=["doc_id"])
    fresh = snapshots.apply_changes(vectors(old), changes, vectors, key=["doc_id"])
    long = fresh.select("doc_id", F.posexplode("embedding").alias("slot", "weight")).filter("weight > 0")
    return long.withColumn("weight", F.round("weight", 6))


@add("feedback_append", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, text AS query, CAST(NULL AS VARCHAR) AS response_summary, turn % 2 = 0 AS thumbs_up,
       role AS comment, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM conversations""")
def _(spark, sf):
    path = scratch_path(spark, "feedback")
    files.feedback_append(files.feedback_table(spark), path)
    rows = D.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("text").alias("query"), F.lit(None).alias("response_summary"),
        (F.col("turn") % 2 == 0).alias("thumbs_up"), F.col("role").alias("comment"), stamp().alias("created_at"),
    )
    files.feedback_append(rows, path)
    return spark.read.schema(S.FEEDBACK).parquet(path)


# --- streams ----------------------------------------------------------------------------------


def _price_files(spark, sf, *, flush: bool) -> DataFrame:
    """The price table as a stream of files; ``flush`` adds a last hour that closes all windows."""
    rows = D.prices(spark, sf)
    path = scratch_path(spark, "price-files")
    rows.write.parquet(path)
    stream = feeds.parquet_stream(spark, path, rows.schema)
    if flush:
        end = scratch_path(spark, "price-end")
        last = rows.agg(F.max("delivery_ts").alias("t")).select(
            F.lit("end-of-feed").alias("market"), (F.col("t") + F.expr("INTERVAL 30 DAYS")).alias("delivery_ts"),
            F.to_date(F.col("t") + F.expr("INTERVAL 30 DAYS")).alias("delivery_date"), F.hour("t").alias("hour"),
            F.lit(-1.0).alias("price_eur_mwh"), F.lit(True).alias("is_negative"),
        )
        last.write.parquet(end)
        stream = stream.unionByName(feeds.parquet_stream(spark, end, rows.schema))
    return stream


@add("sink_append_stream", "SELECT * FROM prices")
def _(spark, sf):
    return _drained(spark, _price_files(spark, sf, flush=False), "appended")


def _streamed_lake(spark: SparkSession, sf: str) -> str:
    """The folder of a pipeline run over streams of all three feeds."""
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "lake")
    price_envelopes(spark, sf).write.json(f"{inbox}/prices")
    generation_envelopes(spark, sf).write.json(f"{inbox}/generation")
    congestion_envelopes(spark, sf).write.json(f"{inbox}/congestion")
    medallion.run_streams(spark, inbox, out)
    return out


@add("stream_bronze_silver", f"SELECT {_PRICE_ROWS}, delivery_date AS fetch_date, TIMESTAMP '2024-02-01 00:00:00' AS ingestion_ts FROM prices")
def _(spark, sf):
    return medallion.read_table(spark, f"{_streamed_lake(spark, sf)}/silver/prices")


@add("stream_bronze_silver_generation", _SILVER_GENERATION_SQL)
def _(spark, sf):
    return medallion.read_table(spark, f"{_streamed_lake(spark, sf)}/silver/generation")


@add("stream_bronze_silver_congestion", _SILVER_CONGESTION_SQL)
def _(spark, sf):
    return medallion.read_table(spark, f"{_streamed_lake(spark, sf)}/silver/congestion")


@add("stream_bronze_raw", "SELECT market, CAST(delivery_date AS VARCHAR) AS fetch_date, count(*) AS n_rows, true AS readable, true AS has_file "
     "FROM prices GROUP BY ALL")
def _(spark, sf):
    raw = spark.read.parquet(f"{_streamed_lake(spark, sf)}/bronze/prices")
    return raw.select(
        "market", "fetch_date", F.json_array_length("raw_payload").cast("bigint").alias("n_rows"),
        F.col("_rescued").isNull().alias("readable"), F.col("_source_file").isNotNull().alias("has_file"),
    )


#: Documents of one contract file.
DOCUMENTS_PER_CONTRACT = 50
_CONTRACT_READ = {"glob": "*.txt", "id_pattern": r"contract=([^/]+)/"}


def _contract_folder(spark, sf) -> str:
    """Contract files as text: the blocks of some dozens of documents, one after the other."""
    inbox = scratch_path(spark, "contract-inbox")
    number = F.substring("contract_id", 5, 20).cast("bigint")
    lines = D.blocks(spark, sf).withColumn("number", number).withColumn("contract", F.concat(F.lit("bundle-"), F.expr(f"number div {DOCUMENTS_PER_CONTRACT}")))
    files.write_texts(lines, f"{inbox}/contracts", key="contract", text="text", order=["number", "block_no"])
    return inbox


_BOUND_BLOCKS = f"""
    SELECT concat('bundle-', n // {DOCUMENTS_PER_CONTRACT}) AS contract_id, 1 AS page,
           CAST(row_number() OVER (PARTITION BY n // {DOCUMENTS_PER_CONTRACT} ORDER BY n, block_no) - 1 AS INT) AS block_no, text
    FROM (SELECT *, CAST(substr(contract_id, 5) AS BIGINT) AS n FROM ({PREPARED['raw_blocks'].strip()}))"""
_CHUNKS_SQL = with_tables("SELECT * FROM chunks").replace(PREPARED["raw_blocks"].strip(), _BOUND_BLOCKS.strip())


ORACLES["stream_bronze_silver_documents"] = _CHUNKS_SQL
ORACLES["stream_chunk_rules"] = _CHUNKS_SQL.replace("SELECT * FROM chunks", """
SELECT 'contract_chunks' AS "table", unnest(['non_null_chunk_text', 'non_null_contract_id']) AS rule,
       unnest([count(*) FILTER (WHERE chunk_text IS NULL), count(*) FILTER (WHERE contract_id IS NULL)]) AS failed FROM chunks""")


@add("stream_bronze_silver_documents")
def _(spark, sf):
    inbox, out = _contract_folder(spark, sf), scratch_path(spark, "lake")
    medallion.drain_documents(spark, inbox, out, extractor=medallion.plain_text, max_files=40, **_CONTRACT_READ)
    return medallion.contract_chunks(spark, out)


@add("stream_chunk_rules")
def _(spark, sf):
    inbox, out = _contract_folder(spark, sf), scratch_path(spark, "lake")
    medallion.drain_documents(spark, inbox, out, extractor=medallion.plain_text, **_CONTRACT_READ)
    return spark.read.parquet(f"{out}/metrics").groupBy("table", "rule").agg(F.sum("failed").alias("failed"))


@add("expect_warn_counts", f"""
SELECT how, rule, CASE rule WHEN 'valid_price_range' THEN n ELSE 0 END AS failed FROM
  (SELECT count(*) FILTER (WHERE NOT ({TIGHT_SQL})) AS n FROM prices), unnest(['batch', 'stream']) AS h(how),
  unnest({text_list(TIGHT)}) AS r(rule)""")
def _(spark, sf):
    """What a batch and a stream observed while they passed all rows on."""
    rows = D.prices(spark, sf)
    path, out, seen = scratch_path(spark, "price-files"), scratch_path(spark, "warned"), Observation()
    expect(rows, TIGHT, action="warn", observation=seen).write.parquet(path)
    stream = expect(feeds.parquet_stream(spark, path, rows.schema), TIGHT, action="warn", observation="price_rules")
    query = feeds.append_stream(stream, out, checkpoint=scratch_path(spark, "state"))
    feeds.run_to_end(query)
    found = {"batch": seen.get, "stream": feeds.observed(query, "price_rules")}
    counts = [(how, rule, int(n)) for how, rules in found.items() for rule, n in rules.items()]
    return spark.createDataFrame(counts, "how string, rule string, failed long")


@add("stream_dedupe", "SELECT * FROM congestion")
def _(spark, sf):
    path = scratch_path(spark, "announcements")
    rows = D.congestion(spark, sf)
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    return _drained(spark, feeds.stream_dedupe(feeds.parquet_stream(spark, path, rows.schema)), "deduped")


@add("stream_tumbling_negative", """
SELECT market, time_bucket(INTERVAL 6 HOUR, delivery_ts, TIMESTAMP '2024-01-01') AS window_start,
       time_bucket(INTERVAL 6 HOUR, delivery_ts, TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR AS window_end,
       round(avg(price_eur_mwh), 6) AS avg_negative_price, min(price_eur_mwh) AS min_price, count(*) AS negative_hours_in_window
FROM prices WHERE is_negative GROUP BY ALL""")
def _(spark, sf):
    stream = feeds.stream_tumbling_negative(_price_files(spark, sf, flush=True), width="6 hours")
    out = _drained(spark, stream, "tumbling").filter("market <> 'end-of-feed'")
    return out.withColumn("avg_negative_price", F.round("avg_negative_price", 6))


@add("stream_session_negative", _WINDOWS)
def _(spark, sf):
    stream = feeds.stream_session_negative(_price_files(spark, sf, flush=True))
    out = _drained(spark, stream, "sessions").filter("market <> 'end-of-feed'")
    return out.withColumn("avg_price", F.round("avg_price", 6))


@add("stream_late_data", """
SELECT market, delivery_ts, price_eur_mwh, delivery_ts < (SELECT max(delivery_ts) FROM prices) - INTERVAL 7 DAY AS late FROM prices
UNION ALL SELECT market, delivery_ts, price_eur_mwh, false FROM prices""")
def _(spark, sf):
    # The feed arrives whole, then once more: of the second arrival only the last week is in time.
    rows = D.prices(spark, sf).select("market", "delivery_ts", "price_eur_mwh")
    inbox, out, late, state = (scratch_path(spark, n) for n in ("inbox", "in-time", "too-late", "state"))
    for _arrival in range(2):
        rows.write.mode("append").parquet(inbox)
        feeds.run_to_end(feeds.split_late(
            feeds.parquet_stream(spark, inbox, rows.schema), event_time="delivery_ts", delay="7 days",
            path=out, late_path=late, checkpoint=state,
        ))
    return spark.read.parquet(out).withColumn("late", F.lit(False)).unionByName(
        spark.read.parquet(late).withColumn("late", F.lit(True))
    ).drop("batch_id")


@add("stream_upsert", _MERGED_SQL)
def _(spark, sf):
    old, new = _old_new(spark, sf)
    inbox, table, state = (scratch_path(spark, n) for n in ("inbox", "keyed", "state"))
    for batch in (old, new):
        batch.write.mode("append").parquet(inbox)
        feeds.run_to_end(feeds.stream_upsert(
            feeds.parquet_stream(spark, inbox, old.schema), table, key=_KEY, checkpoint=state
        ))
    return snapshots.read_snapshot(spark, table)



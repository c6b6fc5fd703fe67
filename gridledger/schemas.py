"""Declared schemas of raw, conformed and derived tables."""

from pyspark.sql import types as T

PRICE_ENVELOPE = T.StructType([
    T.StructField("source_api", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("fetch_date", T.StringType()),
    T.StructField("ingestion_ts", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
])
GENERATION_ENVELOPE = T.StructType([
    T.StructField("source_api", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("fetch_date", T.StringType()),
    T.StructField("ingestion_ts", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
])
CONGESTION_ENVELOPE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("ingestion_ts", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
])

PRICE_ROW = T.StructType([
    T.StructField("hour", T.IntegerType()),
    T.StructField("delivery_ts", T.StringType()),
    T.StructField("price_eur_mwh", T.DoubleType()),
    T.StructField("is_negative", T.BooleanType()),
    T.StructField("market", T.StringType()),
])
GENERATION_ROW = T.StructType([
    T.StructField("delivery_ts", T.StringType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("wind_onshore_mw", T.DoubleType()),
    T.StructField("wind_offshore_mw", T.DoubleType()),
    T.StructField("solar_mw", T.DoubleType()),
    T.StructField("total_renewable_mw", T.DoubleType()),
    T.StructField("total_mw", T.DoubleType()),
    T.StructField("renewable_pct", T.DoubleType()),
    T.StructField("oversupply_flag", T.BooleanType()),
    T.StructField("country", T.StringType()),
])
CONGESTION_ROW = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("dso_zone", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("mw_needed", T.DoubleType()),
    T.StructField("price_eur_mwh", T.DoubleType()),
    T.StructField("status", T.StringType()),
])
IMBALANCE_ENVELOPE = PRICE_ENVELOPE
IMBALANCE_ROW = T.StructType([
    T.StructField("delivery_ts", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("imbalance_price", T.DoubleType()),
])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("contract_id", T.StringType()),
    T.StructField("chunk_text", T.StringType()),
    T.StructField("clause_id", T.StringType()),
    T.StructField("section_title", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("risk_category", T.StringType()),
    T.StructField("char_start", T.IntegerType()),
])
FEEDBACK = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("response_summary", T.StringType()),
    T.StructField("thumbs_up", T.BooleanType()),
    T.StructField("comment", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
EVAL_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_clause_ids", T.ArrayType(T.StringType())),
    T.StructField("expected_risk_category", T.StringType()),
    T.StructField("expected_severity", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
])
HIT_COLUMNS = [
    "chunk_id", "contract_id", "clause_id", "section_title", "risk_category", "chunk_text",
]

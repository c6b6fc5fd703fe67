"""Queries over scored clauses, flags and reports, each with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..operators import gold, report, risk
from ..session import cut
from . import views as D
from .reference_sql import text, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FLAG = "query_id, flag_id, contract_id, clause_id, risk_category, severity, description, exposure_eur"


def add(name: str, sql: str | None = None):
    """Register a query under its name, together with its check SQL."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return keep


@add("clause_market_cross", """
SELECT query_id, chunk_id, market, negative_hours_90d, avg_negative_price, has_congestion FROM clause_state""")
def _(spark, sf):
    rows = risk.clause_market_cross(D.clauses(spark, sf), D.market_stats(spark, sf))
    return rows.select("query_id", "chunk_id", "market", "negative_hours_90d", "avg_negative_price", "has_congestion")


@add("has_congestion", "SELECT market, bool_or(signal_type = 'oversupply') AS has_congestion FROM top_signals GROUP BY market")
def _(spark, sf):
    return risk.has_congestion(D.top_signals(spark, sf))


@add("score_clauses", f"SELECT {_FLAG}, rerank_rank FROM scored")
def _(spark, sf):
    return D.scored(spark, sf).select("query_id", *risk.FLAG_COLUMNS, "rerank_rank")


@add("flag_descriptions", "SELECT DISTINCT risk_category, severity, description FROM scored")
def _(spark, sf):
    return D.scored(spark, sf).select("risk_category", "severity", "description").distinct()


@add("flag_id", """
SELECT chunk_id, substr(md5(concat(contract_id, ':', clause_id, ':', risk_category)), 1, 12) AS flag_id
FROM chunks WHERE risk_category IS NOT NULL""")
def _(spark, sf):
    rows = D.chunks(spark, sf).filter("risk_category IS NOT NULL")
    return rows.select("chunk_id", X.flag_id(F.col("contract_id"), F.col("clause_id"), F.col("risk_category")).alias("flag_id"))


@add("flag_keep_first", f"SELECT {_FLAG}, rerank_rank FROM first_flags")
def _(spark, sf):
    return risk.flag_keep_first(D.scored(spark, sf))


@add("flags_by_severity", f"SELECT {_FLAG}, rerank_rank, flag_order FROM flags")
def _(spark, sf):
    return D.flags(spark, sf)


@add("risk_flags", f"SELECT {_FLAG}, rerank_rank, flag_order FROM flags")
def _(spark, sf):
    return risk.risk_flags(risk.clause_market_cross(D.clauses(spark, sf), D.market_stats(spark, sf)))


@add("exposure_total", """
SELECT query_id, CASE WHEN sum(exposure_eur) > 0 THEN sum(exposure_eur) END AS total_exposure_eur FROM flags GROUP BY query_id""")
def _(spark, sf):
    return risk.exposure_total(D.flags(spark, sf), by=["query_id"])


@add("portfolio_sweep", """
SELECT contract_id, risk_category, CAST(grouping(contract_id, risk_category) AS BIGINT) AS level, count(*) AS n_flags,
       coalesce(sum(exposure_eur), 0) AS exposure_eur FROM flags GROUP BY ROLLUP (contract_id, risk_category)""")
def _(spark, sf):
    return risk.portfolio_sweep(D.flags(spark, sf))


@add("ppa_risk_profile", "SELECT contract_id, " + ", ".join(
    f"coalesce(max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) "
    f"FILTER (WHERE risk_category = '{c}'), 0) AS {c}" for c in V.RISK_TAXONOMY) + " FROM flags GROUP BY contract_id")
def _(spark, sf):
    return risk.ppa_risk_profile(D.flags(spark, sf))


@add("coerce_flag_shape", """
SELECT risk_category, severity, exposure_eur AS financial_exposure_eur, clause_id AS contract_clause,
       description AS market_trigger, CAST(NULL AS VARCHAR) AS recommendation FROM flags""")
def _(spark, sf):
    return report.coerce_flag_shape(D.flags(spark, sf))


# --- contexts ----------------------------------------------------------------------------

_WORST = """
SELECT market, string_agg(concat('  • ', delivery_date, ' H', lpad(CAST(hour AS VARCHAR), 2, '0'), ': ',
         format('{:.1f}', price_eur_mwh), ' €/MWh (', severity, ')'), chr(10) ORDER BY n) AS worst
FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY price_eur_mwh, delivery_date DESC, hour) AS n FROM top_signals)
WHERE n <= 3 GROUP BY market"""
_MARKET_SQL = f"""
SELECT o.market, concat('## Market Context (last 90 days — ', o.market, ' day-ahead)', chr(10), chr(10),
  '- **Negative price hours**: ', coalesce(s.negative_hours_90d, 0), ' hrs across ', coalesce(r.negative_days, 0), ' days', chr(10),
  '- **Average negative price**: ', coalesce(format('{{:.1f}}', s.avg_negative_price), 'n/a'), ' €/MWh', chr(10),
  '- **Worst recorded price**: ', coalesce(format('{{:.1f}}', s.min_price), 'n/a'), ' €/MWh', chr(10),
  '- **High-renewable overlap**: ', o.n, ' negative hours had >70% renewable share', chr(10), chr(10),
  '**Worst hours (sample):**', chr(10), w.worst, chr(10), chr(10), {text(V.MARKET_FOOTER)}, chr(10)) AS market_context
FROM (SELECT market, count(*) FILTER (WHERE renewable_pct > 0.70) AS n FROM top_signals GROUP BY market) o
LEFT JOIN (SELECT * FROM market_stats) s USING (market)
LEFT JOIN (SELECT market, count(DISTINCT delivery_date) AS negative_days FROM daily GROUP BY market) r USING (market)
LEFT JOIN ({_WORST}) w USING (market)"""


def _market_context(spark, sf):
    signals = D.signals(spark, sf)
    stats = gold.negative_stats(signals, by=["market"])
    rollup = gold.portfolio_rollup(gold.portfolio_exposure_daily(signals), by=["market"])
    return report.market_context(D.top_signals(spark, sf), stats, rollup)


@add("market_context", _MARKET_SQL)
def _(spark, sf):
    return _market_context(spark, sf)


_CONTEXT_SQL = """
SELECT query_id, concat('## Retrieved Contract Clauses', chr(10), chr(10), string_agg(concat(
  '**[', rerank_rank, '] ', contract_id, ' — ', clause_id, ' ', section_title,
  CASE WHEN risk_category IS NULL THEN '' ELSE concat(' [', risk_category, ']') END,
  '** (score: ', format('{:.2f}', rerank_score), ')', chr(10), '> ', substr(chunk_text, 1, 400),
  CASE WHEN length(chunk_text) > 400 THEN '...' ELSE '' END, chr(10)), chr(10) ORDER BY rerank_rank)) AS rag_context
FROM clauses GROUP BY query_id"""


@add("format_context", _CONTEXT_SQL)
def _(spark, sf):
    return report.format_context(D.clauses(spark, sf))


_EUR = "format('{{:,}}', CAST({0} AS BIGINT))"
_LINES_SQL = f"""
SELECT query_id, string_agg(concat('[', severity, '] ', contract_id, ' - ', clause_id, ' (', risk_category, ')',
  CASE WHEN exposure_eur <> 0 THEN concat(' | Estimated exposure: EUR ', {_EUR.format('exposure_eur')}, '/year') ELSE '' END,
  chr(10), '  ', description), chr(10) ORDER BY flag_order) AS risk_flags_text FROM flags GROUP BY query_id"""


@add("format_flags", _LINES_SQL)
def _(spark, sf):
    return report.format_flags(D.flags(spark, sf))


def _state(spark, sf):
    """Sessions with their market's facts, and the clauses and flags of each session.

    The clauses are read by several branches, so they are written once: a few
    rows per session.
    """
    sessions = D.questions(spark, sf).join(D.market_stats(spark, sf), "market", "left").withColumn(
        "created_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("query_id") * 60)
    )
    clauses = cut(D.clauses(spark, sf))
    flags = risk.risk_flags(risk.clause_market_cross(clauses, D.market_stats(spark, sf)))
    return sessions, clauses, flags


@add("build_prompt", f"""
SELECT q.query_id, concat_ws(chr(10) || chr(10),
  'Write a short risk narrative for an energy trader: two or three plain paragraphs, no lists.',
  concat('## User Query', chr(10), q.query), coalesce(m.market_context, ''),
  substr(coalesce(c.rag_context, {text(V.NO_CLAUSES)}), 1, 2000),
  concat('## Risk Flags Identified', chr(10), coalesce(l.risk_flags_text, {text(V.NO_FLAGS)})),
  'Name the clauses, give exposure in EUR where it is known, close with one recommended action, and add nothing that is not stated above.'
  ) AS prompt
FROM questions q LEFT JOIN ({_MARKET_SQL}) m USING (market) LEFT JOIN ({_CONTEXT_SQL}) c USING (query_id)
LEFT JOIN ({_LINES_SQL}) l USING (query_id)""")
def _(spark, sf):
    sessions, clauses, flags = _state(spark, sf)
    asked = sessions.select("query_id", "query", "market").join(_market_context(spark, sf), "market", "left")
    return report.build_prompt(asked, report.format_context(clauses), report.format_flags(flags))


_NARRATIVE_SQL = f"""
SELECT q.query_id, CASE WHEN f.query_id IS NULL THEN {text(V.NARRATIVE_EMPTY)} ELSE concat_ws(' ',
  CASE WHEN high > 0 THEN concat('The analysis identified ', high, ' HIGH severity risk flag(s) across ', contracts, ' contract(s)',
    CASE WHEN total <> 0 THEN concat(' with estimated annual exposure of EUR ', {_EUR.format('total')}) ELSE '' END, '. ',
    array_to_string(said[1:2], ' ')) END,
  CASE WHEN medium > 0 THEN concat('Additionally, ', medium, ' MEDIUM severity flag(s) were noted requiring attention during the next contract review cycle.') END,
  {text(V.NARRATIVE_ACTION)}) END AS narrative
FROM questions q LEFT JOIN (
  SELECT query_id, count(*) FILTER (WHERE severity = 'HIGH') AS high,
         count(DISTINCT contract_id) FILTER (WHERE severity = 'HIGH') AS contracts,
         sum(exposure_eur) FILTER (WHERE severity = 'HIGH') AS total, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
         list(concat('In ', contract_id, ', ', clause_id, ' was flagged: ', description) ORDER BY flag_order)
           FILTER (WHERE severity = 'HIGH') AS said
  FROM flags GROUP BY query_id) f USING (query_id)"""


@add("template_narrative", _NARRATIVE_SQL)
def _(spark, sf):
    return report.template_narrative(D.questions(spark, sf), D.flags(spark, sf))


@add("unique_contracts", """
SELECT query_id, string_agg(contract_id, ',' ORDER BY r) AS contract_ids FROM (
  SELECT query_id, contract_id, min(rerank_rank) AS r FROM clauses GROUP BY ALL) GROUP BY query_id""")
def _(spark, sf):
    return report.unique_contracts(D.clauses(spark, sf)).withColumn("contract_ids", F.array_join("contract_ids", ","))


# --- reports -------------------------------------------------------------------------------

_REPORT_SQL = f"""
SELECT CAST(q.query_id AS VARCHAR) AS session_id, q.query, c.contract_ids, coalesce(f.n, 0) AS n_flags, f.flag_ids, f.worst,
       f.total AS total_exposure_eur, coalesce(s.negative_hours_90d, 0) AS negative_hours_90d, s.avg_negative_price,
       CASE WHEN s.negative_hours_90d IS NULL THEN 'minimal' ELSE 'full' END AS report_kind, n.narrative, c.sources,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(q.query_id) AS created_at
FROM questions q LEFT JOIN (SELECT * FROM market_stats) s USING (market)
LEFT JOIN (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rerank_rank) AS sources,
                  (SELECT string_agg(x.contract_id, ',' ORDER BY x.r) FROM (
                     SELECT i.contract_id, min(i.rerank_rank) AS r FROM clauses i WHERE i.query_id = o.query_id
                     GROUP BY i.contract_id) x) AS contract_ids
           FROM clauses o GROUP BY query_id) c USING (query_id)
LEFT JOIN (SELECT query_id, CAST(count(*) AS INT) AS n, string_agg(flag_id, ',' ORDER BY flag_order) AS flag_ids,
                  first(severity ORDER BY flag_order) AS worst,
                  CASE WHEN sum(exposure_eur) > 0 THEN sum(exposure_eur) END AS total FROM flags GROUP BY query_id) f USING (query_id)
LEFT JOIN ({_NARRATIVE_SQL}) n USING (query_id)"""


def _reports(spark, sf):
    return report.build_report(*_state(spark, sf))


@add("build_report", f"""
SELECT session_id, query, contract_ids, n_flags, coalesce(flag_ids, '') AS flag_ids, total_exposure_eur, negative_hours_90d,
       avg_negative_price, report_kind, narrative, sources, created_at FROM ({_REPORT_SQL})""")
def _(spark, sf):
    rows = _reports(spark, sf)
    return rows.select(
        "session_id", "query", F.array_join("contract_ids", ",").alias("contract_ids"),
        F.size("risk_flags").alias("n_flags"),
        F.array_join(F.transform("risk_flags", lambda f: f["flag_id"]), ",").alias("flag_ids"),
        "total_exposure_eur", "negative_hours_90d", "avg_negative_price", "report_kind", "narrative",
        F.array_join("sources", ",").alias("sources"), "created_at",
    )


_SUMMARY_SQL = f"""
SELECT session_id AS report_id, query, contract_ids, n_flags AS risk_flags_count, worst AS highest_severity,
       total_exposure_eur, negative_hours_90d, created_at FROM ({_REPORT_SQL})"""


@add("report_summary", _SUMMARY_SQL)
def _(spark, sf):
    return report.report_summary(_reports(spark, sf)).withColumn("contract_ids", F.array_join("contract_ids", ","))


@add("list_reports", _SUMMARY_SQL)
def _(spark, sf):
    return report.list_reports(_reports(spark, sf)).withColumn("contract_ids", F.array_join("contract_ids", ","))


@add("get_report", f"SELECT session_id, query, narrative, n_flags FROM ({_REPORT_SQL}) WHERE session_id = '7'")
def _(spark, sf):
    found = report.get_report(_reports(spark, sf), "7")
    return found.select("session_id", "query", "narrative", F.size("risk_flags").alias("n_flags"))


def _esc(expr: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        expr = f"replace({expr}, {text(raw)}, '{safe}')"
    return expr


_ROWS_SQL = f"""
SELECT query_id, string_agg(concat('<tr><td style=''color:',
         CASE severity WHEN 'HIGH' THEN '#c0392b' WHEN 'MEDIUM' THEN '#e67e22' WHEN 'LOW' THEN '#27ae60' ELSE '#555' END, '''>',
         severity, '</td><td>', {_esc('contract_id')}, '</td><td>', {_esc('clause_id')}, '</td><td>', risk_category, '</td><td>',
         CASE WHEN exposure_eur <> 0 THEN concat('€', {_EUR.format('exposure_eur')}) ELSE '—' END, '</td><td>',
         {_esc('description')}, '</td></tr>'), '' ORDER BY flag_order) AS flag_rows FROM flags GROUP BY query_id"""


@add("render_html", f"""
SELECT session_id, concat('<html><head><meta charset=''utf-8''><title>PPA Risk Report ', session_id,
  '</title></head><body><h1>PPA Risk Report</h1><p>Query: ', {_esc('query')}, '<br>Contracts: ',
  replace({_esc('contract_ids')}, ',', ', '), '<br>Total EUR exposure: ',
  CASE WHEN total_exposure_eur <> 0 THEN concat('€', {_EUR.format('total_exposure_eur')}) ELSE '—' END,
  '<br>Negative price hours (90d): ', negative_hours_90d, '</p><table><tr><th>Severity</th><th>Contract</th><th>Clause</th>',
  '<th>Category</th><th>Exposure</th><th>Description</th></tr>',
  coalesce(flag_rows, {text("<tr><td colspan='6'>" + V.NO_FLAGS + "</td></tr>")}), '</table><p>', {_esc('narrative')},
  '</p><p>Sources: ', replace(sources, ',', ', '), '</p></body></html>') AS html
FROM ({_REPORT_SQL}) r LEFT JOIN (SELECT CAST(query_id AS VARCHAR) AS session_id, flag_rows FROM ({_ROWS_SQL})) USING (session_id)""")
def _(spark, sf):
    return report.render_html(_reports(spark, sf))

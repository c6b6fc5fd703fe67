"""Building blocks of the check SQL: the domain's tables written independently in DuckDB SQL."""

from __future__ import annotations

import re

from .. import fixed_values as V
from . import views


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


BLANK = r"[\t-\r\x1c-\x20\x{85}\pZ]"
WORD = r"[\pL\pN_]"
STRIP = (
    "trim({0}, concat(" + ", ".join(
        f"chr({c})" for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    ) + "))"
)


def strip(expr: str) -> str:
    return STRIP.format(expr)


def words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{BLANK}+'), lambda w: w <> '')"


def mentions(low: str, term: str) -> str:
    pattern = f"(^|[^\\pL\\pN_]){re.escape(term)}($|[^\\pL\\pN_])".replace("'", "''")
    return f"regexp_matches({low}, '{pattern}')"


def in_category(low: str, rule: dict) -> str:
    primary = " OR ".join(mentions(low, t) for t in rule["primary"])
    hits = " + ".join(f"CAST({mentions(low, t)} AS INT)" for t in rule["secondary"])
    return f"(({primary}) OR ({hits}) >= 2)"


def tag_case(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {in_category(low, r)} THEN '{c}'" for c, r in V.RISK_TAXONOMY.items()) + " END"


def any_of(expr: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {text(p)})" for p in phrases) + ")"


def has_floor(expr: str) -> str:
    return f"({any_of(expr, V.FLOOR_PHRASES)} AND NOT {any_of(expr, V.FLOOR_NEGATIONS)})"


HEADS = [
    (f"(?i)^(ARTICLE{BLANK}+\\p{{Nd}}+)", 0),
    (f"^(\\p{{Nd}}+\\.\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?){BLANK}+[A-Z]", 1),
    (f"(?i)^(SCHEDULE{BLANK}+\\p{{Nd}}+)", 0),
    (f"(?i)^(ANNEX{BLANK}+[A-Z\\p{{Nd}}]+)", 0),
    (f"^\\(([ivxlcdmIVXLCDM]+)\\){BLANK}", 0),
]


def head_case(line: str, part: str) -> str:
    """Clause number ('clause') or title ('title') of a heading line, NULL if it is none."""
    out = []
    for pattern, back in HEADS:
        clause = strip(f"regexp_extract({line}, '{pattern}', 1)")
        if part == "clause":
            value = clause
        else:
            rest = f"trim(substr({line}, length(regexp_extract({line}, '{pattern}', 0)) + 1 - {back}), ' —-:')"
            value = f"CASE WHEN {rest} <> '' THEN {rest} ELSE {clause} END"
        out.append(f"WHEN regexp_matches({line}, '{pattern}') THEN {value}")
    return "CASE " + " ".join(out) + " END"


def hourly(pick: str, where: str = "true") -> str:
    return f"""
    SELECT market, delivery_ts, CAST(delivery_ts AS DATE) AS delivery_date, CAST(hour(delivery_ts) AS INT) AS hour,
           price_eur_mwh, price_eur_mwh < 0 AS is_negative
    FROM (SELECT event_type AS market, date_trunc('hour', ts) AS delivery_ts,
                 round(3 * {pick}(value ORDER BY ts, event_id) - 120, 2) AS price_eur_mwh
          FROM events WHERE {where} GROUP BY ALL)"""


_FUEL_SUMS = ", ".join(
    f"round(coalesce(sum(value) FILTER (WHERE psr_type = '{code}'), 0), 2) AS {name}"
    for code, name in V.FUEL_CODES.items()
)

PREPARED = {
    "prices": hourly("first"),
    "fuel_rows": "SELECT date_trunc('hour', ts) AS delivery_ts, value, CASE event_type "
    + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in views.EVENT_FUEL.items())
    + " END AS psr_type FROM events",
    "fuels": f"SELECT delivery_ts, {_FUEL_SUMS} FROM fuel_rows GROUP BY delivery_ts",
    "generation": f"""
    SELECT delivery_ts, CAST(delivery_ts AS DATE) AS delivery_date, CAST(hour(delivery_ts) AS INT) AS hour,
           wind_onshore AS wind_onshore_mw, wind_offshore AS wind_offshore_mw, solar AS solar_mw,
           round(ren, 2) AS total_renewable_mw, round(tot, 2) AS total_mw,
           round(CASE WHEN tot = 0 THEN 0 ELSE ren / tot END, 6) AS renewable_pct,
           CASE WHEN tot = 0 THEN false ELSE ren / tot > 0.70 END AS oversupply_flag, 'NL' AS country
    FROM (SELECT *, {' + '.join(V.RENEWABLE_FUELS)} AS ren, {' + '.join(V.FUEL_CODES.values())} AS tot FROM fuels)""",
    "congestion": f"""
    SELECT CAST(event_id AS VARCHAR) AS event_id, {text_list(V.DSO_ZONES)}[user_id % 12 + 1] AS dso_zone,
           CASE WHEN user_id % 2 = 0 THEN 'upward' ELSE 'downward' END AS direction,
           date_trunc('second', ts) AS start_time,
           date_trunc('second', ts) + to_hours(CAST(user_id % 8 + 1 AS INT)) AS end_time,
           value AS mw_needed, value * 0.5 AS price_eur_mwh, 'active' AS status
    FROM events WHERE event_type = 'error'""",
    "signals": """
    SELECT p.delivery_ts, p.delivery_date, p.hour, p.market, p.price_eur_mwh, p.is_negative,
           g.renewable_pct, g.oversupply_flag, g.wind_onshore_mw, g.wind_offshore_mw, g.solar_mw,
           CASE WHEN p.is_negative THEN 'negative_price' WHEN g.oversupply_flag THEN 'oversupply'
                ELSE 'normal' END AS signal_type,
           CASE WHEN p.price_eur_mwh < -100 THEN 'CRITICAL' WHEN p.price_eur_mwh < -30 THEN 'HIGH'
                WHEN p.price_eur_mwh < 0 THEN 'MEDIUM' WHEN g.oversupply_flag THEN 'LOW'
                ELSE 'NONE' END AS severity
    FROM prices p LEFT JOIN generation g ON p.delivery_ts = g.delivery_ts""",
    "daily": """
    SELECT delivery_date, market, count(*) AS negative_hours, avg(price_eur_mwh) AS avg_negative_price_eur,
           min(price_eur_mwh) AS min_price_eur, sum(abs(price_eur_mwh)) AS total_negative_price_magnitude
    FROM signals WHERE is_negative GROUP BY delivery_date, market""",
    "features": """
    SELECT *, price_eur_mwh - rolling_avg_7d AS price_vs_7d_avg,
           abs(price_eur_mwh - rolling_avg_7d) > 2 * rolling_stddev_24h AS volatility_flag
    FROM (SELECT delivery_ts, delivery_date, hour, market, price_eur_mwh, is_negative,
                 avg(price_eur_mwh) OVER (w ROWS 23 PRECEDING) AS rolling_avg_24h,
                 avg(price_eur_mwh) OVER (w ROWS 167 PRECEDING) AS rolling_avg_7d,
                 CASE WHEN count(*) OVER (w ROWS 23 PRECEDING) > 1
                      THEN stddev_samp(price_eur_mwh) OVER (w ROWS 23 PRECEDING) END AS rolling_stddev_24h
          FROM prices WINDOW w AS (PARTITION BY market ORDER BY delivery_ts))""",
    "top_signals": """
    SELECT * FROM (
      SELECT delivery_date, hour, market, round(price_eur_mwh, 2) AS price_eur_mwh, is_negative, signal_type, severity,
             round(coalesce(renewable_pct, 0), 3) AS renewable_pct,
             CAST(row_number() OVER (PARTITION BY market ORDER BY delivery_date DESC, hour) AS INT) AS rank
      FROM signals WHERE signal_type <> 'normal') WHERE rank <= 50""",
    "market_stats": """
    SELECT m.market, m.has_congestion, s.* EXCLUDE (market)
    FROM (SELECT market, bool_or(signal_type = 'oversupply') AS has_congestion FROM top_signals GROUP BY market) m
    LEFT JOIN (SELECT market, count(*) AS negative_hours_90d, round(avg(price_eur_mwh), 2) AS avg_negative_price,
                      round(min(price_eur_mwh), 2) AS min_price,
                      round(max(abs(price_eur_mwh)) * count(*), 0) AS estimated_exposure_eur
               FROM signals WHERE is_negative GROUP BY market) s ON s.market = m.market""",
    "contracts": f"""
    SELECT s_name AS contract_id, {text_list(views.MARKETS)}[s_suppkey % 5 + 1] AS market,
           ['physical', 'virtual', 'sleeved'][s_suppkey % 3 + 1] AS ppa_type,
           round(60 + s_acctbal / 1000, 2) AS strike_price_eur, CAST(s_nationkey + 5 AS DOUBLE) AS volume_mw,
           CASE WHEN s_suppkey % 4 <> 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN -20.0::DOUBLE ELSE 0.0::DOUBLE END END
             AS floor_price,
           {text_list(views.POINTS)}[s_suppkey % 7 + 1] AS delivery_point,
           concat('party-', s_nationkey) AS counterparty, s_suppkey % 2 = 0 AS curtailment_compensation,
           0.8::DOUBLE AS take_or_pay_pct, CAST(s_suppkey % 10 + 5 AS INT) AS tenor_years
    FROM supplier""",
    "raw_blocks": f"""
    SELECT contract_id, CAST(i // 40 + 1 AS INT) AS page, CAST(i AS INT) AS block_no,
           concat(CASE i % 6 WHEN 1 THEN concat('ARTICLE ', i, ' — ') WHEN 3 THEN concat(i, '.', i % 4, ' ')
                             WHEN 5 THEN '(iv) ' ELSE '' END,
                  line, ' ', {text_list(views.CLAUSE_SENTENCES)}[(doc_id + i) % {len(views.CLAUSE_SENTENCES)} + 1]) AS text
    FROM (SELECT doc_id, concat('doc-', doc_id) AS contract_id, generate_subscripts(lines, 1) - 1 AS i, unnest(lines) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "kept_blocks": f"""
    SELECT contract_id, page, block_no, {strip('text')} AS text FROM raw_blocks
    WHERE length({strip('text')}) >= 5""",
    "headed": f"""
    SELECT *, {head_case(strip("string_split(text, chr(10))[1]"), 'clause')} AS h_clause,
           {head_case(strip("string_split(text, chr(10))[1]"), 'title')} AS h_title,
           row_number() OVER (PARTITION BY contract_id ORDER BY block_no) AS pos FROM kept_blocks""",
    "numbered": """
    SELECT *, sum(CASE WHEN h_clause IS NOT NULL OR pos = 1 THEN 1 ELSE 0 END)
                OVER (PARTITION BY contract_id ORDER BY block_no) - 1 AS section_ord FROM headed""",
    "sections": """
    SELECT contract_id, CAST(section_ord AS INT) AS section_ord,
           coalesce(first(h_clause ORDER BY block_no), 'PREAMBLE') AS clause_id,
           coalesce(first(h_title ORDER BY block_no), 'Preamble') AS section_title,
           CASE WHEN first(h_clause ORDER BY block_no) IS NULL THEN 1 ELSE first(page ORDER BY block_no) END AS page_number,
           string_agg(text, ' ' ORDER BY block_no) AS section_text
    FROM numbered GROUP BY contract_id, section_ord""",
    "plain_chunks": f"""
    SELECT substr(md5(concat(contract_id, ':', section_ord, ':', clause_id, ':', pos)), 1, 16) AS chunk_id, contract_id,
           array_to_string(words[pos + 1 : pos + 393], ' ') AS chunk_text, clause_id, section_title, page_number,
           CAST(len(words[pos + 1 : pos + 393]) AS INT) AS token_count, CAST(pos * 5 AS INT) AS char_start, section_ord
    FROM (SELECT *, unnest(range(0, greatest(1, len(words) - 49), 344)) AS pos
          FROM (SELECT *, {words('section_text')} AS words FROM sections) WHERE len(words) > 0)""",
    "chunks": f"""
    SELECT * EXCLUDE (low, section_ord), {tag_case('low')} AS risk_category
    FROM (SELECT *, lower(chunk_text) AS low FROM plain_chunks)""",
    "questions": f"""
    SELECT item_id AS query_id, text AS query, {text_list(views.MARKETS)}[item_id % 5 + 1] AS market FROM benchmark""",
    "query_tokens": f"""
    SELECT query_id, list_distinct({words('lower(query)')}) AS q FROM questions""",
    "chunk_tokens": f"""
    SELECT chunk_id, list_distinct({words('lower(chunk_text)')}) AS c FROM chunks""",
    "hits": """
    SELECT h.query_id, q.query, q.market, h.score, h.rank, c.*
    FROM (SELECT * FROM (
            SELECT query_id, chunk_id, score,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
            FROM (SELECT query_id, chunk_id, len(list_intersect(q, c))::DOUBLE / greatest(len(q), 1) AS score
                  FROM query_tokens, chunk_tokens)) WHERE rank <= 15) h
    JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id)""",
    "hit_terms": f"""
    SELECT query_id, chunk_id, rank, words, len(words) AS n, term,
           len(list_filter(words, lambda w: w = term)) AS tf
    FROM (SELECT h.query_id, h.chunk_id, h.rank, {words('lower(h.chunk_text)')} AS words, unnest(t.q) AS term
          FROM hits h JOIN query_tokens t USING (query_id))""",
    "bm25": """
    SELECT query_id, chunk_id, sum(CASE WHEN tf = 0 THEN 0 ELSE
             ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_n)) END) AS score
    FROM (SELECT t.*, count(*) FILTER (WHERE tf > 0) OVER (PARTITION BY t.query_id, term) AS df, s.docs, s.mean_n
          FROM hit_terms t JOIN (SELECT query_id, count(*) AS docs, avg(n) AS mean_n
                                 FROM (SELECT DISTINCT query_id, chunk_id, n FROM hit_terms) GROUP BY query_id) s
            USING (query_id)) GROUP BY query_id, chunk_id""",
    "clauses": """
    SELECT * FROM (
      SELECT h.*, coalesce(b.score, 0) AS rerank_score,
             CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY round(coalesce(b.score, 0), 10) DESC, h.rank) AS INT) AS rerank_rank
      FROM hits h LEFT JOIN bm25 b USING (query_id, chunk_id)) WHERE rerank_rank <= 6""",
    "clause_state": """
    SELECT c.*, coalesce(s.negative_hours_90d, 0) AS negative_hours_90d,
           coalesce(s.avg_negative_price, 0) AS avg_negative_price, coalesce(s.has_congestion, false) AS has_congestion
    FROM clauses c LEFT JOIN market_stats s USING (market)""",
    "assessed": f"""
    SELECT *, {has_floor('chunk_text')} AS floored, {any_of('chunk_text', V.NO_COMPENSATION_PHRASES)} AS unpaid,
           negative_hours_90d > 0 AS neg FROM clause_state
    WHERE risk_category IS NOT NULL""",
    "scored": f"""
    SELECT *, substr(md5(concat(contract_id, ':', clause_id, ':', risk_category)), 1, 12) AS flag_id
    FROM (SELECT *,
      CASE WHEN risk_category = 'price_risk' THEN
             CASE WHEN neg AND NOT floored THEN 'HIGH' WHEN neg THEN 'LOW' WHEN NOT floored THEN 'MEDIUM' ELSE 'INFO' END
           WHEN risk_category = 'curtailment_risk' THEN
             CASE WHEN unpaid AND has_congestion THEN 'HIGH' WHEN unpaid THEN 'MEDIUM' ELSE 'LOW' END
           WHEN risk_category IN ('volume_risk', 'counterparty_risk') THEN 'MEDIUM'
           WHEN risk_category IN ('basis_risk', 'legal_regulatory') THEN 'LOW' ELSE 'INFO' END AS severity,
      CASE WHEN risk_category = 'price_risk' THEN
             CASE WHEN neg AND NOT floored THEN concat('No negative price floor in contract. Market had ',
                    negative_hours_90d, ' negative price hours (avg ', format('{{:.1f}}', avg_negative_price),
                    ' EUR/MWh) in last 90 days.')
                  WHEN neg THEN concat('Contract has a price floor. Market had ', negative_hours_90d,
                    ' negative hours but exposure is mitigated.')
                  WHEN NOT floored THEN {text(V.PRICE_MEDIUM)} ELSE {text(V.PRICE_INFO)} END
           WHEN risk_category = 'curtailment_risk' THEN
             CASE WHEN unpaid AND has_congestion THEN {text(V.CURTAILMENT_HIGH)}
                  WHEN unpaid THEN {text(V.CURTAILMENT_MEDIUM)} ELSE {text(V.CURTAILMENT_LOW)} END
           WHEN risk_category = 'volume_risk' THEN {text(V.VOLUME_MEDIUM)}
           WHEN risk_category = 'counterparty_risk' THEN {text(V.COUNTERPARTY_MEDIUM)}
           WHEN risk_category = 'basis_risk' THEN 'Basis Risk clause identified for review.'
           WHEN risk_category = 'legal_regulatory' THEN 'Legal Regulatory clause identified for review.'
           ELSE {text(V.OTHER_INFO)} END AS description,
      CASE WHEN risk_category = 'price_risk' AND neg AND NOT floored
             THEN round_even(negative_hours_90d * (365 / 90.0::DOUBLE) * 10 * abs(avg_negative_price), 0)
           WHEN risk_category = 'curtailment_risk' AND unpaid AND has_congestion
             THEN round_even(CAST(trunc(negative_hours_90d * 0.3::DOUBLE) AS INT) * (365 / 90.0::DOUBLE) * 10
                             * abs(abs(avg_negative_price) * 0.5), 0) END AS exposure_eur
      FROM assessed) WHERE severity <> 'INFO'""",
    "first_flags": """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, contract_id, risk_category ORDER BY rerank_rank) AS nth
                   FROM scored) WHERE nth = 1""",
    "flags": """
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY
             CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 3 ELSE 9 END,
             rerank_rank, flag_id) AS INT) AS flag_order FROM first_flags""",
    "pairs": """
    SELECT concat(conv_id, '-', turn) AS id, text AS question, answer
    FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant'""",
}

_NAMES = re.compile(r"\b(" + "|".join(sorted(PREPARED, key=len, reverse=True)) + r")\b")


def with_tables(body: str) -> str:
    """Prefix ``body`` with the prepared tables it names, directly or through others."""
    needed: set[str] = set()
    todo = set(_NAMES.findall(body))
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= set(_NAMES.findall(PREPARED[name])) - needed
    # DuckDB inlines a table expression at every use unless told to keep its rows.
    parts = [f"{n} AS MATERIALIZED ({PREPARED[n].strip()})" for n in PREPARED if n in needed]
    body = body.strip()
    if not parts:
        return body
    if body.startswith("WITH "):
        body = ",\n" + body.removeprefix("WITH ")
    return "WITH " + ",\n".join(parts) + "\n" + body

"""Queries over prices, generation, congestion and contracts, each with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import market as M
from ..operators import congestion as C
from ..operators import eda, gold, islands, quality, risk, rolling, settlement, silver
from . import views as D
from .reference_sql import hourly, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The given prices never leave the published range, so the checks use a tighter one.
TIGHT = dict(V.PRICE_RULES, valid_price_range="price_eur_mwh BETWEEN -100 AND 500")
TIGHT_SQL = "price_eur_mwh BETWEEN -100 AND 500"


def as_of():
    return F.to_timestamp(F.lit(D.AS_OF))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that the order of additions leaves no trace."""
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


# --- expectations, filters ---------------------------------------------------------


@add("expect_or_drop", f"SELECT * FROM prices WHERE {TIGHT_SQL}")
def _(spark, sf):
    return quality.expect(D.prices(spark, sf), TIGHT)


@add("expect_warn", "SELECT * FROM prices")
def _(spark, sf):
    return quality.expect(D.prices(spark, sf), TIGHT, action="warn")


@add("expect_quarantine", f"SELECT *, 'valid_price_range' AS violations FROM prices WHERE NOT ({TIGHT_SQL})")
def _(spark, sf):
    _good, bad = quality.expect(D.prices(spark, sf), TIGHT, action="quarantine")
    return bad.withColumn("violations", F.array_join("violations", ","))


@add("expect_metrics", f"""
SELECT 'valid_price_range' AS rule, count(*) FILTER (WHERE {TIGHT_SQL}) AS passed,
       count(*) FILTER (WHERE NOT ({TIGHT_SQL})) AS failed FROM prices
UNION ALL SELECT 'valid_hour', count(*), 0 FROM prices
UNION ALL SELECT 'non_null_timestamp', count(*), 0 FROM prices
UNION ALL SELECT 'non_null_market', count(*), 0 FROM prices""")
def _(spark, sf):
    return quality.expect_metrics(D.prices(spark, sf), TIGHT)


@add("nonempty_check", "SELECT count(*) AS n_filled FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    return quality.nonempty_check(D.table(spark, sf, "documents"), "text")


_SIGNAL_COLUMNS = ("delivery_ts, delivery_date, hour, market, price_eur_mwh, is_negative, renewable_pct, "
                   "oversupply_flag, wind_onshore_mw, wind_offshore_mw, solar_mw, signal_type, severity")


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("details", "gopacs_congestion_active")


@add("signal_filter", f"SELECT {_SIGNAL_COLUMNS} FROM signals WHERE signal_type <> 'normal'")
def _(spark, sf):
    return _plain(gold.signal_filter(D.signals(spark, sf)))


@add("negative_filter", "SELECT * FROM prices WHERE is_negative")
def _(spark, sf):
    return gold.negative_filter(D.prices(spark, sf))


@add("zone_filter", "SELECT * FROM congestion WHERE contains(lower(dso_zone), 'noord')")
def _(spark, sf):
    return C.zone_filter(D.congestion(spark, sf), "Noord")


@add("lookback_filter", f"SELECT * FROM congestion WHERE start_time >= TIMESTAMP '{D.AS_OF}' - INTERVAL 48 HOUR")
def _(spark, sf):
    return C.lookback_filter(D.congestion(spark, sf), as_of=as_of())


@add("normalise_columns", """
SELECT dso_zone, direction, start_time, CASE WHEN bad THEN NULL ELSE end_time END AS end_time,
       CASE WHEN bad THEN 0 ELSE mw_needed END AS mw_needed, price_eur_mwh, status,
       '' AS source_url
FROM (SELECT *, direction = 'upward' AS bad FROM congestion)""")
def _(spark, sf):
    # The scraped form: text columns under the page's headings, some cells unreadable.
    bad = F.col("direction") == "upward"
    raw = D.congestion(spark, sf).select(
        F.col("dso_zone").alias("Zone"), F.col("direction").alias("Direction"),
        F.col("start_time").cast("string").alias("Start"),
        F.when(bad, F.lit("soon")).otherwise(F.col("end_time").cast("string")).alias("End"),
        F.when(bad, F.lit("n/a")).otherwise(F.col("mw_needed").cast("string")).alias("MW"),
        F.col("price_eur_mwh").cast("string").alias("Price (€/MWh)"), F.col("status").alias("Status"),
    )
    return silver.normalise_columns(raw).drop("event_id", "fetched_at")


@add("row_to_signal", """
SELECT CAST(delivery_date AS VARCHAR) AS delivery_date, hour, market, price_eur_mwh, is_negative, signal_type, severity,
       coalesce(renewable_pct, 0) AS renewable_pct FROM signals""")
def _(spark, sf):
    return gold.row_to_signal(D.signals(spark, sf)).drop("details")


@add("price_collect", """
SELECT market, ts AT TIME ZONE 'Europe/Amsterdam' AT TIME ZONE 'UTC' AS delivery_ts, price AS price_eur_mwh,
       price < 0 AS is_negative,
       CAST(ts AT TIME ZONE 'Europe/Amsterdam' AT TIME ZONE 'UTC' AS DATE) AS delivery_date,
       CAST(hour(ts AT TIME ZONE 'Europe/Amsterdam' AT TIME ZONE 'UTC') AS INT) AS hour
FROM (SELECT market, delivery_ts AS ts, price_eur_mwh AS price FROM prices)""")
def _(spark, sf):
    raw = D.prices(spark, sf).select("market", F.col("delivery_ts").alias("ts"), F.col("price_eur_mwh").alias("price"))
    return silver.price_collect(raw)


# --- joins -------------------------------------------------------------------------------


@add("price_gen_join", """
SELECT p.*, g.wind_onshore_mw, g.wind_offshore_mw, g.solar_mw, g.total_renewable_mw, g.total_mw, g.renewable_pct,
       g.oversupply_flag FROM prices p LEFT JOIN generation g ON p.delivery_ts = g.delivery_ts""")
def _(spark, sf):
    return gold.price_gen_join(D.prices(spark, sf), D.generation(spark, sf))


_MATCH = ("(contains(lower(e.dso_zone), lower(c.delivery_point)) "
          "OR contains(lower(e.dso_zone), lower(string_split(c.delivery_point, '-')[1])))")
_ACTIVE = f"e.start_time <= TIMESTAMP '{D.AS_OF}' AND e.end_time >= TIMESTAMP '{D.AS_OF}'"


@add("congestion_point_join", f"""
SELECT c.contract_id, c.delivery_point, e.event_id, e.dso_zone, e.mw_needed
FROM contracts c JOIN congestion e ON {_ACTIVE} AND {_MATCH}""")
def _(spark, sf):
    return C.congestion_point_join(
        D.contracts(spark, sf).select("contract_id", "delivery_point"),
        D.congestion(spark, sf).select("event_id", "dso_zone", "start_time", "end_time", "mw_needed"), as_of=as_of(),
    ).drop("start_time", "end_time")


_LEVEL_SQL = f"""
SELECT c.contract_id, c.delivery_point, count(e.event_id) > 0 AS congested, count(e.event_id) AS active_events,
       max(e.mw_needed) AS max_mw,
       CASE WHEN count(e.event_id) = 0 THEN 'NONE' WHEN max(e.mw_needed) > 100 THEN 'HIGH'
            WHEN max(e.mw_needed) > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM contracts c LEFT JOIN congestion e ON {_ACTIVE} AND {_MATCH} GROUP BY c.contract_id, c.delivery_point"""


@add("congestion_level", _LEVEL_SQL)
def _(spark, sf):
    points = D.contracts(spark, sf).select("contract_id", "delivery_point")
    return C.congestion_level(points, D.congestion(spark, sf), as_of=as_of())


@add("get_gopacs_congestion", _LEVEL_SQL)
def _(spark, sf):
    # The same as a SQL view, the way a SQL user asks for it.
    points = D.contracts(spark, sf).select("contract_id", "delivery_point")
    C.congestion_level(points, D.congestion(spark, sf), as_of=as_of()).createOrReplaceTempView("gopacs_congestion")
    return spark.sql("SELECT contract_id, delivery_point, congested, active_events, max_mw, risk_level FROM gopacs_congestion")


@add("get_gopacs_congestion_events", f"""
SELECT event_id, dso_zone, direction, start_time, end_time, mw_needed, end_time >= TIMESTAMP '{D.AS_OF}' AS active,
       CASE WHEN mw_needed > 100 THEN 'HIGH' WHEN mw_needed > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM congestion WHERE contains(lower(dso_zone), 'liander')
  AND start_time >= TIMESTAMP '{D.AS_OF}' - INTERVAL 72 HOUR AND start_time <= TIMESTAMP '{D.AS_OF}'""")
def _(spark, sf):
    D.congestion(spark, sf).createOrReplaceTempView("congestion_events")
    C.register_get_gopacs_congestion(spark, "congestion_events")
    return spark.sql(f"SELECT * FROM get_gopacs_congestion('Liander', 72, TIMESTAMP '{D.AS_OF}')")


@add("hour_congestion_overlap", """
SELECT h.delivery_ts, count(e.event_id) > 0 AS has_gopacs_event,
       round(coalesce(sum(e.mw_needed), 0), 6) AS gopacs_requested_mw
FROM (SELECT DISTINCT delivery_ts FROM prices) h
LEFT JOIN congestion e ON e.start_time < h.delivery_ts + INTERVAL 1 HOUR AND e.end_time > h.delivery_ts
GROUP BY h.delivery_ts""")
def _(spark, sf):
    hours = D.events(spark, sf).select(F.date_trunc("hour", "ts").alias("delivery_ts")).distinct()
    return rounded(C.hour_congestion_overlap(hours, D.congestion(spark, sf)))


# --- aggregates -----------------------------------------------------------------------


@add("portfolio_exposure_daily", """
SELECT delivery_date, market, negative_hours, round(avg_negative_price_eur, 6) AS avg_negative_price_eur, min_price_eur,
       round(total_negative_price_magnitude, 6) AS total_negative_price_magnitude FROM daily""")
def _(spark, sf):
    return rounded(gold.portfolio_exposure_daily(D.signals(spark, sf)).drop("computed_at"))


@add("negative_stats", """
SELECT count(*) AS negative_hours_90d, round(avg(price_eur_mwh), 2) AS avg_negative_price,
       round(min(price_eur_mwh), 2) AS min_price,
       round(max(abs(price_eur_mwh)) * count(*), 0) AS estimated_exposure_eur FROM signals WHERE is_negative""")
def _(spark, sf):
    return gold.negative_stats(D.signals(spark, sf))


@add("portfolio_rollup", """
SELECT count(DISTINCT delivery_date) AS negative_days, CAST(sum(negative_hours) AS BIGINT) AS total_negative_hours,
       round(avg(avg_negative_price_eur), 2) AS avg_neg_price FROM daily""")
def _(spark, sf):
    return gold.portfolio_rollup(gold.portfolio_exposure_daily(D.signals(spark, sf)))


@add("signal_severity_counts", "SELECT signal_type, severity, count(*) AS n FROM signals GROUP BY ALL")
def _(spark, sf):
    return gold.signal_severity_counts(D.signals(spark, sf))


@add("coverage_check", """
SELECT count(*) AS n_rows, min(delivery_date) AS first_date, max(delivery_date) AS last_date FROM prices""")
def _(spark, sf):
    return gold.coverage_check(D.prices(spark, sf))


@add("neg_hours_check", """
SELECT count(*) AS negative_hours, round(avg(price_eur_mwh), 2) AS avg_negative_price FROM prices WHERE is_negative""")
def _(spark, sf):
    return gold.neg_hours_check(D.prices(spark, sf))


@add("event_zone_distinct", "SELECT count(*) AS n_events, count(DISTINCT dso_zone) AS n_zones FROM congestion")
def _(spark, sf):
    return gold.event_zone_distinct(D.congestion(spark, sf))


@add("neg_days_check", "SELECT count(*) AS n_rows, round(avg(negative_hours), 1) AS avg_negative_hours FROM daily")
def _(spark, sf):
    return gold.neg_days_check(gold.portfolio_exposure_daily(D.signals(spark, sf)))


@add("conditional_count", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE volatility_flag) AS volatile_hours FROM features")
def _(spark, sf):
    return gold.conditional_count(rolling.hourly_price_features(D.prices(spark, sf)))


_ISLANDS = """
SELECT market, delivery_ts, price_eur_mwh,
       sum(broke) OVER (PARTITION BY market ORDER BY delivery_ts) AS island
FROM (SELECT *, CASE WHEN epoch(delivery_ts) - epoch(lag(delivery_ts) OVER (PARTITION BY market ORDER BY delivery_ts)) > 3700
                     THEN 1 ELSE 0 END AS broke FROM prices WHERE is_negative)"""
_WINDOWS = f"""
SELECT market, min(delivery_ts) AS window_start, max(delivery_ts) AS window_end,
       round(avg(price_eur_mwh), 6) AS avg_price, min(price_eur_mwh) AS min_price, count(*) AS hours_count
FROM ({_ISLANDS}) GROUP BY market, island"""


@add("negative_windows", _WINDOWS)
def _(spark, sf):
    return rounded(islands.negative_windows(D.prices(spark, sf)))


@add("gap_island", f"SELECT market, delivery_ts, price_eur_mwh, CAST(island AS BIGINT) AS island FROM ({_ISLANDS})")
def _(spark, sf):
    rows = D.prices(spark, sf).filter("is_negative").select("market", "delivery_ts", "price_eur_mwh")
    return islands.gap_island(rows, keys=["market"], ts="delivery_ts", gap_seconds=V.SESSION_GAP_SECONDS)


@add("fuel_pivot", "SELECT * FROM fuels")
def _(spark, sf):
    return D.fuels(spark, sf)


@add("generation_features", "SELECT * FROM generation")
def _(spark, sf):
    return D.generation(spark, sf)


@add("neg_by_hour", """
SELECT hour AS hour_of_day, CAST(sum(is_negative::INT) AS BIGINT) AS neg_hours, count(*) AS total_hours,
       round(avg(is_negative::INT), 6) AS neg_rate FROM prices GROUP BY hour""")
def _(spark, sf):
    return rounded(eda.neg_by_hour(D.prices(spark, sf)))


@add("daily_neg_count", """
SELECT market, delivery_date, count(*) FILTER (WHERE is_negative) AS neg_hours_per_day FROM prices GROUP BY ALL""")
def _(spark, sf):
    return rolling.daily_neg_count(D.prices(spark, sf))


@add("describe_stats", """
SELECT count(*) AS n, round(avg(price_eur_mwh), 6) AS mean, round(stddev_samp(price_eur_mwh), 6) AS std,
       min(price_eur_mwh) AS min, round(quantile_cont(price_eur_mwh, 0.25), 6) AS p25,
       round(quantile_cont(price_eur_mwh, 0.5), 6) AS p50, round(quantile_cont(price_eur_mwh, 0.75), 6) AS p75,
       max(price_eur_mwh) AS max, count(*) FILTER (WHERE is_negative) AS negative_hours,
       round(avg(is_negative::INT), 6) AS negative_share,
       round(avg(price_eur_mwh) FILTER (WHERE is_negative), 6) AS mean_negative,
       min(price_eur_mwh) FILTER (WHERE is_negative) AS min_negative FROM prices""")
def _(spark, sf):
    return rounded(eda.describe_stats(D.prices(spark, sf)))


@add("price_histogram", """
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 79, 6) AS bin_from,
       count(*) FILTER (WHERE NOT is_negative) AS n_positive, count(*) FILTER (WHERE is_negative) AS n_negative
FROM (SELECT *, least(CAST(floor((price_eur_mwh - lo) / (hi - lo) * 79) AS BIGINT) + 1, 79) AS bin
      FROM prices, (SELECT min(price_eur_mwh) - 5 AS lo, max(price_eur_mwh) + 5 AS hi FROM prices))
GROUP BY bin, lo, hi""")
def _(spark, sf):
    return rounded(eda.price_histogram(D.prices(spark, sf)))


@add("renewable_bins", """
SELECT CAST(bin AS INT) AS bin, round(avg(is_negative::INT), 6) AS neg_rate,
       CAST(sum(is_negative::INT) AS BIGINT) AS neg_hours,
       count(*) AS total_hours, round(avg(is_negative::INT) * 100, 2) AS neg_rate_pct
FROM (SELECT *, greatest(1, ceil((renewable_pct - lo) / (hi - lo) * 10)) AS bin
      FROM signals, (SELECT min(renewable_pct) AS lo, max(renewable_pct) AS hi FROM signals)
      WHERE renewable_pct IS NOT NULL) GROUP BY bin""")
def _(spark, sf):
    return rounded(eda.renewable_bins(D.signals(spark, sf)))


@add("point_biserial", """
SELECT round(corr(renewable_pct, is_negative::INT), 6) AS corr, count(*) AS n,
       CASE WHEN abs(corr(renewable_pct, is_negative::INT)) > 0.3 THEN 'Strong' ELSE 'Moderate' END AS strength
FROM signals WHERE renewable_pct IS NOT NULL""")
def _(spark, sf):
    # The p-value has no SQL counterpart; tests check it against known values.
    return rounded(eda.point_biserial(D.signals(spark, sf)).drop("p_value"))


@add("high_re_overlap", """
SELECT market, count(*) FILTER (WHERE renewable_pct > 0.70) AS high_re_hours FROM top_signals GROUP BY market""")
def _(spark, sf):
    return gold.high_re_overlap(D.top_signals(spark, sf))


# --- windows -------------------------------------------------------------------------------

# Means of two-decimal prices over 128 hours end in a nine-digit fraction, so nine digits are kept.
_FEATURES = """
SELECT delivery_ts, delivery_date, hour, market, price_eur_mwh, is_negative,
       round(rolling_avg_24h, 9) AS rolling_avg_24h, round(rolling_avg_7d, 9) AS rolling_avg_7d,
       round(rolling_stddev_24h, 9) AS rolling_stddev_24h, round(price_vs_7d_avg, 9) AS price_vs_7d_avg,
       volatility_flag FROM features"""


@add("hourly_price_features", _FEATURES)
def _(spark, sf):
    return rounded(rolling.hourly_price_features(D.prices(spark, sf)), 9)


def _one_feature(name: str):
    def run(spark, sf):
        return rounded(rolling.hourly_price_features(D.prices(spark, sf)).select("market", "delivery_ts", name), 9)

    add(name, f"SELECT market, delivery_ts, round({name}, 9) AS {name} FROM features")(run)


for _name in ("rolling_avg_24h", "rolling_avg_7d", "rolling_stddev_24h"):
    _one_feature(_name)


@add("price_vs_7d_avg", """
SELECT market, delivery_ts, round(price_vs_7d_avg, 9) AS price_vs_7d_avg, volatility_flag FROM features""")
def _(spark, sf):
    out = rolling.hourly_price_features(D.prices(spark, sf))
    return rounded(out.select("market", "delivery_ts", "price_vs_7d_avg", "volatility_flag"), 9)


@add("rolling_90d_neg", """
SELECT market, delivery_date, neg_hours_per_day,
       CASE WHEN count(*) OVER (w ROWS 6 PRECEDING) >= 3
            THEN CAST(sum(neg_hours_per_day) OVER (w ROWS 6 PRECEDING) AS BIGINT) END AS rolling_90d
FROM (SELECT market, delivery_date, count(*) FILTER (WHERE is_negative) AS neg_hours_per_day FROM prices GROUP BY ALL)
WINDOW w AS (PARTITION BY market ORDER BY delivery_date)""")
def _(spark, sf):
    # A month of data: the frame is a week here.
    return rolling.rolling_90d_neg(rolling.daily_neg_count(D.prices(spark, sf)), rows=7, min_obs=3)


@add("rolling_90d_neg_published", """
SELECT market, delivery_date, neg_hours_per_day,
       CASE WHEN count(*) OVER (w ROWS 89 PRECEDING) >= 30
            THEN CAST(sum(neg_hours_per_day) OVER (w ROWS 89 PRECEDING) AS BIGINT) END AS rolling_90d
FROM (SELECT market, delivery_date, count(*) FILTER (WHERE is_negative) AS neg_hours_per_day FROM prices GROUP BY ALL)
WINDOW w AS (PARTITION BY market ORDER BY delivery_date)""")
def _(spark, sf):
    return rolling.rolling_90d_neg(rolling.daily_neg_count(D.prices(spark, sf)))


@add("worst_k_signals", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY market ORDER BY price_eur_mwh, delivery_date DESC, hour) AS INT) AS worst_rank
               FROM (SELECT delivery_date, hour, market, price_eur_mwh, severity FROM top_signals)) WHERE worst_rank <= 3""")
def _(spark, sf):
    rows = D.top_signals(spark, sf).select("delivery_date", "hour", "market", "price_eur_mwh", "severity")
    return gold.worst_k_signals(rows)


@add("signals_top50", """
SELECT delivery_date, hour, market, round(price_eur_mwh, 2) AS price_eur_mwh, is_negative, signal_type, severity,
       round(coalesce(renewable_pct, 0), 3) AS renewable_pct FROM signals WHERE signal_type <> 'normal'
ORDER BY delivery_date DESC, hour, market LIMIT 50""")
def _(spark, sf):
    return gold.signals_top50(D.signals(spark, sf)).drop("details")


@add("sample_n", """
SELECT * FROM prices ORDER BY md5(concat('1|', market, '|', strftime(delivery_ts, '%Y-%m-%d %H:%M:%S'))), market, delivery_ts
LIMIT 2000""")
def _(spark, sf):
    return eda.sample_n(D.prices(spark, sf), key=["market", "delivery_ts"])


@add("event_dedupe", """
SELECT event_id, dso_zone, direction, start_time, end_time, mw_needed + 1 AS mw_needed, price_eur_mwh, status,
       1 AS delivery FROM congestion""")
def _(spark, sf):
    # Every event arrives twice; the second delivery corrects the volume.
    first = D.congestion(spark, sf).withColumn("delivery", F.lit(0))
    again = first.withColumns({"mw_needed": F.col("mw_needed") + 1, "delivery": F.lit(1)})
    return silver.latest_by_key(first.unionByName(again), keys=["event_id"], order=["delivery"])


# --- scalar functions ---------------------------------------------------------------


@add("classify_signal", "SELECT delivery_ts, market, signal_type FROM signals")
def _(spark, sf):
    joined = gold.price_gen_join(D.prices(spark, sf), D.generation(spark, sf))
    return joined.select("delivery_ts", "market",
                         M.classify_signal(F.col("is_negative"), F.col("oversupply_flag")).alias("signal_type"))


@add("classify_severity", "SELECT delivery_ts, market, severity FROM signals")
def _(spark, sf):
    joined = gold.price_gen_join(D.prices(spark, sf), D.generation(spark, sf))
    return joined.select("delivery_ts", "market",
                         M.classify_severity(F.col("price_eur_mwh"), F.col("oversupply_flag")).alias("severity"))


@add("market_risk_signals", f"SELECT {_SIGNAL_COLUMNS}, false AS gopacs_congestion_active FROM signals")
def _(spark, sf):
    return D.signals(spark, sf).drop("details")


@add("details_json", """
SELECT delivery_ts, market, price_eur_mwh, renewable_pct, wind_onshore_mw, solar_mw FROM signals""")
def _(spark, sf):
    # Read back what the JSON text holds, so that number formats do not matter.
    fields = "price_eur_mwh double, renewable_pct double, wind_onshore_mw double, solar_mw double"
    return D.signals(spark, sf).select("delivery_ts", "market", F.from_json("details", fields).alias("_d")).select(
        "delivery_ts", "market", "_d.*"
    )


@add("classify_price_band", """
SELECT market, delivery_ts, CASE WHEN price_eur_mwh < 0 THEN 'negative' WHEN price_eur_mwh < 20 THEN 'low'
                                 ELSE 'normal' END AS price_band FROM prices""")
def _(spark, sf):
    return D.prices(spark, sf).select(
        "market", "delivery_ts", M.classify_price_band(F.col("price_eur_mwh")).alias("price_band")
    )


@add("calc_exposure", """
SELECT delivery_date, market,
       round_even(negative_hours * (365 / 90.0::DOUBLE) * 10 * abs(round(avg_negative_price_eur, 6)), 0) AS exposure_eur
FROM daily""")
def _(spark, sf):
    daily = gold.portfolio_exposure_daily(D.signals(spark, sf))
    avg = F.round("avg_negative_price_eur", 6)
    return daily.select("delivery_date", "market", M.calc_exposure(F.col("negative_hours"), avg).alias("exposure_eur"))


@add("curtailment_exposure", """
SELECT delivery_date, market,
       round_even(CAST(trunc(negative_hours * 0.3::DOUBLE) AS INT) * (365 / 90.0::DOUBLE) * 10
                  * (abs(round(avg_negative_price_eur, 6)) * 0.5), 0) AS exposure_eur FROM daily""")
def _(spark, sf):
    daily = gold.portfolio_exposure_daily(D.signals(spark, sf))
    avg = F.round("avg_negative_price_eur", 6)
    return daily.select(
        "delivery_date", "market", M.curtailment_exposure(F.col("negative_hours"), avg).alias("exposure_eur")
    )


@add("date_parts", """
SELECT market, delivery_ts, CAST(delivery_ts AS DATE) AS delivery_date, CAST(hour(delivery_ts) AS INT) AS hour,
       CAST(delivery_ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Amsterdam' AS DATE) AS local_date,
       CAST(CAST(delivery_ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Amsterdam' AS DATE) AS TIMESTAMP)
         AT TIME ZONE 'Europe/Amsterdam' AT TIME ZONE 'UTC' AS start_utc FROM prices""")
def _(spark, sf):
    local = M.local_day(F.col("delivery_ts"))
    return D.prices(spark, sf).select(
        "market", "delivery_ts", "delivery_date", "hour", local.alias("local_date"),
        M.local_day_bounds(local)["start_utc"].alias("start_utc"),
    )


@add("unix_order_key", "SELECT market, delivery_ts, CAST(epoch(delivery_ts) AS BIGINT) AS order_key FROM prices")
def _(spark, sf):
    return D.prices(spark, sf).select("market", "delivery_ts", F.unix_timestamp("delivery_ts").alias("order_key"))


# --- exposure of contracts ----------------------------------------------------------------

_CASES_SQL = """
SELECT c.contract_id, c.volume_mw AS contracted_mw, c.floor_price, s.negative_hours_90d AS neg_hours,
       s.avg_negative_price AS avg_neg_price
FROM contracts c JOIN market_stats s USING (market)"""


def _cases(spark, sf):
    """Contracts with the negative hours of their market."""
    stats = gold.negative_stats(D.signals(spark, sf), by=["market"])
    return D.contracts(spark, sf).join(stats, "market").select(
        "contract_id", F.col("volume_mw").alias("contracted_mw"), "floor_price",
        F.col("negative_hours_90d").alias("neg_hours"), F.col("avg_negative_price").alias("avg_neg_price"),
    )


def _full_sql(source: str, days: str = "90") -> str:
    return f"""
SELECT * EXCLUDE (floor_price, eff, days), floor_price, eff AS effective_price,
       coalesce(floor_price > avg_neg_price, false) AS floor_protection, days AS window_days,
       round_even(abs(eff) * neg_hours * contracted_mw, 2) AS exposure_window,
       round_even(365.0::DOUBLE / days, 4) AS annualisation,
       round_even(abs(eff) * neg_hours * contracted_mw * (365.0::DOUBLE / days), 2) AS exposure_annual
FROM (SELECT *, greatest(avg_neg_price, floor_price) AS eff, {days} AS days FROM ({source}))"""


@add("calc_exposure_full", _full_sql(_CASES_SQL))
def _(spark, sf):
    good, _bad = quality.expect(_cases(spark, sf), risk.EXPOSURE_RULES, action="quarantine")
    return risk.calc_exposure_full(good)


@add("calculate_exposure", _full_sql(_CASES_SQL))
def _(spark, sf):
    # The scalar tool of a SQL user, as a SQL function over the same arithmetic.
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION calculate_exposure(
            hours BIGINT, price DOUBLE, mw DOUBLE, floor_limit DOUBLE, days INT)
        RETURNS DOUBLE RETURN bround(abs(greatest(price, floor_limit)) * hours * mw * (365D / days), 2)""")
    rows = risk.calc_exposure_full(_cases(spark, sf))
    annual = F.call_function(
        "calculate_exposure", "neg_hours", "avg_neg_price", "contracted_mw", "floor_price", "window_days"
    )
    return rows.withColumn("exposure_annual", annual)


@add("annualisation_sweep", f"""
SELECT contract_id, window_days, annualisation, exposure_annual FROM ({_full_sql(
    "SELECT c.*, unnest([30, 60, 90, 120, 180, 365]) AS w FROM (" + _CASES_SQL + ") c", "w")})""")
def _(spark, sf):
    return risk.annualisation_sweep(_cases(spark, sf)).select(
        "contract_id", "window_days", "annualisation", "exposure_annual"
    )


@add("contract_comparison", _full_sql(f"""
SELECT contract_id, contracted_mw, CASE WHEN scenario = 'as_signed' THEN floor_price END AS floor_price, neg_hours,
       avg_neg_price, scenario FROM (SELECT *, unnest(['as_signed', 'no_floor']) AS scenario FROM ({_CASES_SQL}))"""))
def _(spark, sf):
    return risk.contract_comparison(_cases(spark, sf))


_GRID_SQL = """
SELECT contract_id, neg_hours, avg_neg_price,
       round_even(abs(greatest(avg_neg_price, floor_price)) * neg_hours * volume_mw * (365.0::DOUBLE / 90), 2)
         AS exposure_annual
FROM (SELECT contract_id, volume_mw, floor_price, neg_hours,
             unnest([-5, -10, -20, -28.7, -40, -60, -80]::DOUBLE[]) AS avg_neg_price
      FROM (SELECT *, unnest([50, 100, 168, 250, 336, 500, 672]) AS neg_hours FROM contracts))"""


def _grid(spark, sf):
    book = D.contracts(spark, sf).select("contract_id", F.col("volume_mw").alias("contracted_mw"), "floor_price")
    return risk.sensitivity_cross(book)


@add("sensitivity_cross", _GRID_SQL)
def _(spark, sf):
    return _grid(spark, sf)


@add("sensitivity_pivot", f"""
SELECT contract_id, neg_hours,
       {', '.join(f"max(exposure_annual) FILTER (WHERE avg_neg_price = {p}) AS {n}" for p, n in
                  [(-5, 'at_5'), (-10, 'at_10'), (-20, 'at_20'), (-28.7, 'at_28_7'), (-40, 'at_40'),
                   (-60, 'at_60'), (-80, 'at_80')])}
FROM ({_GRID_SQL}) GROUP BY contract_id, neg_hours""")
def _(spark, sf):
    return risk.sensitivity_pivot(_grid(spark, sf))


# --- documented tables --------------------------------------------------------------------


@add("feat_rolling_30_90", """
SELECT market, delivery_ts, price_eur_mwh,
       round(avg(price_eur_mwh) OVER a, 9) AS rolling_30d_mean,
       CASE WHEN count(*) OVER a > 1 THEN round(stddev_samp(price_eur_mwh) OVER a, 9) END AS rolling_30d_std,
       round(avg(price_eur_mwh) OVER b, 9) AS rolling_90d_mean,
       CASE WHEN count(*) OVER b > 1 THEN round(stddev_samp(price_eur_mwh) OVER b, 9) END AS rolling_90d_std
FROM prices
WINDOW a AS (PARTITION BY market ORDER BY epoch(delivery_ts) RANGE 345599 PRECEDING),
       b AS (PARTITION BY market ORDER BY epoch(delivery_ts) RANGE 863999 PRECEDING)""")
def _(spark, sf):
    # A month of data: frames of 4 and 10 days, so that they start to move.
    return rounded(rolling.feat_rolling_30_90(D.prices(spark, sf), short_days=4, long_days=10), 9)


@add("feat_rolling_30_90_published", """
SELECT market, delivery_ts, price_eur_mwh,
       round(avg(price_eur_mwh) OVER a, 9) AS rolling_30d_mean,
       CASE WHEN count(*) OVER a > 1 THEN round(stddev_samp(price_eur_mwh) OVER a, 9) END AS rolling_30d_std,
       round(avg(price_eur_mwh) OVER b, 9) AS rolling_90d_mean,
       CASE WHEN count(*) OVER b > 1 THEN round(stddev_samp(price_eur_mwh) OVER b, 9) END AS rolling_90d_std
FROM prices
WINDOW a AS (PARTITION BY market ORDER BY epoch(delivery_ts) RANGE 2591999 PRECEDING),
       b AS (PARTITION BY market ORDER BY epoch(delivery_ts) RANGE 7775999 PRECEDING)""")
def _(spark, sf):
    return rounded(rolling.feat_rolling_30_90(D.prices(spark, sf)), 9)


@add("feat_percentile_90d", """
SELECT a.market, a.delivery_ts, a.price_eur_mwh,
       round(count(*) FILTER (WHERE b.price_eur_mwh <= a.price_eur_mwh)::DOUBLE / count(*), 6) AS price_percentile_90d
FROM prices a JOIN prices b ON a.market = b.market AND b.delivery_ts <= a.delivery_ts
     AND b.delivery_ts > a.delivery_ts - INTERVAL 20 DAY
GROUP BY ALL""")
def _(spark, sf):
    return rounded(rolling.feat_percentile_90d(D.prices(spark, sf), days=20))


@add("feat_percentile_90d_published", """
SELECT a.market, a.delivery_ts, a.price_eur_mwh,
       round(count(*) FILTER (WHERE b.price_eur_mwh <= a.price_eur_mwh)::DOUBLE / count(*), 6) AS price_percentile_90d
FROM prices a JOIN prices b ON a.market = b.market AND b.delivery_ts <= a.delivery_ts
     AND b.delivery_ts > a.delivery_ts - INTERVAL 90 DAY
GROUP BY ALL""")
def _(spark, sf):
    return rounded(rolling.feat_percentile_90d(D.prices(spark, sf)))


@add("feat_calendar", """
SELECT market, delivery_ts, CAST(hour(l) AS INT) AS hour_of_day, CAST(isodow(l) AS INT) AS day_of_week, isodow(l) >= 6 AS is_weekend
FROM (SELECT *, delivery_ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Amsterdam' AS l FROM prices)""")
def _(spark, sf):
    return settlement.feat_calendar(D.prices(spark, sf))


@add("feat_renewable_share", """
SELECT delivery_ts, solar_mw AS solar_generation_mw, round(wind_onshore_mw + wind_offshore_mw, 6) AS wind_generation_mw,
       CASE WHEN total_mw <> 0 THEN round((solar_mw + wind_onshore_mw + wind_offshore_mw) / total_mw, 6) END AS renewable_share
FROM generation""")
def _(spark, sf):
    return rounded(settlement.feat_renewable_share(D.generation(spark, sf)))


@add("daily_market_risk", """
WITH d AS (
  SELECT market, p.delivery_date AS signal_date, avg(price_eur_mwh) AS a,
         CASE WHEN count(*) > 1 THEN stddev_samp(price_eur_mwh) END AS v,
         count(*) FILTER (WHERE price_eur_mwh < 0) AS neg, count(*) FILTER (WHERE price_eur_mwh > 200) AS spikes,
         CASE WHEN sum(w) <> 0 THEN sum(price_eur_mwh * w) / sum(w) END AS pw,
         CASE WHEN sum(s) <> 0 THEN sum(price_eur_mwh * s) / sum(s) END AS ps
  FROM prices p LEFT JOIN (SELECT delivery_ts, wind_onshore_mw + wind_offshore_mw AS w, solar_mw AS s FROM generation) g
       USING (delivery_ts) GROUP BY ALL),
e AS (
  SELECT CAST(day AS DATE) AS signal_date, count(*) AS n, sum(mw_needed) AS mw
  FROM (SELECT mw_needed, unnest(generate_series(date_trunc('day', start_time),
               date_trunc('day', end_time - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS day FROM congestion) GROUP BY ALL),
f AS (
  SELECT d.*, pw / a AS cw, ps / a AS cs, coalesce(n, 0) AS n, coalesce(mw, 0) AS mw,
         (neg > 4)::INT + (spikes > 0)::INT + coalesce(least(pw / a, ps / a) < 0.75, false)::INT AS alerts
  FROM d LEFT JOIN e USING (signal_date))
SELECT market, signal_date, round(a, 6) AS daily_avg_price, round(v, 6) AS daily_volatility, neg AS negative_price_hours,
       spikes AS price_spike_hours, round(cw, 6) AS capture_rate_wind, round(cs, 6) AS capture_rate_solar,
       n AS gopacs_events_count, round(mw, 6) AS gopacs_total_mw,
       ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][alerts + 1] AS risk_level FROM f""")
def _(spark, sf):
    return rounded(settlement.daily_market_risk(D.prices(spark, sf), D.generation(spark, sf), D.congestion(spark, sf)))


_BOOK_SQL = """
SELECT c.contract_id, d.delivery_date AS exposure_date, c.volume_mw * d.hours AS mwh, c.strike_price_eur, d.p,
       (c.strike_price_eur - d.p) * (c.volume_mw * d.hours) AS eur, c.ppa_type, c.counterparty
FROM contracts c JOIN (SELECT market, delivery_date, count(*) AS hours, avg(price_eur_mwh) AS p FROM prices GROUP BY ALL) d
     USING (market)"""


@add("contract_exposure_daily", f"""
SELECT contract_id, exposure_date, mwh AS contracted_volume_mwh, strike_price_eur AS contract_price_eur_mwh,
       round(p, 6) AS market_price_eur_mwh, round(strike_price_eur - p, 6) AS spread_eur_mwh,
       round(eur, 6) AS daily_exposure_eur,
       upper(ppa_type) AS ppa_type, counterparty AS counterparty_id,
       round(sum(eur) OVER (PARTITION BY contract_id ORDER BY exposure_date), 6) AS cumulative_exposure_eur
FROM ({_BOOK_SQL})""")
def _(spark, sf):
    return rounded(settlement.contract_exposure_daily(D.contracts(spark, sf), D.prices(spark, sf)), 6)


@add("negative_exposure_strike", """
SELECT contract_id, count(*) AS negative_hours, round(sum((strike_price_eur - price_eur_mwh) * volume_mw), 4) AS exposure_eur,
       CASE WHEN sum((strike_price_eur - price_eur_mwh) * volume_mw) < 50000 THEN 'LOW'
            WHEN sum((strike_price_eur - price_eur_mwh) * volume_mw) <= 500000 THEN 'MEDIUM'
            WHEN sum((strike_price_eur - price_eur_mwh) * volume_mw) <= 5000000 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
FROM contracts JOIN prices USING (market) WHERE is_negative GROUP BY contract_id""")
def _(spark, sf):
    return rounded(settlement.negative_exposure_strike(D.contracts(spark, sf), D.prices(spark, sf)), 4)


@add("severity_by_eur", """
SELECT o_orderkey, CASE WHEN e < 50000 THEN 'LOW' WHEN e <= 500000 THEN 'MEDIUM' WHEN e <= 5000000 THEN 'HIGH'
                        ELSE 'CRITICAL' END AS severity FROM (SELECT o_orderkey, o_totalprice * 20 AS e FROM orders)""")
def _(spark, sf):
    return D.table(spark, sf, "orders").select(
        "o_orderkey", M.severity_by_eur(F.col("o_totalprice") * 20).alias("severity")
    )


@add("scenario_var", """
SELECT contract_id, round((strike_price_eur - quantile_cont(p, 0.95)) * volume_mw * 24, 4) AS exposure_p5_eur,
       round((strike_price_eur - quantile_cont(p, 0.5)) * volume_mw * 24, 4) AS exposure_p50_eur,
       round((strike_price_eur - quantile_cont(p, 0.05)) * volume_mw * 24, 4) AS exposure_p95_eur
FROM contracts JOIN (SELECT market, delivery_date, avg(price_eur_mwh) AS p FROM prices GROUP BY ALL) USING (market)
GROUP BY contract_id, strike_price_eur, volume_mw""")
def _(spark, sf):
    return rounded(settlement.scenario_var(D.contracts(spark, sf), D.prices(spark, sf)), 4)


@add("basis_risk_eur", """
SELECT contract_id, count(*) AS shared_hours, round(sum((p.price_eur_mwh - h.price_eur_mwh) * volume_mw), 4) AS basis_risk_eur
FROM contracts JOIN prices p USING (market) JOIN prices h ON h.delivery_ts = p.delivery_ts AND h.market = 'view'
GROUP BY contract_id""")
def _(spark, sf):
    return rounded(settlement.basis_risk_eur(D.contracts(spark, sf), D.prices(spark, sf), hub="view"), 4)


@add("curtailment_loss", """
SELECT contract_id, round(rate, 4) AS capture_rate,
       round(volume_mw * 8760 * 0.35 * rate * (strike_price_eur - coalesce(floor_price, 0)), 4) AS curtailment_loss_eur
FROM contracts JOIN (
  SELECT market, sum(price_eur_mwh * g) / sum(g) / avg(price_eur_mwh) AS rate
  FROM prices LEFT JOIN (SELECT delivery_ts, wind_onshore_mw + wind_offshore_mw AS g FROM generation) USING (delivery_ts)
  GROUP BY market) USING (market)""")
def _(spark, sf):
    rates = settlement.capture_rates(D.prices(spark, sf), D.generation(spark, sf))
    return rounded(settlement.curtailment_loss(D.contracts(spark, sf), rates), 4)


@add("counterparty_mtm", f"""
SELECT counterparty AS counterparty_id, count(DISTINCT contract_id) AS n_contracts, round(sum(eur), 4) AS mtm_eur
FROM ({_BOOK_SQL}) GROUP BY counterparty""")
def _(spark, sf):
    book = settlement.contract_exposure_daily(D.contracts(spark, sf), D.prices(spark, sf))
    return rounded(settlement.counterparty_mtm(book), 4)


@add("cfd_settlement", """
SELECT contract_id, delivery_date, ppa_type, volume_mw * hours AS output_mwh,
       round(CASE WHEN ppa_type = 'physical' THEN strike_price_eur ELSE strike_price_eur - p END * (volume_mw * hours), 4)
         AS settlement_eur
FROM contracts JOIN (SELECT market, delivery_date, count(*) AS hours, avg(price_eur_mwh) AS p FROM prices GROUP BY ALL)
     USING (market)""")
def _(spark, sf):
    return rounded(settlement.cfd_settlement(D.contracts(spark, sf), D.prices(spark, sf)), 4)


@add("floor_settlement", """
SELECT contract_id, floor_price, count(*) AS negative_hours, round(sum(price_eur_mwh) * volume_mw, 4) AS market_value_eur,
       round(sum(greatest(price_eur_mwh, floor_price)) * volume_mw, 4) AS settled_value_eur,
       round(sum(greatest(price_eur_mwh, floor_price) - price_eur_mwh) * volume_mw, 4) AS protection_eur
FROM contracts JOIN prices USING (market) WHERE is_negative GROUP BY contract_id, floor_price, volume_mw""")
def _(spark, sf):
    return rounded(settlement.floor_settlement(D.contracts(spark, sf), D.prices(spark, sf)), 4)


@add("take_or_pay", """
SELECT contract_id, month, scheduled_mwh, taken_mwh,
       round(greatest(0, 0.8 * scheduled_mwh - taken_mwh), 4) AS shortfall_mwh,
       round(greatest(0, 0.8 * scheduled_mwh - taken_mwh) * strike_price_eur, 4) AS payment_eur
FROM (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity) AS scheduled_mwh,
             sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS taken_mwh FROM lineitem GROUP BY ALL) t
JOIN supplier ON s_suppkey = l_suppkey JOIN contracts ON contract_id = s_name""")
def _(spark, sf):
    # Deliveries under a contract: what is returned was scheduled but not taken.
    names = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("contract_id"))
    quantity = F.col("l_quantity")
    rows = D.table(spark, sf, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.sum(quantity).alias("scheduled_mwh"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.lit(0.0)).otherwise(quantity)).alias("taken_mwh"),
    ).join(names, "l_suppkey")
    return rounded(settlement.take_or_pay(D.contracts(spark, sf), rows), 4)


_CURTAILED_SQL = f"""
SELECT c.contract_id, sum(c.volume_mw) AS proxy_mwh, sum(e.price_eur_mwh) AS redispatch_eur
FROM contracts c JOIN (SELECT dso_zone, price_eur_mwh FROM congestion) e ON {_MATCH} GROUP BY c.contract_id"""


def _curtailed(spark, sf):
    """One curtailed hour per event in a matching zone, reduced to one row per contract."""
    zones = D.congestion(spark, sf).groupBy("dso_zone").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("price_eur_mwh").alias("_eur")
    )
    book = D.contracts(spark, sf).select("contract_id", "delivery_point", "volume_mw")
    return book.join(C.point_zones(book, zones), "delivery_point").join(zones, "dso_zone").select(
        "contract_id", (F.col("volume_mw") * F.col("_n")).alias("proxy_mwh"), F.col("_eur").alias("redispatch_eur")
    )


@add("curtailment_compensation", f"""
SELECT contract_id, curtailment_compensation, proxy_mwh, round(redispatch_eur, 4) AS redispatch_eur,
       round(CASE WHEN curtailment_compensation THEN greatest(0, strike_price_eur * proxy_mwh - redispatch_eur) ELSE 0 END, 4)
         AS compensation_eur FROM contracts JOIN ({_CURTAILED_SQL}) USING (contract_id)""")
def _(spark, sf):
    return rounded(settlement.curtailment_compensation(D.contracts(spark, sf), _curtailed(spark, sf)), 4)


@add("redispatch_share", """
SELECT event_id, price_eur_mwh * mw_needed AS redispatch_eur, round(price_eur_mwh * mw_needed * 0.6, 6) AS seller_eur,
       round(price_eur_mwh * mw_needed * 0.4, 6) AS buyer_eur FROM (SELECT event_id, price_eur_mwh, mw_needed FROM congestion)""")
def _(spark, sf):
    rows = D.congestion(spark, sf).select("event_id", (F.col("price_eur_mwh") * F.col("mw_needed")).alias("redispatch_eur"))
    shared = settlement.redispatch_share(rows)
    return shared.withColumns({c: F.round(c, 6) for c in ("seller_eur", "buyer_eur")})


@add("strike_indexation", """
SELECT contract_id, CAST(y AS INT) AS contract_year, cpi, CASE WHEN y < 3 THEN 0 ELSE step END AS indexation,
       round(strike_price_eur * exp(sum(ln(1 + CASE WHEN y < 3 THEN 0 ELSE step END))
             OVER (PARTITION BY contract_id ORDER BY y)), 6) AS indexed_strike_eur
FROM (SELECT *, least(0.03::DOUBLE, greatest(-0.01::DOUBLE, 0.7::DOUBLE * cpi)) AS step
      FROM (SELECT *, ((y * 7) % 11 - 3) / 97.0::DOUBLE AS cpi
            FROM (SELECT *, unnest(range(1, tenor_years + 1)) AS y FROM contracts)))""")
def _(spark, sf):
    years = D.contracts(spark, sf).select(
        "contract_id", "strike_price_eur", F.explode(F.sequence(F.lit(1), "tenor_years")).alias("contract_year")
    ).withColumn("cpi", ((F.col("contract_year") * 7) % 11 - 3) / 97)
    return settlement.strike_indexation(years).withColumn("indexed_strike_eur", F.round("indexed_strike_eur", 6))


@add("expected_generation", """
SELECT contract_id, round(volume_mw * 8760 * 0.35, 6) AS expected_mwh,
       CAST(floor(volume_mw * 8760 * 0.35 / 1000) AS BIGINT) AS expected_gwh FROM contracts""")
def _(spark, sf):
    return rounded(settlement.expected_generation(D.contracts(spark, sf)))


_IMBALANCE = "SELECT p.market, p.delivery_ts, p.price_eur_mwh, r.price_eur_mwh AS imbalance_price FROM prices p JOIN (" + \
    hourly("last") + ") r ON p.market = r.market AND p.delivery_ts = r.delivery_ts"


def _imbalance(spark, sf):
    """Day-ahead price next to the imbalance price, the last event value of the hour."""
    late = D.hourly(D.events(spark, sf), latest=True)
    return D.prices(spark, sf).select("market", "delivery_ts", "price_eur_mwh").join(
        late.select("market", "delivery_ts", F.col("price_eur_mwh").alias("imbalance_price")), ["market", "delivery_ts"]
    )


@add("imbalance_prices", f"SELECT * FROM ({_IMBALANCE})")
def _(spark, sf):
    return _imbalance(spark, sf)


@add("imbalance_trigger", f"""
SELECT market, min(delivery_ts) AS window_start, max(delivery_ts) AS window_end, count(*) AS periods,
       round(avg(imbalance_price), 6) AS avg_imbalance_price
FROM (SELECT *, sum(b) OVER (PARTITION BY market ORDER BY delivery_ts) AS run
      FROM (SELECT *, CASE WHEN epoch(delivery_ts) - epoch(lag(delivery_ts) OVER (PARTITION BY market ORDER BY delivery_ts))
                                > 3600 THEN 1 ELSE 0 END AS b
            FROM ({_IMBALANCE}) WHERE imbalance_price > 0.9 * price_eur_mwh))
GROUP BY market, run HAVING count(*) >= 3""")
def _(spark, sf):
    # Most hours hold one event, so both prices agree; the ratio is set to where runs occur.
    return rounded(islands.imbalance_trigger(_imbalance(spark, sf), period_seconds=3600, ratio=0.9))


_PRICED = "SELECT market, delivery_ts, price_eur_mwh / 2 AS price_eur_mwh, 1.05::DOUBLE * price_eur_mwh AS imbalance_price FROM prices"


@add("imbalance_trigger_published", f"""
SELECT market, min(delivery_ts) AS window_start, max(delivery_ts) AS window_end, count(*) AS periods,
       round(avg(imbalance_price), 6) AS avg_imbalance_price
FROM (SELECT *, sum(b) OVER (PARTITION BY market ORDER BY delivery_ts) AS run
      FROM (SELECT *, CASE WHEN epoch(delivery_ts) - epoch(lag(delivery_ts) OVER (PARTITION BY market ORDER BY delivery_ts))
                                > 3600 THEN 1 ELSE 0 END AS b
            FROM ({_PRICED}) WHERE imbalance_price > 2.0 * price_eur_mwh))
GROUP BY market, run HAVING count(*) >= 3""")
def _(spark, sf):
    # The published ratio; the stand-in imbalance price is above twice the day-ahead price in hours of positive prices.
    periods = D.prices(spark, sf).select(
        "market", "delivery_ts", (F.col("price_eur_mwh") / 2).alias("price_eur_mwh"),
        (F.col("price_eur_mwh") * 1.05).alias("imbalance_price"),
    )
    return rounded(islands.imbalance_trigger(periods, period_seconds=3600))


@add("get_market_signals", """
SELECT market, delivery_ts, signal_type, severity, price_eur_mwh FROM signals
WHERE market = 'view' AND delivery_ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOUR
      AND delivery_ts <= TIMESTAMP '2024-01-20 00:00:00' AND signal_type <> 'normal'""")
def _(spark, sf):
    gold.signal_filter(D.signals(spark, sf)).createOrReplaceTempView("market_risk_signals")
    gold.register_get_market_signals(spark, "market_risk_signals")
    return spark.sql("SELECT * FROM get_market_signals('view', 48, TIMESTAMP '2024-01-20 00:00:00')")


@add("minimal_report", """
SELECT query_id, market, negative_hours_90d, avg_negative_price,
       CASE WHEN avg_negative_price IS NULL THEN 'minimal' ELSE 'full' END AS report_kind
FROM questions LEFT JOIN (SELECT * FROM market_stats WHERE market <> 'view') USING (market)""")
def _(spark, sf):
    # One market has no statistics.
    stats = gold.negative_stats(D.signals(spark, sf).filter("market <> 'view'"), by=["market"]).select(
        "market", "negative_hours_90d", "avg_negative_price"
    )
    return settlement.minimal_report(D.questions(spark, sf).drop("query"), stats)

"""Boundary rows of signals, features, sessions, congestion and exposure."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridledger.functions import market as M
from gridledger.plans import checks_market
from gridledger.operators import congestion, eda, gold, islands, quality, risk, rolling, settlement, silver

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2026, 3, 23)


def one(df):
    return [r[0] for r in df.collect()]


def test_severity_bounds(rows):
    df = rows([(-100.01, False), (-100.0, False), (-30.0, False), (-0.01, True), (0.0, False), (0.0, True), (5.0, None)],
              "p double, o boolean")
    got = one(df.select(M.classify_severity(F.col("p"), F.col("o"))))
    assert got == ["CRITICAL", "HIGH", "MEDIUM", "MEDIUM", "NONE", "LOW", "NONE"]


def test_parse_ts_takes_millis_and_iso(rows):
    df = rows([("1774224000000",), ("2026-03-23T00:00:00.000Z",), ("soon",), (None,)], "x string")
    assert one(df.select(M.parse_ts(F.col("x")))) == [START, START, None, None]


def test_rounding_of_exposure(rows):
    df = rows([(168, -28.7), (200, -30.0)], "h bigint, p double")
    assert one(df.select(M.calc_exposure(F.col("h"), F.col("p")))) == [195543.0, 243333.0]
    assert one(df.select(M.curtailment_exposure(F.col("h"), F.col("p"))))[0] == round(50 * (365 / 90) * 10 * 14.35, 0)


def test_python_like_number_text(rows):
    df = rows([(-28.25,), (-28.75,), (2.5,), (1234567.5,)], "x double")
    assert one(df.select(M.fixed_point(F.col("x"), 1))) == [f"{v:.1f}" for v in (-28.25, -28.75, 2.5, 1234567.5)]
    assert one(df.select(M.whole_euros(F.col("x")))) == [f"{v:,.0f}" for v in (-28.25, -28.75, 2.5, 1234567.5)]


def test_full_exposure_and_its_rules(rows):
    df = rows([("a", 168, -28.7, 10.0, None), ("b", 168, -28.7, 10.0, -5.0), ("c", 168, -28.7, 25.0, 0.0),
               ("d", 1, 3.0, 10.0, None), ("e", 1, -3.0, 0.0, None)],
              "id string, neg_hours int, avg_neg_price double, contracted_mw double, floor_price double")
    good, bad = quality.expect(df, risk.EXPOSURE_RULES, action="quarantine")
    got = {r["id"]: r for r in risk.calc_exposure_full(good).collect()}
    assert (got["a"]["exposure_window"], got["a"]["exposure_annual"]) == (48216.0, 195542.67)
    assert (got["b"]["effective_price"], got["b"]["exposure_annual"]) == (-5.0, 34066.67)
    assert got["c"]["exposure_annual"] == 0.0 and got["c"]["floor_protection"]
    assert sorted((r["id"], r["violations"][0]) for r in bad.collect()) == [
        ("d", "non_positive_price"), ("e", "positive_capacity")]


def test_null_counts_as_violation(rows):
    df = rows([(1,), (None,), (-1,)], "x int")
    assert one(quality.expect(df, {"pos": "x > 0"})) == [1]
    assert [tuple(r) for r in quality.expect_metrics(df, {"pos": "x > 0"}).collect()] == [("pos", 1, 2)]


def test_empty_text_fails_the_job(rows):
    with pytest.raises(Exception, match="no rows with t"):
        quality.nonempty_check(rows([(None,)], "t string"), "t").collect()


def prices(rows, values, market="NL", step=HOUR):
    data = [(market, START + i * step, (START + i * step).date(), (START + i * step).hour, float(v), v < 0)
            for i, v in enumerate(values)]
    return rows(data, "market string, delivery_ts timestamp, delivery_date date, hour int, price_eur_mwh double, is_negative boolean")


def test_sessions_split_above_3700_seconds(rows):
    stamps = [0, 3700, 7401, 7402]
    df = rows([("NL", START + dt.timedelta(seconds=s), -1.0, True) for s in stamps],
              "market string, delivery_ts timestamp, price_eur_mwh double, is_negative boolean")
    got = sorted((r["window_start"], r["hours_count"]) for r in islands.negative_windows(df).collect())
    assert got == [(START, 2), (START + dt.timedelta(seconds=7401), 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_equal_one_plain_window(spark, rows, seed):
    rnd = random.Random(seed)
    t, data = START, []
    for _ in range(600):
        t += dt.timedelta(seconds=rnd.choice([900, 3600, 3700, 3701, 9000]))
        data.append(("a" if rnd.random() < 0.7 else "b", t, float(rnd.randint(-90, -1)), True))
    df = rows(data, "market string, delivery_ts timestamp, price_eur_mwh double, is_negative boolean").dropDuplicates(
        ["market", "delivery_ts"])
    got = {(r.market, r.window_start, r.window_end, r.hours_count, r.min_price) for r in islands.negative_windows(df).collect()}
    batch = df.groupBy(F.session_window("delivery_ts", "3700 seconds"), "market").agg(
        F.min("delivery_ts").alias("s"), F.max("delivery_ts").alias("e"), F.count("*").alias("n"),
        F.min("price_eur_mwh").alias("m"))
    want = {(r.market, r.s, r.e, r.n, r.m) for r in batch.collect()}
    # session_window lets a row join the run that ends exactly when it starts, as the gap rule does.
    assert got == want
    numbered = islands.gap_island(df, keys=["market"], ts="delivery_ts", gap_seconds=3700)
    assert numbered.groupBy("market", "island").count().count() == len(want)


@pytest.mark.parametrize("block_rows", [24, 50, 5000])
def test_blocked_windows_equal_plain_windows(rows, block_rows):
    rnd = random.Random(7)
    df = prices(rows, [rnd.randint(-9000, 9000) / 100 for _ in range(700)]).filter(F.col("hour") != 5).unionByName(
        prices(rows, [1.0, 2.0, 3.0], market="DE"))
    got = rolling.partitioned_rolling(
        df, keys=["market"], ts="delivery_ts", block_rows=block_rows,
        frames={"a": (F.sum("price_eur_mwh"), 24), "n": (F.count("*"), 168)})
    w = Window.partitionBy("market").orderBy("delivery_ts")
    want = df.withColumns({"a": F.sum("price_eur_mwh").over(w.rowsBetween(-23, 0)),
                           "n": F.count("*").over(w.rowsBetween(-167, 0))})
    key = lambda d: sorted((r.market, r.delivery_ts, round(r.a, 6), r.n) for r in d.collect())
    assert key(got) == key(want)


def test_first_row_has_no_deviation(rows):
    first = rolling.hourly_price_features(prices(rows, [-5, 3, 4])).orderBy("delivery_ts").first()
    assert first["rolling_stddev_24h"] is None and first["volatility_flag"] is None


def test_features_need_one_sort(rows):
    plan = rolling.hourly_price_features(prices(rows, [1.0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rolling_stddev_24h") and plan.count("Window [avg") == 1


def test_unmatched_price_keeps_row(rows):
    gen = rows([], "delivery_ts timestamp, delivery_date date, hour int, wind_onshore_mw double, wind_offshore_mw double, "
                   "solar_mw double, total_renewable_mw double, total_mw double, renewable_pct double, oversupply_flag boolean")
    got = {r["price_eur_mwh"]: (r["signal_type"], r["severity"], r["renewable_pct"])
           for r in gold.market_risk_signals(prices(rows, [-5, 7]), gen).collect()}
    assert got == {-5.0: ("negative_price", "MEDIUM", None), 7.0: ("normal", "NONE", None)}


def test_redelivered_rows_do_not_change_signals(rows):
    df = prices(rows, [-5, 7]).withColumn("ingestion_ts", F.lit(START))
    gen = df.select("delivery_ts", "delivery_date", "hour", *[F.lit(1.0).alias(c) for c in (
        "wind_onshore_mw", "wind_offshore_mw", "solar_mw", "total_renewable_mw", "total_mw", "renewable_pct")],
        F.lit(True).alias("oversupply_flag"), "ingestion_ts")
    once = gold.market_risk_signals(df, gen, dedupe=True)
    twice = gold.market_risk_signals(df.union(df), gen.union(gen), dedupe=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def events(rows, *data):
    return rows(list(data), "event_id string, dso_zone string, start_time timestamp, end_time timestamp, mw_needed double")


def test_congestion_levels_and_inclusive_ends(rows):
    now = F.lit(START)
    points = rows([("a", "Zeeland"), ("b", "Noord-Holland"), ("c", "Friesland"), ("d", "stedin-zeeland")],
                  "contract_id string, delivery_point string")
    for mw, level in [(50.0, "LOW"), (50.1, "MEDIUM"), (100.0, "MEDIUM"), (100.1, "HIGH")]:
        ev = events(rows, ("1", "Stedin-Zeeland", START, START, mw), ("2", "Enexis-Noord", START - HOUR, START - HOUR / 2, 900.0))
        got = {r["contract_id"]: r["risk_level"] for r in congestion.congestion_level(points, ev, as_of=now).collect()}
        assert got == {"a": level, "b": "NONE", "c": "NONE", "d": level}


def test_zone_needle_is_literal(rows):
    ev = events(rows, ("1", "A.B", START, START, 1.0), ("2", "AxB", START, START, 1.0), ("3", None, START, START, 1.0))
    assert [r["event_id"] for r in congestion.zone_filter(ev, "a.b").collect()] == ["1"]


def test_event_ending_on_the_hour_does_not_touch_the_next(rows):
    ev = events(rows, ("1", "z", START, START + HOUR, 5.0), ("2", "z", START + HOUR / 2, START + HOUR * 2.5, 7.0))
    hours = rows([(START + HOUR * i,) for i in range(4)], "delivery_ts timestamp")
    got = [(r[1], r[2]) for r in congestion.hour_congestion_overlap(hours, ev).orderBy("delivery_ts").collect()]
    assert got == [(True, 12.0), (True, 7.0), (True, 7.0), (False, 0.0)]


def test_generation_share_of_nothing_is_zero(rows):
    df = rows([(START, "B16", 8.0), (START, "B02", 2.0), (START + HOUR, "B02", 0.0), (START + 2 * HOUR, "B16", 7.0),
               (START + 2 * HOUR, "B02", 3.0)], "delivery_ts timestamp, psr_type string, value_mw double")
    got = [(r["renewable_pct"], r["oversupply_flag"]) for r in silver.generation_features(silver.fuel_pivot(df)).orderBy("delivery_ts").collect()]
    assert got == [(0.8, True), (0.0, False), (0.7, False)]


def test_rolling_days_need_observations(rows):
    daily = rows([("NL", START.date() + dt.timedelta(days=i), i) for i in range(5)],
                 "market string, delivery_date date, neg_hours_per_day bigint")
    got = [r["rolling_90d"] for r in rolling.rolling_90d_neg(daily, rows=3, min_obs=2).orderBy("delivery_date").collect()]
    assert got == [None, 1, 3, 6, 9]


def test_p_value(rows):
    df = rows([(float(x), y) for x, y in [(1, False), (2, False), (3, True), (4, False), (5, True), (6, True)]],
              "renewable_pct double, is_negative boolean")
    r = eda.point_biserial(df).first()
    # With 4 degrees of freedom the distribution has a closed form: t = 1.870829 gives p = 0.134702.
    assert abs(r["corr"] - 0.6831300510639732) < 1e-9 and abs(r["p_value"] - 0.134702) < 1e-6
    assert r["strength"] == "Strong"


def test_p_value_tail():
    assert abs(eda._two_sided_t(2.0, 10.0) - 0.0733880) < 1e-6
    assert abs(eda._two_sided_t(0.0, 5.0) - 1.0) < 1e-12


def test_percentile_equals_brute_force(rows):
    rnd = random.Random(3)
    values = [rnd.randint(-50, 50) for _ in range(120)]
    got = [r[3] for r in rolling.feat_percentile_90d(prices(rows, values), days=2).orderBy("delivery_ts").collect()]
    want = [sum(v <= values[i] for v in values[max(0, i - 47): i + 1]) / len(values[max(0, i - 47): i + 1]) for i in range(120)]
    assert got == pytest.approx(want)


def test_indexation_is_capped_and_starts_in_year_three(rows):
    df = rows([("a", y, c, 100.0) for y, c in [(1, 0.1), (2, 0.1), (3, 0.1), (4, -0.1), (5, 0.02)]],
              "contract_id string, contract_year int, cpi double, strike_price_eur double")
    got = [r["indexed_strike_eur"] for r in settlement.strike_indexation(df).orderBy("contract_year").collect()]
    assert got == pytest.approx([100, 100, 103, 103 * 0.99, 103 * 0.99 * 1.014])


def test_eur_severity_bounds(rows):
    df = rows([(49_999.99,), (50_000.0,), (500_000.0,), (500_000.01,), (5_000_000.0,), (5_000_000.01,), (None,)], "x double")
    assert one(df.select(M.severity_by_eur(F.col("x")))) == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", None]


def test_rows_without_key_or_time_stay(rows):
    data = [(m, t, 1.0) for m in ("NL", None) for t in ("2024-01-01 00:00:00", "2024-01-01 01:00:00", None)]
    df = rows(data, "market string, t string, price_eur_mwh double").selectExpr("market", "timestamp(t) AS delivery_ts", "price_eur_mwh")
    assert islands.gap_island(df, keys=["market"], ts="delivery_ts", gap_seconds=3700).count() == 6
    frames = {"m": (F.avg("price_eur_mwh"), 2)}
    assert rolling.partitioned_rolling(df, keys=["market"], ts="delivery_ts", frames=frames).count() == 6


def test_only_outer_runs_of_a_bucket_go_on(rows):
    day = dt.datetime(2026, 1, 1)
    hours = [day + dt.timedelta(days=d, hours=h) for d in range(75) for h in (0, 1, 5, 9, 22, 23) if (d, h) != (31, 0)]
    df = rows([("NL", t, -1.0, True) for t in hours], "market string, delivery_ts timestamp, price_eur_mwh double, is_negative boolean")
    runs = df.select("market", F.col("delivery_ts").alias("window_start"), F.col("delivery_ts").alias("window_end"),
                     F.col("price_eur_mwh").alias("_sum"), F.col("price_eur_mwh").alias("min_price"),
                     F.lit(1).cast("bigint").alias("hours_count"), F.lit(False).alias("_done"))
    for bucket in ("day", "month"):
        runs = islands._join_runs(runs, ["market"], bucket, 3700)
    left = runs.filter("NOT _done").groupBy(F.trunc("window_start", "month")).count().collect()
    assert len(left) == 3 and all(r["count"] <= 2 for r in left)
    # By hand: a new run wherever the step is longer.
    want, run = [], [hours[0]]
    for t in hours[1:]:
        if (t - run[-1]).total_seconds() > 3700:
            want.append(run)
            run = []
        run.append(t)
    want.append(run)
    got = islands.negative_windows(df).select("window_start", "window_end", "hours_count").collect()
    assert sorted(map(tuple, got)) == [(r[0], r[-1], len(r)) for r in want]


def test_an_event_of_a_century(rows):
    at = dt.datetime(2026, 3, 23)
    hours = rows([(at + dt.timedelta(hours=h),) for h in range(3)] + [(None,), (at + dt.timedelta(minutes=30),)], "delivery_ts timestamp")
    ev = rows([(dt.datetime(1960, 1, 1), dt.datetime(2060, 1, 1), 0.1), (at - dt.timedelta(days=2), at + dt.timedelta(hours=1), 0.2),
               (at, None, 7.0), (at + dt.timedelta(hours=2), at + dt.timedelta(hours=1), 5.0), (at, at, None)],
              "start_time timestamp, end_time timestamp, mw_needed double")
    got = {r[0]: (r[1], r[2]) for r in congestion.hour_congestion_overlap(hours, ev).collect()}
    assert got == {
        at: (True, 0.3), at + dt.timedelta(hours=1): (True, 0.1), at + dt.timedelta(hours=2): (True, 5.1),
        None: (False, 0.0), at + dt.timedelta(minutes=30): (False, 0.0),
    }


def test_daily_counts_of_an_event_of_a_century(rows):
    at = dt.datetime(2026, 3, 23)
    days = rows([(at.date() + dt.timedelta(days=d),) for d in (0, 1, 2, 2)] + [(None,)], "signal_date date")
    ev = rows([(dt.datetime(1960, 1, 1), dt.datetime(2060, 1, 1), 0.1), (at - dt.timedelta(days=2), at + dt.timedelta(days=1), 0.2),
               (at + dt.timedelta(days=1), None, 7.0), (None, at, 9.0), (at + dt.timedelta(days=2), at, 5.0), (at, at, None)],
              "start_time timestamp, end_time timestamp, mw_needed double")
    got = {r[0]: (r[1], r[2]) for r in settlement.events_per_day(days, ev).collect()}
    day = lambda d: at.date() + dt.timedelta(days=d)
    assert got == {day(0): (3, 0.3), day(1): (2, 7.1), day(2): (2, 5.1)}


def test_imbalance_trigger_with_published_ratio(rows):
    hours = [(f"2024-01-01 {h:02d}:00:00", p) for h, p in enumerate([20.0, 20.1, 25.0, 30.0, 20.0, 21.0, 22.0])]
    df = rows([("a", t, 10.0, p) for t, p in hours], "market string, t string, price_eur_mwh double, imbalance_price double")
    got = islands.imbalance_trigger(df.selectExpr("*", "timestamp(t) AS delivery_ts"), period_seconds=3600).collect()
    assert [(r["window_start"].hour, r["window_end"].hour, r["periods"]) for r in got] == [(1, 3, 3)]
    assert "imbalance_trigger_published" in checks_market.QUERIES


@pytest.mark.parametrize("frame", ["short", "percentile"])
def test_rows_without_a_time_stay_in_time_frames(rows, frame):
    data = [(m, t, p) for m in ("NL", None) for t in ("2024-01-01 00:00:00", "2024-03-01 01:00:00", None) for p in (1.0, 2.0, 2.0, 3.0, None, -1.0, 0.5, 4.0)]
    df = rows(data, "market string, t string, price_eur_mwh double").selectExpr("market", "timestamp(t) AS delivery_ts", "price_eur_mwh")
    assert df.count() == 48
    if frame == "short":
        got = rolling.feat_rolling_30_90(df).collect()
        assert len(got) == 48 and all(abs(r.rolling_30d_mean - 11.5 / 7) < 1e-9 for r in got)
    else:
        got = rolling.feat_percentile_90d(df).collect()
        assert len(got) == 48
        below = {1.0: 3, 2.0: 5, 3.0: 6, -1.0: 1, 0.5: 2, 4.0: 7}
        for r in got:
            earlier = 2 if r.delivery_ts is not None and r.delivery_ts.month == 3 else 1  # the frame holds January too
            want = None if r.price_eur_mwh is None else below[r.price_eur_mwh] * earlier / (7 * earlier)
            assert r.price_percentile_90d is None if want is None else abs(r.price_percentile_90d - want) < 1e-12


def test_a_dense_day_is_not_copied_into_each_block(spark):
    day = spark.range(86_400).selectExpr("'NL' AS market", "timestamp_seconds(1700000000 + id) AS delivery_ts", "cast(id % 97 AS double) AS v")
    placed = rolling.with_blocks(day, keys=["market"], ts="delivery_ts", block_rows=4096, halo_rows=167)
    assert 86_400 < placed.count() < 1.1 * 86_400 and placed.filter("_own").count() == 86_400
    same = spark.range(20_000).selectExpr("'NL' AS market", "timestamp'2024-01-01' AS delivery_ts", "1.0 AS v")
    got = rolling.partitioned_rolling(same, keys=["market"], ts="delivery_ts", frames={"n": (F.count("*"), 24)}).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in got} == {**{i: 1 for i in range(1, 24)}, 24: 20_000 - 23}


def test_counts_at_most_equal_plain_counts():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 33, 400):
        values = rng.integers(-5, 6, n).astype(float)
        low = np.minimum(rng.integers(0, n, n), np.arange(n))
        high = np.arange(n) + 1
        want = [int((values[a:b] <= v).sum()) for v, a, b in zip(values, low, high, strict=True)]
        assert rolling.counts_at_most(values, low, high).tolist() == want


def test_order_statistics_are_exact(rows):
    from gridledger.operators import eda

    rnd = random.Random(8)
    data = [rnd.choice([0.0, -0.0, 1.5, rnd.gauss(0, 1), rnd.gauss(0, 1) * 1e300, 1e-300, -1e308, 1e308, 7.0]) for _ in range(999)]
    df = rows([(v,) for v in data] + [(None,)], "v double")
    got = eda.order_statistics(df, "v", [0, 1, 400, 500, 501, 997, 998])
    assert got == {r: sorted(data)[r] for r in got} and len(got) == 7
    tens = rows([(float(i),) for i in range(10)], "v double")
    assert eda.exact_quantiles(tens, "v", [0.0, 0.25, 0.5, 1.0]) == [0.0, 2.25, 4.5, 9.0]
    assert eda.exact_quantiles(tens.limit(0), "v", [0.5]) == [None] and eda.exact_quantiles(rows([(3.0,)] * 5, "v double"), "v", [0.3]) == [3.0]

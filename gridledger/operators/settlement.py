"""Contract settlement, daily risk tables and scenario measures over prices and contracts.

Contracts carry contract_id, market, ppa_type, strike_price_eur, volume_mw,
floor_price, counterparty and curtailment_compensation; prices are hourly.
Hourly terms that depend on a contract only through constants are reduced per
market first, so contracts join a table of days or totals, not of hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import market as M


def feat_calendar(prices: DataFrame, *, zone: str = "Europe/Amsterdam") -> DataFrame:
    local = F.from_utc_timestamp("delivery_ts", zone)
    dow = F.weekday(local) + 1
    return prices.select(
        "market", "delivery_ts", F.hour(local).alias("hour_of_day"), dow.alias("day_of_week"),
        (dow >= 6).alias("is_weekend"),
    )


def feat_renewable_share(generation: DataFrame) -> DataFrame:
    wind = F.col("wind_onshore_mw") + F.col("wind_offshore_mw")
    return generation.select(
        "delivery_ts", F.col("solar_mw").alias("solar_generation_mw"), wind.alias("wind_generation_mw"),
        F.try_divide(F.col("solar_mw") + wind, F.col("total_mw")).alias("renewable_share"),
    )


def events_per_day(days: DataFrame, events: DataFrame) -> DataFrame:
    """Per distinct ``signal_date`` of ``days``: how many events touch it, and their MW.

    An event is two rows however long it lasts: it is added on its first day and taken
    back after its last (its first, if it has no end).  Running sums go over one row
    per day, in millionths of a MW, so that what is added and taken back cancels out.
    """
    first = F.to_date("start_time")
    last = F.greatest(first, F.to_date(F.col("end_time") - F.expr("INTERVAL 0.000001 SECOND")))
    mw = F.coalesce("mw_needed", F.lit(0.0)).cast("decimal(28,6)")
    steps = events.filter("start_time IS NOT NULL").select(
        F.explode(F.array(
            F.struct(first.alias("signal_date"), mw.alias("_mw"), F.lit(1).alias("_n")),
            F.struct(F.date_add(last, 1).alias("signal_date"), (-mw).alias("_mw"), F.lit(-1).alias("_n")),
        )).alias("_e")
    ).select("_e.*", F.lit(False).alias("_asked"))
    asked = days.filter("signal_date IS NOT NULL").distinct().select(
        "signal_date", F.lit(0).cast("decimal(28,6)").alias("_mw"), F.lit(0).alias("_n"), F.lit(True).alias("_asked")
    )
    per_day = steps.unionByName(asked).groupBy("signal_date").agg(
        F.sum("_mw").alias("_mw"), F.sum("_n").alias("_n"), F.bool_or("_asked").alias("_asked")
    )
    so_far = Window.orderBy("signal_date").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(
        "signal_date", "_asked", F.sum("_n").over(so_far).alias("gopacs_events_count"),
        F.sum("_mw").over(so_far).cast("double").alias("gopacs_total_mw"),
    ).filter("_asked").drop("_asked")


def daily_market_risk(prices: DataFrame, generation: DataFrame, events: DataFrame) -> DataFrame:
    """One row per market and day: level, volatility, counts, capture rates, congestion, risk level."""
    wind = F.col("wind_onshore_mw") + F.col("wind_offshore_mw")
    gen = generation.select("delivery_ts", wind.alias("_wind"), F.col("solar_mw").alias("_solar"))
    price = F.col("price_eur_mwh")
    daily = prices.join(gen, "delivery_ts", "left").groupBy("market", F.col("delivery_date").alias("signal_date")).agg(
        F.avg(price).alias("daily_avg_price"),
        F.stddev_samp(price).alias("daily_volatility"),
        F.count_if(price < 0).alias("negative_price_hours"),
        F.count_if(price > V.SPIKE_ABOVE).alias("price_spike_hours"),
        F.try_divide(F.sum(price * F.col("_wind")), F.sum("_wind")).alias("_wind_price"),
        F.try_divide(F.sum(price * F.col("_solar")), F.sum("_solar")).alias("_solar_price"),
    )
    per_day = events_per_day(prices.select(F.col("delivery_date").alias("signal_date")), events)
    out = daily.join(per_day, "signal_date", "left").select(
        "market", "signal_date", "daily_avg_price", "daily_volatility", "negative_price_hours", "price_spike_hours",
        F.try_divide("_wind_price", "daily_avg_price").alias("capture_rate_wind"),
        F.try_divide("_solar_price", "daily_avg_price").alias("capture_rate_solar"),
        F.coalesce("gopacs_events_count", F.lit(0).cast("bigint")).alias("gopacs_events_count"),
        F.coalesce("gopacs_total_mw", F.lit(0.0)).alias("gopacs_total_mw"),
    )
    alerts = [
        F.col("negative_price_hours") > V.NEGATIVE_HOURS_ALERT,
        F.col("price_spike_hours") > 0,
        F.coalesce(F.least("capture_rate_wind", "capture_rate_solar") < V.CAPTURE_ALERT_BELOW, F.lit(False)),
    ]
    n = alerts[0].cast("int") + alerts[1].cast("int") + alerts[2].cast("int")
    level = F.when(n == 0, F.lit("LOW")).when(n == 1, F.lit("MEDIUM")).when(n == 2, F.lit("HIGH"))
    return out.withColumn("risk_level", level.otherwise(F.lit("CRITICAL")))


def daily_prices(prices: DataFrame) -> DataFrame:
    return prices.groupBy("market", "delivery_date").agg(
        F.count(F.lit(1)).alias("hours"), F.avg("price_eur_mwh").alias("market_price_eur_mwh")
    )


def contract_exposure_daily(contracts: DataFrame, prices: DataFrame) -> DataFrame:
    """Mark-to-market per contract and day with the running total since the first day."""
    joined = contracts.join(daily_prices(prices), "market")
    volume = F.col("volume_mw") * F.col("hours")
    spread = F.col("strike_price_eur") - F.col("market_price_eur_mwh")
    rows = joined.select(
        "contract_id", F.col("delivery_date").alias("exposure_date"),
        volume.alias("contracted_volume_mwh"), F.col("strike_price_eur").alias("contract_price_eur_mwh"),
        "market_price_eur_mwh", spread.alias("spread_eur_mwh"), (spread * volume).alias("daily_exposure_eur"),
        F.upper("ppa_type").alias("ppa_type"), F.col("counterparty").alias("counterparty_id"),
    )
    w = Window.partitionBy("contract_id").orderBy("exposure_date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative_exposure_eur", F.sum("daily_exposure_eur").over(w))


def negative_exposure_strike(contracts: DataFrame, prices: DataFrame) -> DataFrame:
    """Sum over negative hours of (strike - price) x MW, from per-market totals of those hours."""
    totals = prices.filter("is_negative").groupBy("market").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("price_eur_mwh").alias("_sum")
    )
    amount = (F.col("strike_price_eur") * F.col("_n") - F.col("_sum")) * F.col("volume_mw")
    return contracts.join(totals, "market").select(
        "contract_id", F.col("_n").alias("negative_hours"), amount.alias("exposure_eur"),
        M.severity_by_eur(amount).alias("severity"),
    )


def cfd_settlement(contracts: DataFrame, prices: DataFrame) -> DataFrame:
    """Settlement per contract and day at constant output: strike x MWh if physical, else the signed difference."""
    joined = contracts.join(daily_prices(prices), "market")
    output = F.col("volume_mw") * F.col("hours")
    per_mwh = F.when(F.col("ppa_type") == "physical", F.col("strike_price_eur")).otherwise(
        F.col("strike_price_eur") - F.col("market_price_eur_mwh")
    )
    return joined.select(
        "contract_id", "delivery_date", "ppa_type", output.alias("output_mwh"),
        (per_mwh * output).alias("settlement_eur"),
    )


def floor_price_for(ppa_type: Column, granted: Column) -> Column:
    """The floor a contract grants: -20 if physical, 0 otherwise, none if it grants none."""
    return F.when(
        granted, F.when(ppa_type == "physical", F.lit(V.PHYSICAL_FLOOR)).otherwise(F.lit(V.FINANCIAL_FLOOR))
    )


def floor_settlement(contracts: DataFrame, prices: DataFrame) -> DataFrame:
    """Value of each contract's negative hours at max(price, floor).

    The floors in use are few, so hours are summed per market and floor and
    contracts join those sums.
    """
    floors = contracts.select("market", "floor_price").distinct()
    effective = F.greatest("price_eur_mwh", "floor_price")
    sums = prices.filter("is_negative").join(floors, "market").groupBy("market", "floor_price").agg(
        F.count(F.lit(1)).alias("negative_hours"), F.sum("price_eur_mwh").alias("_market"),
        F.sum(effective).alias("_floored"),
    )
    sums = sums.withColumnsRenamed({"market": "_m", "floor_price": "_f"})
    same = (F.col("market") == F.col("_m")) & F.col("floor_price").eqNullSafe(F.col("_f"))
    mw = F.col("volume_mw")
    return contracts.join(sums, same).select(
        "contract_id", "floor_price", "negative_hours", (F.col("_market") * mw).alias("market_value_eur"),
        (F.col("_floored") * mw).alias("settled_value_eur"),
        ((F.col("_floored") - F.col("_market")) * mw).alias("protection_eur"),
    )


def take_or_pay(contracts: DataFrame, taken: DataFrame) -> DataFrame:
    """Per contract and month: shortfall against the take-or-pay share, paid at the contract price.

    ``taken`` has contract_id, month, scheduled_mwh and taken_mwh, any number of rows per month.
    """
    monthly = taken.groupBy("contract_id", "month").agg(
        F.sum("scheduled_mwh").alias("scheduled_mwh"), F.sum("taken_mwh").alias("taken_mwh")
    )
    short = F.greatest(F.lit(0.0), F.col("take_or_pay_pct") * F.col("scheduled_mwh") - F.col("taken_mwh"))
    return monthly.join(contracts, "contract_id").select(
        "contract_id", "month", "scheduled_mwh", "taken_mwh", short.alias("shortfall_mwh"),
        (short * F.col("strike_price_eur")).alias("payment_eur"),
    )


def curtailment_compensation(contracts: DataFrame, curtailed: DataFrame) -> DataFrame:
    """Compensation for curtailed hours less redispatch payments; nothing where the contract pays none.

    ``curtailed`` has contract_id, proxy_mwh and redispatch_eur.
    """
    sums = curtailed.groupBy("contract_id").agg(
        F.sum("proxy_mwh").alias("proxy_mwh"), F.sum("redispatch_eur").alias("redispatch_eur")
    )
    amount = F.when(
        F.col("curtailment_compensation"),
        F.greatest(F.lit(0.0), F.col("strike_price_eur") * F.col("proxy_mwh") - F.col("redispatch_eur")),
    ).otherwise(F.lit(0.0))
    return sums.join(contracts, "contract_id").select(
        "contract_id", "curtailment_compensation", "proxy_mwh", "redispatch_eur", amount.alias("compensation_eur")
    )


def redispatch_share(revenues: DataFrame, *, amount: str = "redispatch_eur",
                     seller_share: float = V.SELLER_REDISPATCH_SHARE) -> DataFrame:
    return revenues.withColumns({
        "seller_eur": F.col(amount) * seller_share,
        "buyer_eur": F.col(amount) * (1 - F.lit(seller_share)),
    })


def strike_indexation(contract_years: DataFrame) -> DataFrame:
    """Strike per contract year: 70 % of inflation, kept within -1 % and +3 %, compounding from year three.

    ``contract_years`` has contract_id, contract_year, cpi and strike_price_eur; a
    contract's window holds one row per year of its term.
    """
    step = F.least(F.lit(V.INDEX_CAP), F.greatest(F.lit(V.INDEX_FLOOR), F.lit(V.CPI_SHARE) * F.col("cpi")))
    applied = F.when(F.col("contract_year") >= V.INDEX_FROM_CONTRACT_YEAR, step).otherwise(F.lit(0.0))
    w = Window.partitionBy("contract_id").orderBy("contract_year").rowsBetween(Window.unboundedPreceding, 0)
    factor = F.exp(F.sum(F.log1p("_step")).over(w))
    return contract_years.withColumn("_step", applied).select(
        "contract_id", "contract_year", "cpi", F.col("_step").alias("indexation"),
        (F.col("strike_price_eur") * factor).alias("indexed_strike_eur"),
    )


def expected_generation(contracts: DataFrame, *, capacity_factor: float = V.CAPACITY_FACTOR) -> DataFrame:
    mwh = F.col("volume_mw") * V.HOURS_PER_YEAR * capacity_factor
    return contracts.select("contract_id", mwh.alias("expected_mwh"), F.floor(mwh / 1000).alias("expected_gwh"))


def curtailment_loss(contracts: DataFrame, capture: DataFrame) -> DataFrame:
    """Expected yearly MWh x capture rate x (strike - floor); a contract without floor counts from 0."""
    mwh = F.col("volume_mw") * V.HOURS_PER_YEAR * V.CAPACITY_FACTOR
    loss = mwh * F.col("capture_rate") * (F.col("strike_price_eur") - F.coalesce("floor_price", F.lit(0.0)))
    return contracts.join(capture, "market").select("contract_id", "capture_rate", loss.alias("curtailment_loss_eur"))


def capture_rates(prices: DataFrame, generation: DataFrame) -> DataFrame:
    """Generation-weighted mean price over plain mean price, per market."""
    wind = F.col("wind_onshore_mw") + F.col("wind_offshore_mw")
    gen = generation.select("delivery_ts", wind.alias("_g"))
    price = F.col("price_eur_mwh")
    return prices.join(gen, "delivery_ts", "left").groupBy("market").agg(
        F.try_divide(F.try_divide(F.sum(price * F.col("_g")), F.sum("_g")), F.avg(price)).alias("capture_rate")
    )


def basis_risk_eur(contracts: DataFrame, prices: DataFrame, *, hub: str) -> DataFrame:
    """Per contract: sum over shared hours of (price at its market - price at the hub) x MW."""
    at_hub = prices.filter(F.col("market") == hub).select("delivery_ts", F.col("price_eur_mwh").alias("_hub"))
    spread = prices.join(at_hub, "delivery_ts").groupBy("market").agg(
        F.count(F.lit(1)).alias("shared_hours"), F.sum(F.col("price_eur_mwh") - F.col("_hub")).alias("_spread")
    )
    return contracts.join(spread, "market").select(
        "contract_id", "shared_hours", (F.col("_spread") * F.col("volume_mw")).alias("basis_risk_eur")
    )


def counterparty_mtm(exposures: DataFrame) -> DataFrame:
    """Mark-to-market per counterparty from contract_exposure_daily rows."""
    return exposures.groupBy("counterparty_id").agg(
        F.count_distinct("contract_id").alias("n_contracts"), F.sum("daily_exposure_eur").alias("mtm_eur")
    )


def scenario_var(contracts: DataFrame, prices: DataFrame) -> DataFrame:
    """P5, P50 and P95 of a contract's daily exposure, each past day being one scenario.

    Exposure rises with the spread, so the percentiles are taken per market over
    its days and scaled per contract.
    """
    spread = daily_prices(prices).groupBy("market").agg(
        F.percentile("market_price_eur_mwh", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_p")
    )
    daily_mwh = F.col("volume_mw") * 24
    # The exposure is strike - price: its low percentile is the price's high one.
    at = {n: (F.col("strike_price_eur") - F.get("_p", F.lit(i))) * daily_mwh for n, i in (("p5", 2), ("p50", 1), ("p95", 0))}
    return contracts.join(spread, "market").select("contract_id", *[v.alias(f"exposure_{n}_eur") for n, v in at.items()])


def minimal_report(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """Market facts per session; sessions of a market without statistics are marked for the reduced report."""
    return sessions.join(stats, "market", "left").withColumn(
        "report_kind", F.when(F.col("avg_negative_price").isNull(), F.lit("minimal")).otherwise(F.lit("full"))
    )

"""Price, signal and exposure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def parse_ts(value: Column) -> Column:
    """Timestamp from either an ISO string or epoch milliseconds written as text; NULL if neither."""
    return F.coalesce(
        F.try_to_timestamp(value),
        F.timestamp_millis(value.try_cast("bigint")),
    )


def classify_signal(is_negative: Column, oversupply: Column) -> Column:
    return (
        F.when(is_negative, F.lit("negative_price"))
        .when(oversupply, F.lit("oversupply"))
        .otherwise(F.lit("normal"))
    )


def classify_severity(price: Column, oversupply: Column) -> Column:
    """Market severity; every bound is strict, so exactly -100 is HIGH and exactly 0 is not negative."""
    return (
        F.when(price < V.CRITICAL_BELOW, F.lit("CRITICAL"))
        .when(price < V.HIGH_BELOW, F.lit("HIGH"))
        .when(price < V.MEDIUM_BELOW, F.lit("MEDIUM"))
        .when(oversupply, F.lit("LOW"))
        .otherwise(F.lit("NONE"))
    )


def classify_price_band(price: Column) -> Column:
    return (
        F.when(price < 0, F.lit("negative"))
        .when(price < V.LOW_BAND_BELOW, F.lit("low"))
        .otherwise(F.lit("normal"))
    )


def details_json(price: Column, share: Column, wind: Column, solar: Column) -> Column:
    """JSON text of the four drivers of a signal; NULL drivers are left out."""
    return F.to_json(
        F.struct(
            price.alias("price_eur_mwh"),
            share.alias("renewable_pct"),
            wind.alias("wind_onshore_mw"),
            solar.alias("solar_mw"),
        )
    )


def severity_rank(severity: Column) -> Column:
    """HIGH=0 .. INFO=3, anything else (also NULL) last."""
    ranks = F.create_map(*[F.lit(x) for kv in V.FLAG_SEVERITY_ORDER.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.coalesce(severity, F.lit(""))), F.lit(V.UNKNOWN_SEVERITY_ORDER))


def severity_by_eur(amount: Column) -> Column:
    return (
        F.when(amount < V.EUR_SEVERITY_LOW_BELOW, F.lit("LOW"))
        .when(amount <= V.EUR_SEVERITY_MEDIUM_UPTO, F.lit("MEDIUM"))
        .when(amount <= V.EUR_SEVERITY_HIGH_UPTO, F.lit("HIGH"))
        .when(amount.isNotNull(), F.lit("CRITICAL"))
    )


def calc_exposure(
    neg_hours: Column,
    avg_price: Column,
    *,
    mw: float = V.DEFAULT_CONTRACT_MW,
    window_days: int = V.EXPOSURE_WINDOW_DAYS,
) -> Column:
    """Annualised EUR exposure, rounded half-even to whole EUR."""
    yearly_hours = neg_hours * F.lit(V.DAYS_PER_YEAR / window_days)
    return F.bround(yearly_hours * F.lit(float(mw)) * F.abs(avg_price), 0)


def curtailment_exposure(neg_hours: Column, avg_price: Column) -> Column:
    """Exposure of the curtailed share: hours are truncated to whole hours first."""
    hours = (neg_hours * F.lit(V.CURTAILED_HOURS_SHARE)).cast("int")
    return calc_exposure(hours, F.abs(avg_price) * F.lit(V.CURTAILED_PRICE_SHARE))


def local_day(ts: Column, zone: str = "Europe/Amsterdam") -> Column:
    """Calendar day of a UTC timestamp in the market's own zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_day_bounds(day: Column, zone: str = "Europe/Amsterdam") -> Column:
    """UTC start (inclusive) and end (exclusive) of a local calendar day."""
    return F.struct(
        F.to_utc_timestamp(day.cast("timestamp"), zone).alias("start_utc"),
        F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone).alias("end_utc"),
    )


def fixed_point(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals and no thousands separator (ties to even)."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def whole_euros(value: Column) -> Column:
    """Text with thousands separators and no decimals (ties to even)."""
    return F.format_number(value, 0)

"""Grid-congestion events: filters, contract matching, hour overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V


def zone_filter(events: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive literal match anywhere in the zone name; unnamed zones never match."""
    return events.filter(F.contains(F.lower(F.coalesce("dso_zone", F.lit(""))), F.lit(needle.lower())))


def lookback_filter(events: DataFrame, *, as_of: Column, hours: int = 48) -> DataFrame:
    return events.filter(F.col("start_time") >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def active_at(events: DataFrame, as_of: Column) -> DataFrame:
    """Events running at ``as_of``, both ends included."""
    return events.filter((F.col("start_time") <= as_of) & (F.col("end_time") >= as_of))


def _zone_parts(zones: DataFrame) -> DataFrame:
    """Every substring of every zone name, so that 'contains' becomes an equality join.

    Zone names are short (a name of n letters has n(n+1)/2 parts) and few.
    """
    low = F.lower("dso_zone")
    size = F.length(low)
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    parts = F.flatten(F.transform(
        starts,
        lambda s: F.transform(F.sequence(F.lit(1), size - s + 1), lambda n: F.substring(low, s, n)),
    ))
    return zones.select("dso_zone", F.explode(F.array_distinct(parts)).alias("_part"))


def point_zones(points: DataFrame, zones: DataFrame, *, point: str = "delivery_point") -> DataFrame:
    """(delivery point, zone) where the zone name holds the whole point or its part before the first dash."""
    named = points.select(point).distinct().select(
        point,
        F.explode(F.array_distinct(F.array(
            F.lower(point), F.lower(F.element_at(F.split(point, "-"), 1))
        ))).alias("_part"),
    ).filter(F.col("_part") != "")
    pairs = named.join(_zone_parts(zones.select("dso_zone").distinct()), "_part")
    return pairs.select(point, "dso_zone").distinct()


def congestion_point_join(points: DataFrame, events: DataFrame, *, as_of: Column,
                          point: str = "delivery_point") -> DataFrame:
    """Contracts with each event active at ``as_of`` in a zone that matches their delivery point."""
    active = active_at(events, as_of)
    matched = point_zones(points, active, point=point)
    return points.join(matched, point).join(active, "dso_zone")


def congestion_level(points: DataFrame, events: DataFrame, *, as_of: Column, point: str = "delivery_point",
                     high: float = V.CONGESTION_HIGH_MW, medium: float = V.CONGESTION_MEDIUM_MW) -> DataFrame:
    """Per contract: number of active matching events, largest request, and the level.

    Events are reduced to one row per zone, then to one row per delivery
    point, before contracts are touched, so no contract-by-event pairs arise.
    """
    active = active_at(events, as_of)
    zones = active.groupBy("dso_zone").agg(
        F.count(F.lit(1)).alias("_n"), F.max("mw_needed").alias("_mw")
    )
    per_point = point_zones(points, zones, point=point).join(zones, "dso_zone").groupBy(point).agg(
        F.sum("_n").alias("_n"), F.max("_mw").alias("max_mw")
    )
    level = (
        F.when(F.col("_n").isNull(), F.lit("NONE"))
        .when(F.col("max_mw") > high, F.lit("HIGH"))
        .when(F.col("max_mw") > medium, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
    return points.join(per_point, point, "left").select(
        *points.columns,
        F.col("_n").isNotNull().alias("congested"),
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("active_events"),
        "max_mw",
        level.alias("risk_level"),
    )


def register_get_gopacs_congestion(spark, view: str) -> None:
    """Table function ``get_gopacs_congestion(zone, lookback_hours, as_of)`` over a registered view of events.

    Events that began in the hours before ``as_of``, in zones whose name holds ``zone`` (literal, in any case; an
    empty one holds for all named zones), with the level of their request.
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_gopacs_congestion(
            zone STRING DEFAULT '', lookback_hours INT DEFAULT 48, as_of TIMESTAMP DEFAULT current_timestamp())
        RETURNS TABLE (event_id STRING, dso_zone STRING, direction STRING, start_time TIMESTAMP, end_time TIMESTAMP,
                       mw_needed DOUBLE, active BOOLEAN, risk_level STRING)
        RETURN SELECT e.event_id, e.dso_zone, e.direction, e.start_time, e.end_time, e.mw_needed,
                      coalesce(e.end_time >= get_gopacs_congestion.as_of, false),
                      CASE WHEN e.mw_needed > {V.CONGESTION_HIGH_MW} THEN 'HIGH'
                           WHEN e.mw_needed > {V.CONGESTION_MEDIUM_MW} THEN 'MEDIUM' ELSE 'LOW' END
        FROM {view} e
        WHERE contains(lower(e.dso_zone), lower(get_gopacs_congestion.zone))
          AND e.start_time >= get_gopacs_congestion.as_of - make_interval(0, 0, 0, 0, get_gopacs_congestion.lookback_hours)
          AND e.start_time <= get_gopacs_congestion.as_of
    """)


def _hour_span() -> tuple[Column, Column]:
    """First and last hour an event touches; one that ends on the hour does not touch the next."""
    first = F.date_trunc("hour", "start_time")
    last = F.date_trunc("hour", F.col("end_time") - F.expr("INTERVAL 0.000001 SECOND"))
    return first, F.greatest(first, last)


def event_hours(events: DataFrame) -> DataFrame:
    """One row per event and delivery hour it overlaps.

    Turns the interval test into an equality on the hour; the fan-out is the
    length of an event in hours.
    """
    first, last = _hour_span()
    hours = F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))
    return events.withColumn("delivery_ts", F.explode(hours))


def hour_congestion_overlap(hours: DataFrame, events: DataFrame) -> DataFrame:
    """Each delivery hour with whether, and for how many MW in total, congestion events overlap it.

    An event is two rows however long it lasts: its MW are added in its first hour
    and taken back after its last.  Running sums go over the hours of a day, and
    over one row per day for what the days before leave open.  Sums are taken to
    the millionth of a MW, so that what is added and taken back cancels out.
    """
    first, last = _hour_span()
    mw = F.col("mw_needed").cast("decimal(28,6)")
    ends = events.filter("start_time IS NOT NULL AND end_time IS NOT NULL AND mw_needed IS NOT NULL").select(
        F.explode(F.array(
            F.struct(first.alias("delivery_ts"), mw.alias("_mw"), F.lit(1).alias("_n")),
            F.struct((last + F.expr("INTERVAL 1 HOUR")).alias("delivery_ts"), (-mw).alias("_mw"), F.lit(-1).alias("_n")),
        )).alias("_e")
    ).select("_e.*")
    asked = hours.select("delivery_ts").distinct().filter(F.col("delivery_ts") == F.date_trunc("hour", "delivery_ts"))
    steps = ends.unionByName(asked.withColumns({"_mw": F.lit(0).cast("decimal(28,6)"), "_n": F.lit(0)})).groupBy(
        F.to_date("delivery_ts").alias("_day"), "delivery_ts"
    ).agg(F.sum("_mw").alias("_mw"), F.sum("_n").alias("_n"))
    days = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    opened = steps.groupBy("_day").agg(F.sum("_mw").alias("_mw"), F.sum("_n").alias("_n")).select(
        "_day", F.coalesce(F.sum("_mw").over(days), F.lit(0)).alias("_open_mw"), F.coalesce(F.sum("_n").over(days), F.lit(0)).alias("_open")
    )
    day = Window.partitionBy("_day").orderBy("delivery_ts").rowsBetween(Window.unboundedPreceding, 0)
    per_hour = steps.select(
        "_day", "delivery_ts", F.sum("_mw").over(day).alias("_mw"), F.sum("_n").over(day).alias("_n")
    ).join(opened, "_day").select(
        "delivery_ts", (F.col("_open_mw") + F.col("_mw")).cast("double").alias("_mw"), (F.col("_open") + F.col("_n")).alias("_n")
    )
    return hours.join(per_hour, "delivery_ts", "left").select(
        *hours.columns,
        F.coalesce(F.col("_n") > 0, F.lit(False)).alias("has_gopacs_event"),
        F.coalesce("_mw", F.lit(0.0)).alias("gopacs_requested_mw"),
    )

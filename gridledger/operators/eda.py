"""Exploratory statistics over prices and renewable shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def neg_by_hour(prices: DataFrame, *, first: int = 0, last: int = 23) -> DataFrame:
    neg = F.col("is_negative").cast("int")
    return prices.filter(F.col("hour").between(first, last)).groupBy(F.col("hour").alias("hour_of_day")).agg(
        F.sum(neg).alias("neg_hours"), F.count(neg).alias("total_hours"), F.avg(neg).alias("neg_rate")
    )


#: Values between two boundaries that a round of a selection counts.
PARTS = 256


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values of the given ranks (from 0) among the filled ones of a column of numbers, exactly.

    A round cuts the stretch that still holds a rank into ``PARTS`` equal ones and counts each
    with its least and greatest value; the one that holds the rank is the next
    stretch.  It ends where both are equal.  The driver sees ``PARTS`` rows a stretch.
    """
    numbers = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    low, high = numbers.agg(F.min("v"), F.max("v")).first()
    open_ = {rank: (low, high, 0) for rank in ranks} if low is not None else {}
    while todo := sorted({(a, b, c) for a, b, c in open_.values() if a != b}):
        pieces = []
        for number, (a, b, _before) in enumerate(todo):
            # Halved first: a stretch may be as wide as all doubles.
            part = F.least(F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * PARTS), F.lit(PARTS - 1)).cast("int")
            pieces.append(F.when(F.col("v").between(a, b), F.struct(F.lit(number).alias("s"), part.alias("p"))))
        counted = numbers.select("v", F.explode(F.array_compact(F.array(*pieces))).alias("at")).groupBy("at.s", "at.p").agg(
            F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")
        )
        found: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["s"], r["p"])):
            found.setdefault(r["s"], []).append(r)
        for rank, stretch in list(open_.items()):
            if stretch[0] == stretch[1]:
                continue
            before = stretch[2]
            for r in found[todo.index(stretch)]:
                if rank < before + r["n"]:
                    open_[rank] = (r["a"], r["b"], before)
                    break
                before += r["n"]
    return {rank: a for rank, (a, _b, _before) in open_.items()}


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, without a buffer that grows with the table."""
    n = df.filter(F.col(value).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    at = order_statistics(df, value, sorted({r for p in places for r in (math.floor(p), math.ceil(p))}))
    return [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places]


def describe_stats(prices: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row of summary statistics; ``approximate`` takes mergeable sketches for the quartiles, else a few jobs select them."""
    price = F.col("price_eur_mwh")
    if approximate:
        quarts = [F.percentile_approx(price, F.lit(q)) for q in (0.25, 0.5, 0.75)]
    else:
        values = written(prices.select(price), "prices")
        quarts = [F.lit(q).cast("double") for q in exact_quantiles(values, "price_eur_mwh", [0.25, 0.5, 0.75])]
    negative = F.when(F.col("is_negative"), price)
    return prices.agg(
        F.count(price).alias("n"),
        F.avg(price).alias("mean"),
        F.stddev_samp(price).alias("std"),
        F.min(price).alias("min"),
        *[q.alias(name) for q, name in zip(quarts, ("p25", "p50", "p75"), strict=True)],
        F.max(price).alias("max"),
        F.count_if("is_negative").alias("negative_hours"),
        F.avg(F.col("is_negative").cast("int")).alias("negative_share"),
        F.avg(negative).alias("mean_negative"),
        F.min(negative).alias("min_negative"),
    )


def _range(df: DataFrame, value: str) -> tuple[Column, Column]:
    """Smallest and largest value as scalar subqueries: no join, no trip through the driver."""
    return df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()


def price_histogram(prices: DataFrame, *, bins: int = 79, pad: float = 5.0) -> DataFrame:
    """Equal-width counts of negative and other prices; the top edge belongs to the last bin."""
    low, high = _range(prices, "price_eur_mwh")
    ranged = prices.select("price_eur_mwh", "is_negative", (low - pad).alias("_lo"), (high + pad).alias("_hi"))
    bucket = F.least(F.width_bucket("price_eur_mwh", "_lo", "_hi", F.lit(bins)), F.lit(bins))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return ranged.groupBy(bucket.alias("bin"), "_lo", "_hi").agg(
        F.count_if(~F.col("is_negative")).alias("n_positive"),
        F.count_if("is_negative").alias("n_negative"),
    ).select(
        "bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_from"), "n_positive", "n_negative"
    )


def renewable_bins(df: DataFrame, *, bins: int = 10, share: str = "renewable_pct") -> DataFrame:
    """Equal-width, right-closed bins of the renewable share with the negative-price rate of each."""
    low, high = _range(df, share)
    ranged = df.filter(F.col(share).isNotNull()).select(
        share, "is_negative", low.alias("_lo"), high.alias("_hi")
    )
    # Mirror the axis: width_bucket is left-closed, and -x turns that into right-closed.
    bucket = F.lit(bins + 1) - F.least(
        F.width_bucket(-F.col(share), -F.col("_hi"), -F.col("_lo"), F.lit(bins)), F.lit(bins)
    )
    neg = F.col("is_negative").cast("int")
    return ranged.groupBy(bucket.cast("int").alias("bin")).agg(
        F.avg(neg).alias("neg_rate"), F.sum(neg).alias("neg_hours"), F.count(neg).alias("total_hours"),
        F.round(F.avg(neg) * 100, 2).alias("neg_rate_pct"),
    )


def _two_sided_t(t: float, dof: float) -> float:
    """P(|T| > t) from the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a, b, x):
        tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1.0 - x) / b


def point_biserial(df: DataFrame, *, x: str = "renewable_pct", flag: str = "is_negative") -> DataFrame:
    """Correlation of a number with a flag, its p-value and a label, as one row.

    The correlation is an aggregate; only its single result row goes through
    Python for the tail of the t distribution.
    """
    stats = df.filter(F.col(x).isNotNull() & F.col(flag).isNotNull()).agg(
        F.corr(F.col(x), F.col(flag).cast("int").cast("double")).alias("corr"), F.count(F.lit(1)).alias("n")
    )

    @F.udf(T.DoubleType())
    def p_value(r, n):
        if r is None or n < 3:
            return None
        if abs(r) >= 1.0:
            return 0.0
        return _two_sided_t(abs(r) * math.sqrt((n - 2) / (1.0 - r * r)), n - 2.0)

    label = F.when(F.abs("corr") > 0.3, F.lit("Strong")).otherwise(F.lit("Moderate"))
    return stats.select("corr", "n", p_value("corr", "n").alias("p_value"), label.alias("strength"))


def sample_n(df: DataFrame, *, key: list[str], n: int = 2000, seed: int = 1) -> DataFrame:
    """A repeatable random sample: the ``n`` rows with the smallest seeded hash of their key."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_order", order).orderBy("_order", *key).limit(n).drop("_order")

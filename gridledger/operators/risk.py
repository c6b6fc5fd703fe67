"""Deterministic scoring of clauses against the market, and exposure tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import market as M
from ..functions import text as X


def clause_market_cross(clauses: DataFrame, stats: DataFrame, *, on: list[str] = ("market",)) -> DataFrame:
    """Clauses with the market state they are scored against.

    With several markets this is an equality join on the market; with ``on=[]``
    the statistics are the one row of a single market and enter as a scalar.  A
    market without negative hours has no row and counts as calm.
    """
    facts = ["negative_hours_90d", "avg_negative_price", "has_congestion"]
    if on:
        joined = clauses.join(stats.select(*on, *facts), list(on), "left")
    else:
        joined = clauses.withColumn("_state", stats.select(F.struct(*facts)).scalar()).select("*", "_state.*").drop("_state")
    return joined.withColumns({
        "negative_hours_90d": F.coalesce("negative_hours_90d", F.lit(0).cast("bigint")),
        "avg_negative_price": F.coalesce("avg_negative_price", F.lit(0.0)),
        "has_congestion": F.coalesce("has_congestion", F.lit(False)),
    })


def has_congestion(signals: DataFrame, *, by: list[str] = ("market",)) -> DataFrame:
    """Whether oversupply shows among the given signals, the stand-in for congestion in scoring."""
    return signals.groupBy(*by).agg(F.bool_or(F.col("signal_type") == "oversupply").alias("has_congestion"))


def _assessment(category: Column, text: Column, hours: Column, avg: Column, congestion: Column) -> Column:
    """Severity, sentence and exposure of one clause as a struct."""
    def result(severity: str, sentence: Column | str, exposure: Column | None = None) -> Column:
        said = F.lit(sentence) if isinstance(sentence, str) else sentence
        return F.struct(
            F.lit(severity).alias("severity"), said.alias("description"),
            (F.lit(None).cast("double") if exposure is None else exposure).alias("exposure_eur"),
        )

    negative, floor, unpaid = hours > 0, X.has_floor(text), X.no_compensation(text)
    price_high = F.format_string(V.PRICE_HIGH, hours, M.fixed_point(avg, 1))
    review = F.format_string(V.REVIEW_LOW, X.title_case_category(category))
    price, cut = category == "price_risk", category == "curtailment_risk"
    return (
        F.when(price & negative & ~floor, result("HIGH", price_high, M.calc_exposure(hours, avg)))
        .when(price & negative, result("LOW", F.format_string(V.PRICE_LOW, hours)))
        .when(price & ~floor, result("MEDIUM", V.PRICE_MEDIUM))
        .when(price, result("INFO", V.PRICE_INFO))
        .when(cut & unpaid & congestion, result("HIGH", V.CURTAILMENT_HIGH, M.curtailment_exposure(hours, avg)))
        .when(cut & unpaid, result("MEDIUM", V.CURTAILMENT_MEDIUM))
        .when(cut, result("LOW", V.CURTAILMENT_LOW))
        .when(category == "volume_risk", result("MEDIUM", V.VOLUME_MEDIUM))
        .when(category == "counterparty_risk", result("MEDIUM", V.COUNTERPARTY_MEDIUM))
        .when(category.isin("basis_risk", "legal_regulatory"), result("LOW", review))
        .otherwise(result("INFO", V.OTHER_INFO))
    )


def score_clauses(clauses: DataFrame) -> DataFrame:
    """Add flag id, severity, sentence and exposure; clauses without category or worth only INFO drop out."""
    scored = clauses.filter(F.col("risk_category").isNotNull() & (F.col("risk_category") != "")).withColumn(
        "_a",
        _assessment(F.col("risk_category"), F.col("chunk_text"), F.col("negative_hours_90d"),
                    F.col("avg_negative_price"), F.col("has_congestion")),
    )
    return scored.filter(F.col("_a.severity") != "INFO").select(
        *clauses.columns,
        X.flag_id(F.col("contract_id"), F.col("clause_id"), F.col("risk_category")).alias("flag_id"),
        F.col("_a.severity").alias("severity"),
        F.col("_a.description").alias("description"),
        F.col("_a.exposure_eur").alias("exposure_eur"),
    )


FLAG_COLUMNS = ["flag_id", "contract_id", "clause_id", "risk_category", "severity", "description", "exposure_eur"]


def flag_keep_first(scored: DataFrame, *, session: str = "query_id", rank: str = "rerank_rank") -> DataFrame:
    """The first flag, in rerank order, per session, contract and category.

    A minimum over a struct combines before the shuffle, so it does not matter
    how many flags one contract has.
    """
    rest = [c for c in [*FLAG_COLUMNS] if c not in ("contract_id", "risk_category")]
    first = F.min(F.struct(rank, *rest)).alias("_first")
    return scored.groupBy(session, "contract_id", "risk_category").agg(first).select(
        session, F.col(f"_first.{rank}").alias(rank),
        *[F.col(c) if c in ("contract_id", "risk_category") else F.col(f"_first.{c}").alias(c) for c in FLAG_COLUMNS],
    )


def flags_by_severity(flags: DataFrame, *, session: str = "query_id", rank: str = "rerank_rank") -> DataFrame:
    """Number the flags of a session, worst severity first, rerank order within it."""
    w = Window.partitionBy(session).orderBy(M.severity_rank(F.col("severity")), rank, "flag_id")
    return flags.withColumn("flag_order", F.row_number().over(w))


def risk_flags(clauses: DataFrame, *, session: str = "query_id", rank: str = "rerank_rank") -> DataFrame:
    """Scored, deduplicated, ordered flags of every session."""
    return flags_by_severity(flag_keep_first(score_clauses(clauses), session=session, rank=rank),
                             session=session, rank=rank)


def exposure_total(flags: DataFrame, *, by: list[str]) -> DataFrame:
    """Total exposure per group; NULL unless positive."""
    total = F.sum("exposure_eur")
    return flags.groupBy(*by).agg(F.when(total > 0, total).alias("total_exposure_eur"))


def portfolio_sweep(flags: DataFrame) -> DataFrame:
    """Exposure per contract and risk category with contract subtotals and the grand total."""
    return flags.rollup("contract_id", "risk_category").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_flags"),
        F.coalesce(F.sum("exposure_eur"), F.lit(0.0)).alias("exposure_eur"),
    )


def ppa_risk_profile(flags: DataFrame) -> DataFrame:
    """One row per contract, one score column per risk category (3 HIGH, 2 MEDIUM, 1 LOW, 0 none)."""
    score = F.greatest(F.lit(0), F.lit(3) - M.severity_rank(F.col("severity")))
    return flags.groupBy("contract_id").agg(*[
        F.coalesce(F.max(F.when(F.col("risk_category") == c, score)), F.lit(0)).alias(c) for c in V.RISK_TAXONOMY
    ])


# --- exposure ------------------------------------------------------------------------

EXPOSURE_RULES = {
    "non_positive_price": "avg_neg_price <= 0",
    "positive_capacity": "contracted_mw > 0",
}


def calc_exposure_full(df: DataFrame, *, floor: str | None = "floor_price",
                       window_days: str | int = V.EXPOSURE_WINDOW_DAYS) -> DataFrame:
    """Exposure over the window and per year, with the floor applied where a contract has one.

    Needs ``neg_hours``, ``avg_neg_price`` and ``contracted_mw``; rows that break
    EXPOSURE_RULES are for the caller to quarantine first.
    """
    avg = F.col("avg_neg_price")
    limit = F.col(floor) if floor else F.lit(None).cast("double")
    effective = F.greatest(avg, limit)
    days = F.col(window_days) if isinstance(window_days, str) else F.lit(window_days)
    factor = F.lit(float(V.DAYS_PER_YEAR)) / days
    in_window = F.abs(effective) * F.col("neg_hours") * F.col("contracted_mw")
    kept = [c for c in df.columns if c not in (floor, window_days)]
    return df.select(
        *kept,
        limit.alias("floor_price"),
        effective.alias("effective_price"),
        F.coalesce(limit > avg, F.lit(False)).alias("floor_protection"),
        days.alias("window_days"),
        F.bround(in_window, 2).alias("exposure_window"),
        F.bround(factor, 4).alias("annualisation"),
        F.bround(in_window * factor, 2).alias("exposure_annual"),
    )


def annualisation_sweep(df: DataFrame, *, windows=(30, 60, 90, 120, 180, 365)) -> DataFrame:
    """The exposure of each row under several window lengths."""
    days = F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_days")
    return calc_exposure_full(df.select("*", days), window_days="window_days")


def contract_comparison(df: DataFrame, *, floor: str = "floor_price") -> DataFrame:
    """Each contract with its own floor next to the same contract without one."""
    cases = F.explode(F.array(F.lit("as_signed"), F.lit("no_floor"))).alias("scenario")
    both = df.select("*", cases).withColumn(floor, F.when(F.col("scenario") == "as_signed", F.col(floor)))
    return calc_exposure_full(both, floor=floor)


SWEEP_HOURS = (50, 100, 168, 250, 336, 500, 672)
SWEEP_PRICES = (-5.0, -10.0, -20.0, -28.7, -40.0, -60.0, -80.0)


def sensitivity_cross(contracts: DataFrame, *, hours=SWEEP_HOURS, prices=SWEEP_PRICES) -> DataFrame:
    """Every contract's annual exposure over a grid of negative hours and mean prices.

    The grid is a constant of 49 cells, exploded in place.
    """
    grid = contracts.withColumn("neg_hours", F.explode(F.array(*[F.lit(h) for h in hours]))).withColumn(
        "avg_neg_price", F.explode(F.array(*[F.lit(float(p)) for p in prices]))
    )
    return calc_exposure_full(grid).select("contract_id", "neg_hours", "avg_neg_price", "exposure_annual")


def sensitivity_pivot(grid: DataFrame, *, prices=SWEEP_PRICES) -> DataFrame:
    """The grid with one column per mean price; the columns are known, so no extra job."""
    cells = [
        F.max(F.when(F.col("avg_neg_price") == F.lit(float(p)), F.col("exposure_annual"))).alias(
            f"at_{abs(p):g}".replace(".", "_")
        )
        for p in prices
    ]
    return grid.groupBy("contract_id", "neg_hours").agg(*cells)

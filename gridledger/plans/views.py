"""The given tables seen as the domain's tables.

``events`` stands for the feeds (event type = market), ``supplier`` for the
contracts, ``documents`` for the contract texts, ``benchmark`` for the
questions, ``conversations`` for evaluation samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import schemas as S
from ..operators import gold, rerank, risk, search, sections, silver, token_index
from ..session import written

# Events of each type run on this fuel; the share of renewables then crosses
# the oversupply threshold in some hours.
EVENT_FUEL = {"error": "B19", "view": "B18", "click": "B16", "signup": "B03", "purchase": "B04"}
MARKETS = ["click", "error", "purchase", "signup", "view"]
POINTS = ["Zeeland", "Noord-Holland", "Stedin-Zeeland", "Rotterdam", "Friesland", "Oost", "TenneT-380kV"]
AS_OF = "2024-01-15 12:00:00"
# Sentences that make contract text out of the given prose, one per line of a document.
CLAUSE_SENTENCES = [
    "",
    "No price floor applies in any negative price hour.",
    "The price floor shall apply automatically.",
    "No compensation is payable for curtailment ordered by the grid operator.",
    "Deemed output is paid for redispatch.",
    "",
    "The annual quantity is subject to take-or-pay.",
    "Title passes at the delivery point.",
    "Collateral or a letter of credit is due on a termination event.",
    "",
    "Force majeure and change in law are borne by the Seller.",
    "The fixed price is quoted in EUR/MWh.",
    "A security deposit and a performance bond are lodged.",
    "The market sets the hub price.",
    "Curtailments and permits are logged.",
    "",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(rows: DataFrame, *, latest: bool = False) -> DataFrame:
    """Hourly price per market: the first (or latest) event value of the hour, scaled to EUR/MWh."""
    pick = F.max_by if latest else F.min_by
    # Time and id as one number: with it the aggregate hashes; with a struct it would sort all events.
    order = F.unix_micros("ts").cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("event_id")
    value = pick("value", order)
    ts = F.date_trunc("hour", "ts")
    return rows.groupBy(F.col("event_type").alias("market"), ts.alias("delivery_ts")).agg(
        F.round(3 * value - 120, 2).alias("price_eur_mwh")
    ).select(
        "market", "delivery_ts", F.to_date("delivery_ts").alias("delivery_date"),
        F.hour("delivery_ts").alias("hour"), "price_eur_mwh", (F.col("price_eur_mwh") < 0).alias("is_negative"),
    )


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(events(spark, sf))


def fuel_rows(spark: SparkSession, sf: str) -> DataFrame:
    code = F.create_map(*[F.lit(x) for kv in EVENT_FUEL.items() for x in kv])
    return events(spark, sf).select(
        F.date_trunc("hour", "ts").alias("delivery_ts"), F.element_at(code, F.col("event_type")).alias("psr_type"),
        F.col("value").alias("value_mw"),
    )


def fuels(spark: SparkSession, sf: str) -> DataFrame:
    wide = silver.fuel_pivot(fuel_rows(spark, sf))
    # Two decimals come in, two go out: the order of the additions leaves no trace.
    return wide.select("delivery_ts", *[F.round(c, 2).alias(c) for c in V.FUEL_CODES.values()])


def generation(spark: SparkSession, sf: str) -> DataFrame:
    out = silver.generation_features(fuels(spark, sf))
    return out.withColumns({
        "total_renewable_mw": F.round("total_renewable_mw", 2), "total_mw": F.round("total_mw", 2),
        "renewable_pct": F.round("renewable_pct", 6),
    })


def congestion(spark: SparkSession, sf: str) -> DataFrame:
    zones = F.array(*[F.lit(z) for z in V.DSO_ZONES])
    start = F.date_trunc("second", "ts")
    length = F.make_dt_interval(hours=(F.col("user_id") % 8 + 1).cast("int"))
    return events(spark, sf).filter(F.col("event_type") == "error").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.element_at(zones, (F.col("user_id") % 12 + 1).cast("int")).alias("dso_zone"),
        F.when(F.col("user_id") % 2 == 0, F.lit("upward")).otherwise(F.lit("downward")).alias("direction"),
        start.alias("start_time"), (start + length).alias("end_time"),
        F.col("value").alias("mw_needed"), (F.col("value") * 0.5).alias("price_eur_mwh"),
        F.lit("active").alias("status"),
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return gold.market_risk_signals(prices(spark, sf), generation(spark, sf))


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    names = F.array(*[F.lit(m) for m in MARKETS])
    points = F.array(*[F.lit(p) for p in POINTS])
    kinds = F.array(F.lit("physical"), F.lit("virtual"), F.lit("sleeved"))
    kind = F.element_at(kinds, (key % 3 + 1).cast("int"))
    granted = key % 4 != 0
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("contract_id"),
        F.element_at(names, (key % 5 + 1).cast("int")).alias("market"),
        kind.alias("ppa_type"),
        F.round(60 + F.col("s_acctbal") / 1000, 2).alias("strike_price_eur"),
        (F.col("s_nationkey") + 5).cast("double").alias("volume_mw"),
        F.when(granted, F.when(kind == "physical", F.lit(V.PHYSICAL_FLOOR)).otherwise(F.lit(V.FINANCIAL_FLOOR)))
        .alias("floor_price"),
        F.element_at(points, (key % 7 + 1).cast("int")).alias("delivery_point"),
        F.concat(F.lit("party-"), F.col("s_nationkey").cast("string")).alias("counterparty"),
        (key % 2 == 0).alias("curtailment_compensation"),
        F.lit(0.8).alias("take_or_pay_pct"),
        (key % 10 + 5).cast("int").alias("tenor_years"),
    )


def contract_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as contract texts: line i gets a heading number or a clause sentence by its place."""
    said = F.array(*[F.lit(s) for s in CLAUSE_SENTENCES])

    def block(line, i):
        number = i.cast("string")
        head = (
            F.when(i % 6 == 1, F.concat(F.lit("ARTICLE "), number, F.lit(" — ")))
            .when(i % 6 == 3, F.concat(number, F.lit("."), (i % 4).cast("string"), F.lit(" ")))
            .when(i % 6 == 5, F.lit("(iv) "))
            .otherwise(F.lit(""))
        )
        sentence = F.element_at(said, ((F.col("doc_id") + i) % len(CLAUSE_SENTENCES) + 1).cast("int"))
        return F.struct((F.floor(i / 40) + 1).cast("int").alias("page"),
                        F.concat(head, line, F.lit(" "), sentence).alias("text"))

    # The given table is one file with one row group.  Whatever its size it is dealt out once
    # here, as a document table written for many tasks would be; operators do not shuffle text.
    return table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("contract_id"),
        F.transform(F.split("text", "\n"), block).alias("blocks"),
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return contract_documents(spark, sf).select("contract_id", F.posexplode("blocks").alias("block_no", "_b")).select(
        "contract_id", F.col("_b.page").alias("page"), "block_no", F.col("_b.text").alias("text")
    )


def untagged_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return sections.chunk_words(sections.split_sections(contract_documents(spark, sf)))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks with their categories, written once for those who read them more than once."""
    return written(sections.tag_batch(untagged_chunks(spark, sf)), "tagged-chunks")


def chunk_index(spark: SparkSession, sf: str) -> token_index.TokenIndex:
    """The chunks as a table that is searched by words: a search reads them once."""
    return token_index.index_of(untagged_chunks(spark, sf), key="chunk_id", text="chunk_text", columns=S.HIT_COLUMNS, joined=True)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One session per benchmark text, each looking at one market."""
    names = F.array(*[F.lit(m) for m in MARKETS])
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.element_at(names, (F.col("item_id") % 5 + 1).cast("int")).alias("market"),
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """The 15 best chunks per question, with the question's text and market.

    Without a filter on the category only the hits need one, so they are tagged
    after the search.  Both are written: the optimizer would look at the tag expressions anew after each
    stage of the search and of what follows.
    """
    asked = questions(spark, sf)
    found = search.token_overlap_search(asked, chunk_index(spark, sf), k=V.RETRIEVE_TOP_K)
    return written(sections.tag_batch(written(found, "found")).join(asked, "query_id"), "hits")


def clauses(spark: SparkSession, sf: str) -> DataFrame:
    """The clauses of every session after reranking."""
    return rerank.rerank(hits(spark, sf), n=V.RERANK_TOP_N)


def top_signals(spark: SparkSession, sf: str) -> DataFrame:
    return gold.signals_top_per_market(signals(spark, sf))


def market_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Negative-hour statistics and the congestion mark per market."""
    seen = written(signals(spark, sf), "signals")  # two statistics, one scan of the feeds
    stats = gold.negative_stats(seen, by=["market"])
    marks = risk.has_congestion(gold.signals_top_per_market(seen))
    return marks.join(stats, "market", "left")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return risk.score_clauses(risk.clause_market_cross(clauses(spark, sf), market_stats(spark, sf)))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return risk.flags_by_severity(risk.flag_keep_first(scored(spark, sf)))

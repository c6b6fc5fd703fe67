"""Contexts, prompts, narratives and reports, one row per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import market as M
from .gold import worst_k_signals

_FLAGS = (
    "array<struct<flag_id:string,contract_id:string,clause_id:string,risk_category:string,"
    "severity:string,description:string,exposure_eur:double>>"
)


def _ordered(order: str, *cols: str) -> Column:
    """The rows of a group as a list of structs in the given order (lists of bounded length only)."""
    return F.sort_array(F.collect_list(F.struct(order, *cols)))


def _lines(items: Column, line) -> Column:
    return F.transform(items, line)


def market_context(signals: DataFrame, stats: DataFrame, rollup: DataFrame) -> DataFrame:
    """Markdown summary per market from its top signals, negative-hour statistics and daily roll-up.

    Markets without negative hours read "n/a" for the prices.
    """
    worst = worst_k_signals(signals, k=3)
    line = F.format_string(
        "  • %s H%02d: %s €/MWh (%s)", F.col("delivery_date").cast("string"), "hour",
        M.fixed_point(F.col("price_eur_mwh"), 1), "severity",
    )
    lines = worst.withColumn("_line", line).groupBy("market").agg(
        F.array_join(_lines(_ordered("worst_rank", "_line"), lambda r: r["_line"]), "\n").alias("_worst")
    )
    overlap = signals.groupBy("market").agg(
        F.count_if(F.col("renewable_pct") > V.OVERSUPPLY_SHARE).alias("_overlap")
    )
    facts = overlap.join(lines, "market", "left").join(stats, "market", "left").join(rollup, "market", "left")

    def number(name: str) -> Column:
        return F.coalesce(M.fixed_point(F.col(name), 1), F.lit("n/a"))

    zero = F.lit(0).cast("bigint")
    text = F.concat_ws(
        "\n",
        F.format_string(V.MARKET_HEADING, "market"),
        F.lit(""),
        F.format_string("- **Negative price hours**: %d hrs across %d days",
                        F.coalesce("negative_hours_90d", zero), F.coalesce("negative_days", zero)),
        F.format_string("- **Average negative price**: %s €/MWh", number("avg_negative_price")),
        F.format_string("- **Worst recorded price**: %s €/MWh", number("min_price")),
        F.format_string("- **High-renewable overlap**: %d negative hours had >70%% renewable share", "_overlap"),
        F.lit(""),
        F.lit("**Worst hours (sample):**"),
        F.coalesce("_worst", F.lit("  (none in current window)")),
        F.lit(""),
        F.lit(V.MARKET_FOOTER),
        F.lit(""),
    )
    return facts.select("market", text.alias("market_context"))


def format_context(clauses: DataFrame, *, session: str = "query_id") -> DataFrame:
    """Numbered clause block per session: heading line, then the first 400 characters."""
    tag = F.when(F.coalesce("risk_category", F.lit("")) != "", F.concat(F.lit(" ["), F.col("risk_category"), F.lit("]")))
    body = F.concat(
        F.substring("chunk_text", 1, V.CONTEXT_CHARS),
        F.when(F.length("chunk_text") > V.CONTEXT_CHARS, F.lit("...")).otherwise(F.lit("")),
    )
    entry = F.format_string(
        "**[%d] %s — %s %s%s** (score: %s)\n> %s\n", "rerank_rank", "contract_id", "clause_id", "section_title",
        F.coalesce(tag, F.lit("")), M.fixed_point(F.col("rerank_score"), 2), body,
    )
    listed = _lines(_ordered("rerank_rank", "_entry"), lambda r: r["_entry"])
    return clauses.withColumn("_entry", entry).groupBy(session).agg(
        F.array_join(F.concat(F.array(F.lit(V.CONTEXT_HEADING)), listed), "\n").alias("rag_context")
    )


def _shown(amount: Column) -> Column:
    """An amount worth showing: neither missing nor zero."""
    return F.when(amount != 0, M.whole_euros(amount))


def format_flags(flags: DataFrame, *, session: str = "query_id") -> DataFrame:
    """One line per flag, in severity order."""
    exposure = F.concat(F.lit(" | Estimated exposure: EUR "), _shown(F.col("exposure_eur")), F.lit("/year"))
    line = F.format_string(
        "[%s] %s - %s (%s)%s\n  %s", "severity", "contract_id", "clause_id", "risk_category",
        F.coalesce(exposure, F.lit("")), "description",
    )
    return flags.withColumn("_line", line).groupBy(session).agg(
        F.array_join(_lines(_ordered("flag_order", "_line"), lambda r: r["_line"]), "\n").alias("risk_flags_text")
    )


def build_prompt(sessions: DataFrame, contexts: DataFrame, flags_text: DataFrame, *,
                 session: str = "query_id") -> DataFrame:
    """One prompt per session for an external model: question, market, clauses and flags."""
    filled = sessions.join(contexts, session, "left").join(flags_text, session, "left")
    clauses = F.substring(F.coalesce("rag_context", F.lit(V.NO_CLAUSES)), 1, V.PROMPT_CONTEXT_CHARS)
    prompt = F.concat_ws(
        "\n\n",
        F.lit("Write a short risk narrative for an energy trader: two or three plain paragraphs, no lists."),
        F.concat(F.lit("## User Query\n"), F.col("query")),
        F.coalesce("market_context", F.lit("")),
        clauses,
        F.concat(F.lit("## Risk Flags Identified\n"), F.coalesce("risk_flags_text", F.lit(V.NO_FLAGS))),
        F.lit("Name the clauses, give exposure in EUR where it is known, close with one recommended "
              "action, and add nothing that is not stated above."),
    )
    return filled.select(session, prompt.alias("prompt"))


def template_narrative(sessions: DataFrame, flags: DataFrame, *, session: str = "query_id") -> DataFrame:
    """The fixed-form paragraph per session; sessions without flags get the all-clear sentence."""
    high, medium = F.col("severity") == "HIGH", F.col("severity") == "MEDIUM"
    said = F.format_string(V.NARRATIVE_CLAUSE, "contract_id", "clause_id", "description")
    facts = flags.withColumn("_said", said).groupBy(session).agg(
        F.count_if(high).alias("_high"),
        F.count_distinct(F.when(high, F.col("contract_id"))).alias("_contracts"),
        F.sum(F.when(high, F.col("exposure_eur"))).alias("_sum"),
        F.count_if(medium).alias("_medium"),
        F.sort_array(F.collect_list(F.when(high, F.struct("flag_order", "_said")))).alias("_said"),
    )
    exposure = F.when(
        F.col("_sum") != 0, F.format_string(V.NARRATIVE_EXPOSURE, M.whole_euros(F.col("_sum")))
    ).otherwise(F.lit(""))
    first_two = F.array_join(_lines(F.slice("_said", 1, 2), lambda r: r["_said"]), " ")
    parts = F.concat_ws(
        " ",
        F.when(F.col("_high") > 0, F.format_string(V.NARRATIVE_HIGH, "_high", "_contracts", exposure, first_two)),
        F.when(F.col("_medium") > 0, F.format_string(V.NARRATIVE_MEDIUM, "_medium")),
        F.lit(V.NARRATIVE_ACTION),
    )
    joined = sessions.select(session).join(facts, session, "left")
    return joined.select(
        session, F.when(F.col("_high").isNull(), F.lit(V.NARRATIVE_EMPTY)).otherwise(parts).alias("narrative")
    )


def unique_contracts(clauses: DataFrame, *, session: str = "query_id") -> DataFrame:
    """Contract ids of a session's clauses, first appearance first."""
    named = clauses.filter(F.coalesce("contract_id", F.lit("")) != "")
    return named.groupBy(session).agg(
        F.array_distinct(_lines(_ordered("rerank_rank", "contract_id"), lambda r: r["contract_id"])).alias("contract_ids")
    )


def build_report(sessions: DataFrame, clauses: DataFrame, flags: DataFrame, *,
                 session: str = "query_id") -> DataFrame:
    """Assemble the report of every session from its clauses and flags.

    Sessions carry query, created_at and the market facts.  Where the market
    facts are missing the report is the reduced one: hours 0, no price.  A
    session has at most a handful of clauses, so its lists are short.
    """
    sources = clauses.groupBy(session).agg(
        _lines(_ordered("rerank_rank", "chunk_id"), lambda r: r["chunk_id"]).alias("sources")
    )
    flag_fields = ["flag_id", "contract_id", "clause_id", "risk_category", "severity", "description", "exposure_eur"]
    total = F.sum("exposure_eur")
    listed = flags.groupBy(session).agg(
        _lines(
            _ordered("flag_order", *flag_fields), lambda r: F.struct(*[r[c].alias(c) for c in flag_fields])
        ).alias("risk_flags"),
        F.when(total > 0, total).alias("total_exposure_eur"),
    )
    empty = F.array().cast("array<string>")
    return (
        sessions.join(unique_contracts(clauses, session=session), session, "left")
        .join(sources, session, "left")
        .join(listed, session, "left")
        .join(template_narrative(sessions, flags, session=session), session, "left")
        .select(
            F.col(session).cast("string").alias("session_id"),
            "query",
            F.coalesce("contract_ids", empty).alias("contract_ids"),
            F.coalesce("risk_flags", F.array().cast(_FLAGS)).alias("risk_flags"),
            "total_exposure_eur",
            F.coalesce("negative_hours_90d", F.lit(0).cast("bigint")).alias("negative_hours_90d"),
            "avg_negative_price",
            F.when(F.col("negative_hours_90d").isNull(), F.lit("minimal")).otherwise(F.lit("full")).alias("report_kind"),
            "narrative",
            F.coalesce("sources", empty).alias("sources"),
            "created_at",
        )
    )


def report_summary(reports: DataFrame) -> DataFrame:
    """Flag count, worst severity and totals per report."""
    worst = F.array_min(F.transform(
        "risk_flags", lambda f: F.struct(M.severity_rank(f["severity"]).alias("r"), f["severity"].alias("s"))
    ))
    return reports.select(
        F.col("session_id").alias("report_id"), "query", "contract_ids",
        F.size("risk_flags").alias("risk_flags_count"), worst["s"].alias("highest_severity"),
        "total_exposure_eur", "negative_hours_90d", "created_at",
    )


def list_reports(reports: DataFrame) -> DataFrame:
    """Summaries, most recent first."""
    return report_summary(reports).orderBy(F.desc("created_at"), "report_id")


def get_report(reports: DataFrame, report_id: str | Column) -> DataFrame:
    """The report with this id; no row if there is none."""
    return reports.filter(F.col("session_id") == report_id)


def coerce_flag_shape(flags: DataFrame) -> DataFrame:
    """Flags in the shape of the outgoing interface."""
    return flags.select(
        F.coalesce("risk_category", F.lit("unknown")).alias("risk_category"),
        F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
        F.col("exposure_eur").alias("financial_exposure_eur"),
        F.col("clause_id").alias("contract_clause"),
        F.col("description").alias("market_trigger"),
        F.lit(None).cast("string").alias("recommendation"),
    )


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def render_html(reports: DataFrame) -> DataFrame:
    """Report to an HTML page; all text is escaped."""
    def colour(severity: Column) -> Column:
        out = F.lit(V.OTHER_COLOUR)
        for name, value in V.SEVERITY_COLOURS.items():
            out = F.when(severity == name, F.lit(value)).otherwise(out)
        return out

    def euros(amount: Column) -> Column:
        return F.coalesce(F.concat(F.lit("€"), _shown(amount)), F.lit("—"))

    def row(f: Column) -> Column:
        cells = [escape_html(f[c]) for c in ("contract_id", "clause_id", "risk_category")]
        return F.concat(
            F.lit("<tr><td style='color:"), colour(f["severity"]), F.lit("'>"), escape_html(f["severity"]),
            *[F.concat(F.lit("</td><td>"), c) for c in cells],
            F.lit("</td><td>"), euros(f["exposure_eur"]),
            F.lit("</td><td>"), escape_html(f["description"]), F.lit("</td></tr>"),
        )

    none = "<tr><td colspan='6'>" + V.NO_FLAGS + "</td></tr>"
    rows = F.when(F.size("risk_flags") == 0, F.lit(none)).otherwise(
        F.array_join(F.transform("risk_flags", row), "")
    )
    sources = F.when(F.size("sources") == 0, F.lit("—")).otherwise(escape_html(F.array_join("sources", ", ")))
    head = F.concat(F.lit("<html><head><meta charset='utf-8'><title>PPA Risk Report "),
                    escape_html(F.col("session_id")), F.lit("</title></head><body><h1>PPA Risk Report</h1>"))
    facts = F.concat(
        F.lit("<p>Query: "), escape_html(F.col("query")),
        F.lit("<br>Contracts: "), escape_html(F.array_join("contract_ids", ", ")),
        F.lit("<br>Total EUR exposure: "), euros(F.col("total_exposure_eur")),
        F.lit("<br>Negative price hours (90d): "), F.col("negative_hours_90d").cast("string"), F.lit("</p>"),
    )
    table = F.concat(
        F.lit("<table><tr><th>Severity</th><th>Contract</th><th>Clause</th><th>Category</th>"
              "<th>Exposure</th><th>Description</th></tr>"),
        rows, F.lit("</table>"),
    )
    story = F.concat(F.lit("<p>"), F.replace(escape_html(F.col("narrative")), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))
    page = F.concat(head, facts, table, story, F.lit("<p>Sources: "), sources, F.lit("</p></body></html>"))
    return reports.select("session_id", page.alias("html"))

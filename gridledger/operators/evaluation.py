"""Retrieval metrics, token-overlap answer metrics and the pass/fail gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X


def eval_expected_join(questions: DataFrame, hits: DataFrame, *, query_id: str = "query_id") -> DataFrame:
    """First rank at which a question's expected ids (any of them) were retrieved; NULL on a miss.

    Expected ids are exploded and matched by equality, so neither the hit list
    nor the list of expected ids is scanned pairwise.
    """
    wanted = questions.select(query_id, F.explode("expected_ids").alias("item_id"))
    found = hits.select(query_id, F.col("item_id"), "rank").join(wanted, [query_id, "item_id"]).groupBy(query_id).agg(
        F.min("rank").alias("first_rank")
    )
    return questions.select(query_id, "category").join(found, query_id, "left")


def _hit(k: int):
    return F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int")


def retrieval_metrics(results: DataFrame, *, ks=(1, 2, 3, 4, 5), by: str = "category") -> DataFrame:
    """Hit rate at each k (with one target per question this is also precision at k) and MRR.

    One row per category and one overall row, from one pass.
    """
    metrics = [F.count(F.lit(1)).alias("n_questions")]
    metrics += [F.avg(_hit(k)).alias(f"hit{k}") for k in ks]
    metrics += [F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr")]
    grouped = results.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping_id().alias("_all"), *metrics)
    return grouped.select(
        F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col(by).cast("string")).alias(by),
        *[c for c in grouped.columns if c not in (by, "_all")],
    )


def retrieval_failures(results: DataFrame, *, k: int = 3, by: str = "category") -> DataFrame:
    """Questions, misses at ``k`` and miss rate per category, worst first."""
    missed = 1 - _hit(k)
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.sum(missed).alias("failures"), F.avg(missed).alias("fail_rate")
    ).orderBy(F.desc("fail_rate"), by)


def ragas_token_overlap(samples: DataFrame) -> DataFrame:
    """Three overlap scores per sample; blank contexts score one half where contexts are compared.

    Faithfulness divides by the words of the context.
    """
    context = F.array_join("contexts", " ")
    blank = X.strip(context) == ""
    return samples.select(
        "id",
        F.when(blank, F.lit(V.EMPTY_CONTEXT_SCORE))
        .otherwise(X.overlap_share(F.col("answer"), context)).alias("faithfulness"),
        X.overlap_share(F.col("answer"), F.col("ground_truth")).alias("answer_relevancy"),
        F.when(blank, F.lit(V.EMPTY_CONTEXT_SCORE))
        .otherwise(X.overlap_share(context, F.col("question"))).alias("context_precision"),
    )


def retrieved_samples(hits: DataFrame) -> DataFrame:
    """Per question of a hit list: ``id, question, ground_truth`` and its chunks by rank as ``contexts``.

    The question is the ground truth and no part of the contexts, so chunks that do not
    speak of it score low.
    """
    by_rank = F.sort_array(F.collect_list(F.struct("rank", "chunk_text")))
    return hits.groupBy(F.col("query_id").alias("id"), F.col("query").alias("question")).agg(
        F.transform(by_rank, lambda h: h["chunk_text"]).alias("contexts")
    ).withColumn("ground_truth", F.col("question"))


def eval_heuristics(samples: DataFrame) -> DataFrame:
    """Mean of the three scores, rounded half-even to three digits."""
    scores = ragas_token_overlap(samples)
    return scores.agg(*[F.bround(F.avg(m), 3).alias(m) for m in V.EVAL_THRESHOLDS])


def eval_gate(metrics: DataFrame, *, thresholds: dict[str, float] = V.EVAL_THRESHOLDS) -> DataFrame:
    """One PASS/FAIL row per metric."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score"), F.lit(t).alias("threshold"))
        for m, t in thresholds.items()
    ]))
    return metrics.select(rows).withColumn(
        "status", F.when(F.col("score") >= F.col("threshold"), F.lit("PASS")).otherwise(F.lit("FAIL"))
    )


def enforce_gate(gate: DataFrame) -> DataFrame:
    """The same rows, but the job fails on a FAIL row."""
    message = F.format_string("gate failed: %s below threshold", "metric")
    return gate.withColumn(
        "status", F.when(F.col("status") == "FAIL", F.raise_error(message)).otherwise(F.col("status"))
    )


def max_samples(items: DataFrame, n: int, *, order: str = "id") -> DataFrame:
    """The first ``n`` evaluation items in file order."""
    return items.orderBy(order).limit(n)


def answer_length_breakdown(samples: DataFrame) -> DataFrame:
    return samples.select(
        "id", F.substring("question", 1, 60).alias("question"),
        F.length("answer").alias("answer_len"), F.length("ground_truth").alias("ground_truth_len"),
    )


def question_answer_pairs(turns: DataFrame, *, block_turns: int = 1024) -> DataFrame:
    """User turns with the assistant turn that follows, from a conversation table.

    The follower is the next row within a block of turns; the last row of a
    block looks into a table with the first row of each block.  However long a
    conversation is, no task holds more than a block of it.
    """
    block = ["conv_id", "_block"]
    rows = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / block_turns).alias("_block"))
    within = Window.partitionBy(*block).orderBy("turn")
    item = F.struct("role", "text")
    rows = rows.withColumn("_next", F.lead(item).over(within))
    firsts = rows.groupBy(*block).agg(F.min(F.struct("turn", "role", "text")).alias("_first"))
    later = Window.partitionBy("conv_id").orderBy("_block")
    firsts = firsts.select(
        *block, F.lead(F.struct("_first.role", "_first.text")).over(later).alias("_after")
    ).filter(F.col("_after").isNotNull())
    joined = rows.join(firsts, block, "left").withColumn("_next", F.coalesce("_next", "_after"))
    return joined.filter((F.col("role") == "user") & (F.col("_next.role") == "assistant")).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"),
        F.col("_next.text").alias("answer"),
    )

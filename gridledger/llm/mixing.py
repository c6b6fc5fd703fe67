"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 42
#: Shuffle blocks per source, and steps of virtual time, for sums in two levels.
BLOCKS, STEPS = 1024, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source (``source, source_size``): number ``sid``, ``target``.

    Weights repeat over the sources by code point, null last.  The targets share
    all words by weight but stop at ``most`` times a source's words; what is over
    goes to the others by weight.  So each target is the smaller of that bound and
    a common rate times the weight; the rate follows from the sources in order of
    bound over weight.  One row per source: the windows see no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    named = sizes.withColumn("sid", number).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("double")
    ).withColumn("bound", F.col("source_size") * most)
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), "sid")
    before, rest = by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0))) / F.sum("weight").over(rest)
    rated = named.withColumn("rate", rate)
    free = F.when(F.col("bound") >= F.col("rate") * F.col("weight"), F.struct(F.col("bound") / F.col("weight"), F.col("sid"), F.col("rate").alias("rate")))
    common = F.min(free).over(every)["rate"]
    return rated.withColumn("common", common).select(
        "source", "source_size", "sid",
        F.coalesce(F.least(F.col("bound").cast("double"), F.col("common") * F.col("weight")), F.col("bound").cast("double")).alias("target"),
    )


def _queued(rows: DataFrame, sources: DataFrame, offsets: DataFrame | None) -> DataFrame:
    """``rows`` (_source, _size, _hash, ...) with their source's numbers and the words queued up to each row.

    The shuffle within a source is the order of a seeded hash.  A source is cut into
    blocks of that hash: words in earlier blocks come from block sums, those in
    the row's own block from a window, so no task orders a whole source.
    """
    known = rows.join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    if offsets is None:
        return known
    near = Window.partitionBy("sid", "_block").orderBy("_hash", "_size", "_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = known.withColumn("_near", F.sum("_size").over(near))
    return summed.join(offsets, ["sid", "_block"]).withColumn("_queued", F.col("_offset") + F.col("_near"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row: Column | None) -> DataFrame:
    columns = [
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("_size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_hash"),
    ]
    keyed = docs.select(*columns, *([row.alias("_row")] if row is not None else []))
    return keyed.withColumn("_block", F.pmod("_hash", F.lit(BLOCKS)).cast("int"))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int):
    """Source numbers, block offsets, and the cut in virtual time: (finish, sid, queued words) of the last copy taken."""
    totals = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    sources = stored(source_targets(totals, weights, most), "mix-sources")
    blocks = _queued(rows, sources, None).groupBy("sid", "_block").agg(F.sum("_size").alias("_words"))
    before = Window.partitionBy("sid").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        blocks.select("sid", "_block", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset")), "mix-offsets"
    )
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    copies = _copies(_queued(rows, sources, offsets), most)
    step = F.least(F.floor(F.col("_c.finish") * STEPS), F.lit(STEPS)).cast("long")
    steps = sorted((r[0], r[1]) for r in copies.groupBy(step.alias("step")).agg(F.sum("_size").alias("w")).collect())
    below, cut = 0, None
    for at, words in steps:  # STEPS + 1 rows at most
        if below + words >= budget:
            cut = at
            break
        below += words
    if cut is None:
        return sources, offsets, None
    order = Window.orderBy("_c.finish", "sid", "_c.queued").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        copies.filter(step == cut).withColumn("_sum", F.sum("_size").over(order)).filter(F.col("_sum") - F.col("_size") < budget - below)
        .agg(F.max(F.struct("_c.finish", "sid", "_c.queued")).alias("m")).first()["m"]
    )
    return sources, offsets, last


def _copies(queued: DataFrame, most: int) -> DataFrame:
    """One row per copy that starts before its source's target; words before it are whole passes and the queue."""
    passes = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda e: F.struct(
            (F.col("_queued") + e * F.col("source_size")).alias("queued"),
            ((F.col("_queued") + e * F.col("source_size")) / F.col("target")).alias("finish"),
        ),
    )
    started = F.filter(passes, lambda c: c["queued"] - F.col("_size") < F.col("target"))
    return queued.filter("_size > 0 AND target > 0").select("sid", "_size", F.explode(started).alias("_c"))


def _times(most: int, last) -> Column:
    """How often the mix takes a row: its copies that finish no later than the cut."""
    if last is None:
        return F.lit(0)
    finish, sid, queued = last
    total = F.lit(0)
    for e in range(most):
        words = F.col("_queued") + e * F.col("source_size")
        done = words / F.col("target")
        taken = (done < finish) | (done == finish) & ((F.col("sid") < sid) | (F.col("sid") == sid) & (words <= queued))
        total = total + F.when(F.col("target") > 0, taken & (words - F.col("_size") < F.col("target"))).otherwise(False).cast("int")
    return F.when(F.col("_size") > 0, total).otherwise(0)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, *, most: int = MOST, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, taken``.

    Each source queues its documents in a seeded shuffle, up to ``most`` passes.  A
    copy's virtual finish time is the words its source has queued with it, divided
    by the source's target.  All copies in order of finish time are taken until
    the words of all documents are reached; the last may go over.  ``taken`` is a
    document's words times its copies taken.

    Sizes are words; a null or empty text has none and is never taken.  A null source is a
    source of its own, the last one.  Null ids are shuffled as equal ids.  Rows
    that repeat id, text and source are interchangeable.  An empty table gives no
    rows.  The result depends on ids, texts and sources only, not on
    partitions, so reruns agree.  Other columns are not read.
    """
    rows = stored(_keyed(docs, id_col, text_col, source_col, seed, None), "mix-rows")
    sources, offsets, last = _plan(rows, weights, most)
    return _queued(rows, sources, offsets).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * _times(most, last)).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, *, most: int = MOST, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns; see ``mix``."""
    rows = stored(_keyed(docs, id_col, text_col, source_col, seed, None), "mix-rows")
    sources, offsets, last = _plan(rows, weights, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    full = _queued(_keyed(docs, id_col, text_col, source_col, seed, whole), sources, offsets)
    return full.withColumn("_n", _times(most, last)).filter("_n > 0").select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")
    ).select("_row.*")

"""Shards of nearly equal bytes by histogram sort."""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import accumulate
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import content, stored

#: Shards; fewest ranges that a shard is sorted in, and most bytes of one; part of a shard that a border may be off.
SHARDS, RUNS, RUN_BYTES, TOLERANCE = 8, 16, 64 << 30, 0.001
#: Key bits known after each round: the first key's 64, then the second key's.
ROUNDS = [*range(12, 64, 6), 64, *range(70, 128, 6), 128]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, size (UTF-8 bytes and one), CRC-32, and the sort key: hash of the text, hash of the id."""
    text = content(text_col)
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col)).alias("k2"),
    )


def homes(keys: DataFrame, shards: int, target: float, slack: float) -> list[tuple[int, int, int]]:
    """(first key, shard, bytes) of each group of copies above ``slack`` bytes that fits a shard whole.

    Largest first, a group goes to the emptiest shard.  One that would lift it more than ``slack``
    above ``target`` is left out: it can not stay whole among equal shards.  The driver gets
    the groups above ``slack``: at most ``shards * target / slack``, whatever the table holds.
    """
    heavy = keys.groupBy("k1").agg(F.sum("size").alias("b"), F.count("*").alias("n")).filter(F.col("n") > 1).filter(F.col("b") > slack)
    fills, out = [(0, j) for j in range(shards)], []
    for r in sorted(heavy.select("k1", "b").collect(), key=lambda r: (-r.b, r.k1)):
        fill, shard = fills[0]
        if fill + r.b <= target + slack:
            heapq.heapreplace(fills, (fill + r.b, shard))
            out.append((r.k1, shard, r.b))
    return out


def splitters(keys: DataFrame, wants: list[float], slack: float) -> list[tuple[int, int]]:
    """The keys below which ``keys`` hold ``wants`` bytes, each within ``slack`` bytes.

    Every round counts the exact bytes between candidate boundaries, over all
    partitions; of each splitter the one bin that holds it is probed further.
    The driver gets the bins' sums: 4,096 rows in the first round, then at most
    64 for each splitter not yet found, whatever the table holds.

    Copies of a text share the first key and stay on one side of a splitter
    unless they are more than the slack: then probing goes on in the
    second key, so that a group larger than a shard is cut as well.
    """
    found, open_, known = [], {}, 0
    for bits in ROUNDS:
        bins = _histogram(keys, bits, known, open_)
        if known == 0:
            open_ = {0: [(want, 0) for want in wants]} if bins else {}
        inside = defaultdict(list)
        for prefix, size, rows in bins:
            inside[prefix >> (bits - known)].append((prefix, size, rows))
        left = defaultdict(list)
        for parent, wanted in open_.items():
            for want, below in wanted:
                prefix, low, size, rows = _holding(inside[parent], want, below)
                last = rows == 1 or bits == 128 or bits >= 64 and size <= slack
                before, after = want - low, low + size - want
                if last or min(before, after) <= slack:
                    found.append((prefix + (before > after)) << (128 - bits))
                else:
                    left[prefix].append((want, low))
        open_, known = left, bits
        if not open_:
            break
    half, top = 2**63, 2**128 - 1
    return [((min(x, top) >> 64) - half, min(x, top) % 2**64 - half) for x in sorted(found)]


def _holding(bins: list, want: float, below: int) -> tuple[int, int, int, int]:
    """The bin in which ``want`` is reached, with the bytes below it."""
    for prefix, size, rows in bins[:-1]:
        if below + size >= want:
            return prefix, below, size, rows
        below += size
    prefix, size, rows = bins[-1]
    return prefix, below, size, rows


def _histogram(keys: DataFrame, bits: int, known: int, open_: dict) -> list[tuple[int, int, int]]:
    """Bytes and rows by key prefix of ``bits`` bits, within the prefixes of ``known`` bits that are open."""
    def prefix(b: int):
        one = F.shiftright("k1", 64 - min(b, 64))
        return one, F.shiftright("k2", 128 - b) if b > 64 else F.lit(0).cast("long")

    rows = keys
    if known:
        one, two = prefix(known)
        rows = rows.filter(one.isin(sorted({_signed(p, known)[0] for p in open_})))
        if known > 64:
            rows = rows.filter(two.isin(sorted({_signed(p, known)[1] for p in open_})))
    one, two = prefix(bits)
    sums = rows.groupBy(one.alias("p1"), two.alias("p2")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    low, high = min(bits, 64), max(0, bits - 64)
    return sorted(
        (((r.p1 + 2 ** (low - 1)) << high) + (r.p2 + 2 ** (high - 1) if high else 0), r.b, r.n) for r in sums.collect()
    )


def _signed(prefix: int, bits: int) -> tuple[int, int]:
    low, high = min(bits, 64), max(0, bits - 64)
    return (prefix >> high) - 2 ** (low - 1), prefix % 2**high - 2 ** (high - 1) if high else 0


def place(
    docs: DataFrame, shards: int = SHARDS, *, runs: int | None = None, tolerance: float = TOLERANCE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    Shards of nearly equal bytes.  A group of copies above ``tolerance`` of a shard gets a shard as a whole;
    the other rows fill the shards' room as ranges of (hash of the text, hash of the id), whose borders
    are within ``tolerance`` of a shard, or one text.  Only a group that fits no shard is cut: one larger than a
    shard, or more large groups than equal shards can hold.

    Each shard is ``runs`` ranges of equal bytes (RUNS, and more where they would pass RUN_BYTES) and
    its groups' pieces, so no task sorts a whole shard or group; the rows are exchanged once, by range.
    ``slot`` is the place in the shard, from 0 without gaps.  Law ``bytes``; ``grown_shard`` is null.

    A null text has no bytes; a null id is an ordinary key.  Rows that repeat id
    and text are one key: they stay together and share out adjoining slots.  A very long text is a row like any other: only its
    size and hashes are kept.  An empty table gives no rows.  Other columns are not read.
    """
    rows = stored(keyed(docs, id_col, text_col), "shard-keys")
    target = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    runs = runs or max(RUNS, ceil(target / RUN_BYTES))
    slack = tolerance * target
    whole = homes(rows, shards, target, slack)
    settled = F.broadcast(_settled(docs, whole, target / runs, shards * runs))  # at most shards / tolerance rows
    room = [target] * shards
    for _, shard, size in whole:
        room[shard] = max(0.0, room[shard] - size)
    step = [r / runs for r in room for _ in range(runs)]
    wants = list(accumulate(step))[:-1]
    cuts = splitters(rows.join(settled, F.col("k1") == F.col("group"), "left_anti"), wants, slack)
    below = F.size(F.filter("cuts", lambda c: (c["k1"] < F.col("k1")) | (c["k1"] == F.col("k1")) & (c["k2"] <= F.col("k2"))))
    # The second key is a hash: its upper 24 bits deal a group to its pieces.
    piece = F.shiftright((F.shiftright("k2", 40) + F.lit(1 << 23)) * F.col("pieces"), 24)
    dealt = rows.join(F.broadcast(_grid(docs, cuts)), F.shiftright("k1", 52) == F.col("prefix")).join(
        settled, F.col("k1") == F.col("group"), "left"
    ).select(
        "id", "size", "crc", "k1", "k2", F.coalesce(F.col("first") + piece, F.col("base") + below).cast("int").alias("part"),
        F.coalesce("home", F.floor((F.col("base") + below) / runs)).cast("int").alias("shard"),
    )
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place_ = F.row_number().over(Window.partitionBy("part").orderBy("k1", "k2", "size", "crc"))
    # One row per range and piece: shards * runs, and two for each settled group and run, at most.
    return dealt.withColumn("at", place_).join(F.broadcast(starts), "part").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _settled(docs: DataFrame, whole: list[tuple[int, int, int]], run: float, first: int) -> DataFrame:
    """Groups with their shard and pieces of at most ``run`` bytes on average, numbered from ``first``."""
    rows = []
    for k1, shard, size in whole:
        pieces = ceil(size / run)
        rows.append((k1, shard, pieces, first))
        first += pieces
    return docs.sparkSession.createDataFrame(rows, "group long, home int, pieces int, first int")


def _grid(docs: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """For each of the 4,096 prefixes of the first key: splitters below it, and those inside."""
    inside, rows, base = defaultdict(list), [], 0
    for k1, k2 in cuts:
        inside[k1 >> 52].append((k1, k2))
    for prefix in range(-2048, 2048):
        rows.append((prefix, base, inside[prefix]))
        base += len(inside[prefix])
    return docs.sparkSession.createDataFrame(rows, "prefix long, base int, cuts array<struct<k1: long, k2: long>>")

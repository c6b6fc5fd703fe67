"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, slices, stored

CAPACITY, END_ID = 4096, 1
#: A bin this full is closed; items that one task packs at a time; tasks whose rest one task merges.
NEARLY_FULL, BLOCK, FAN_IN = 0.995, 100_000, 8

_PIECES = "key long, id long, piece int, start long, length long, ids_crc32 long"
_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def token_pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` tokens; the last may be shorter.

    Columns ``key`` (numbers the pieces, by task and place: write them before it
    is used twice), ``id`` (the document's), ``piece, start, length, ids_crc32``.
    ``tokenizer`` is a file that executors can open as well.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext

        tokens, key = Tokens(tokenizer), TaskContext.get().partitionId() << 33
        for part in slices(batches):
            out = []
            for id_, data in zip(part.column(0).to_pylist(), tokens.of(part.column(1).to_pylist()), strict=True):
                data += end
                for no, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    out.append((key, id_, no, at // 4, len(piece) // 4, zlib.crc32(piece)))
                    key += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], names=[f.split()[0] for f in _PIECES.split(", ")],
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return rows.mapInArrow(cut, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: per item its bin and offset, per bin its fill.

    Open bins wait in stacks by room left; of the rooms in use, the smallest that
    takes the item is looked up in a sorted list of at most ``capacity`` numbers.
    """
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in order.tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room], rooms[at]
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        if room := capacity - fill[b]:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bin_of, offset, np.asarray(fill, np.int64)


_PLACED = "node long, item long, length long, bin long, offset long, fill long"


def _packed(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """``items`` (node, item, length) of one level, each node packed for itself in blocks of BLOCK items.

    Rows of a node are next to each other in a task.  A block is the most that is
    held; a node with more items (bins that nothing can fill any further) is packed block by
    block.  Bins are numbered by level, task and place.
    """
    def pack(batches):
        from pyspark import TaskContext

        base, made = (level << 58) | (TaskContext.get().partitionId() << 34), 0
        held, node = [], None

        def flush():
            nonlocal made, held
            if not held:
                return None
            item, length = (np.concatenate(x) for x in zip(*held, strict=True))
            bin_of, offset, fill = best_fit(length, capacity)
            out = pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.full(len(item), node), item, length, bin_of + (base + made), offset, fill[bin_of])],
                names=["node", "item", "length", "bin", "offset", "fill"],
            )
            made += len(fill)
            held = []
            return out

        for batch in batches:
            nodes, item, length = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a == z:
                    continue
                if nodes[a] != node:
                    if (done := flush()) is not None:
                        yield done
                    node = nodes[a]
                while a < z:
                    room = BLOCK - sum(len(x[0]) for x in held)
                    held.append((item[a : min(z, a + room)], length[a : min(z, a + room)]))
                    a = min(z, a + room)
                    if sum(len(x[0]) for x in held) >= BLOCK and (done := flush()) is not None:
                        yield done
        if (done := flush()) is not None:
            yield done

    return items.mapInArrow(pack, _PLACED)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``pieces`` (key long, length) with ``sequence_id`` and ``offset``; ``key`` tells pieces apart.

    Level 0: narrow (key, length) rows are dealt by a hash of the key and each task best-fits its own, so
    that a table sorted by length or source packs like any other.  Bins at least ``nearly_full``, and bins whose room is below the shortest item anywhere, are closed.  The others
    are the items of the next level, where one node merges the rest of FAN_IN
    nodes by best fit again, up to a single node or until a level closes nothing
    more.  What moves between levels is the rest: (bin, fill) rows.

    Full pieces are sequences by themselves.  An empty table gives no rows.
    """
    known = pieces.select("key", "length")
    shortest = known.agg(F.min("length")).first()[0]
    if shortest is None:
        return known.select("key", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Two hashes: one deals the rows, the other orders those of a task, whose blocks are then mixed as well.
    dealt = known.filter(F.col("length") < capacity).repartition("key").sortWithinPartitions(F.xxhash64("key"))
    items = dealt.select(F.spark_partition_id().cast("long").alias("node"), F.col("key").alias("item"), "length")
    closed = max(1, min(int(nearly_full * capacity), capacity))
    levels, level, before = [], 0, None
    while True:
        placed = stored(_packed(items, level, capacity), f"pack-{level}")
        levels.append(placed)
        bins = placed.filter((F.col("offset") == 0) & (F.col("fill") < closed) & (F.col("fill") <= capacity - shortest))
        left, nodes = bins.agg(F.count("*"), F.countDistinct("node")).first()
        if nodes <= 1 or before is not None and left > 0.99 * before:
            break
        before, level = left, level + 1
        items = (
            bins.select(F.floor(F.col("node") / FAN_IN).cast("long").alias("node"), F.col("bin").alias("item"), F.col("fill").alias("length"))
            .repartition("node").sortWithinPartitions("node", "item")
        )
    # From the root down: where each bin's content ends up.
    final = None
    for placed in reversed(levels):
        here = placed.select("item", "bin", "offset")
        if final is not None:
            up = final.select(F.col("item").alias("_bin"), F.col("sequence_id").alias("_to"), F.col("offset").alias("_by"))
            here = here.join(up, F.col("bin") == F.col("_bin"), "left").select(
                "item", F.coalesce("_to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset")
            )
        else:
            here = here.withColumnRenamed("bin", "sequence_id")
        final = here
    alone = known.filter(F.col("length") >= capacity).select(
        "key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return final.select(F.col("item").alias("key"), "sequence_id", "offset").unionByName(alone)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of the end token alone.  Rows that repeat an
    id, and rows with a null id, are documents of their own.  An empty table gives no rows.  Other
    columns are not read.
    """
    cut = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    pieces = stored(cut, "pieces")
    return pieces.join(pack(pieces, capacity=capacity), "key").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )

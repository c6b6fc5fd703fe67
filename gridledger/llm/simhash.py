"""Near-duplicate documents by SimHash fingerprints that share Golay codewords."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .near_dedup import components

WORDS, SEED, BITS = 4, 42, 4
#: Widths of the segments of a fingerprint, from its low end; each fits a word of the code.
SEGMENTS = (22, 21, 21)
#: Most fingerprints of one bucket that a task compares with one another: larger ones go in pairs of blocks.
BLOCK = 2048
#: Buckets up to this size are compared side by side.
SMALL = 32
#: The binary Golay code of length 23 as a cyclic code: its generator polynomial, a fixed value.
GENERATOR = 0b101011100011
LENGTH, MESSAGE = 23, 12


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED, piece: int = 65_536) -> int:
    """64 bits, each set if over half of the text's shingle hashes have it; 0 without words."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # on bytes: A-Z alone, and the six ASCII spaces
    if not found:
        return 0
    width = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - width + 1
    total = np.zeros(64, np.int64)
    for at in range(0, n, piece):
        stop = min(at + piece, n)
        spans = zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist(), strict=True)
        hashes = np.fromiter((xxh64_intdigest(joined[a:z], seed) for a, z in spans), np.dtype("<u8"), stop - at)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, print`` of each row; the 64 bits as a long."""
    def sign(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = np.array([fingerprint(x, words, seed) for x in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.view(np.int64))], names=["id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, "id long, print long")


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (LENGTH - MESSAGE))
    return word


@cache
def golay() -> tuple[np.ndarray, ...]:
    """Tables of the code: syndromes of the upper 12 and the lower 11 bits; each syndrome's error; codewords four away.

    The code is perfect: each syndrome is of exactly one error of at most three bits.  For an
    error of three bits there are besides five codewords at distance four of the word, those
    of weight seven that hold all three; they are given as what their number
    differs from the nearest codeword's, and for lighter errors there are none (-1).
    """
    low = LENGTH - MESSAGE
    upper = np.array([_remainder(w << low) for w in range(1 << MESSAGE)], np.int64)
    errors = np.zeros(1 << low, np.int64)
    others = np.full((1 << low, 5), -1, np.int64)
    sevens = [c for m in range(1 << MESSAGE) if (c := m << low | int(upper[m])).bit_count() == 7]
    for weight in range(1, 4):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            syndrome = _remainder(error)
            errors[syndrome] = error
            if weight == 3:
                others[syndrome] = sorted(c >> low for c in sevens if c & error == error)
    return upper, errors, others


def codewords(words: np.ndarray) -> np.ndarray:
    """Numbers of all codewords within distance four of each 23-bit word: the nearest, then five or, as -1, none.

    Two words at distance two have a word between them whose nearest codeword, at most three
    away, is within four of both: they share a number.  Two at distance one have each
    other's nearest codeword among theirs.
    """
    upper, errors, others = golay()
    low = LENGTH - MESSAGE
    syndrome = upper[words >> low] ^ (words & ((1 << low) - 1))
    nearest = (words ^ errors[syndrome]) >> low
    more = others[syndrome]
    return np.concatenate([nearest[:, None], np.where(more < 0, -1, nearest[:, None] ^ more)], axis=1)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, key): fingerprints that differ in at most four bits share a key.

    Of three segments one has at most one error, then: if it has none, another has at most
    two; if it has one, another has one.  A key is of two segments a, b: the nearest codeword of a
    with any of b's, or any of a's with the nearest of b.  Two without
    error in a share a's nearest, and one of b's; with one error in each, either's nearest is one of
    the other's.  At most 33 keys a fingerprint, of 24 bits for each two segments.
    """
    parts, shift = [], 0
    for width in SEGMENTS:
        parts.append(codewords(((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)))
        shift += width
    which, found = [], []
    for number, (a, b) in enumerate(combinations(parts, 2)):
        for one, other in [(a[:, 0], b[:, j]) for j in range(6)] + [(a[:, j], b[:, 0]) for j in range(1, 6)]:
            at = np.flatnonzero((one >= 0) & (other >= 0))
            which.append(at)
            found.append((number << 2 * MESSAGE) | (one[at] << MESSAGE) | other[at])
    return np.concatenate(which), np.concatenate(found)


def links(prints: DataFrame, *, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all of the distinct ``print`` that differ in at most ``bits`` bits, four at most.

    Those of one key are a bucket.  A bucket of more than ``block`` is dealt to pairs of blocks; what a
    task compares comes back as one edge a row at most, however many pairs are near.
    """
    if bits > 4:
        raise ValueError("the keys find fingerprints up to four bits apart")

    def key(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            own = part.column(0).to_numpy()
            at, found = keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(own[at])], names=["key", "print"])

    keyed = stored(prints.select("print").mapInArrow(key, "key long, print long"), "keyed")
    large = stored(keyed.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > block), "large-buckets")
    dealt = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("print", "key"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "print"
    )

    def compare(batches) -> Iterator[pa.RecordBatch]:
        for group, side, own in _whole_groups(batches):
            a, b = _near(group, side, own.view(np.uint64), bits)
            low = _roots(a, b, len(own))
            at = np.flatnonzero(own != own[low])
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[low[at]])], names=["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def _whole_groups(batches, rows: int = 32_768):
    """(group number, side, print) of runs of whole groups, some ten thousand rows at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]) < rows:
            continue
        new = _starts(held)
        if len(new) > 1:
            yield _numbered([x[: new[-1]] for x in held])
            held = [x[new[-1] :] for x in held]
    if held is not None:
        yield _numbered(held)


def _starts(columns) -> np.ndarray:
    key, i, j = columns[:3]
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))


def _numbered(columns):
    first = np.zeros(len(columns[0]), np.int64)
    first[_starts(columns)] = 1
    return np.cumsum(first) - 1, columns[3], columns[4]


def _near(group: np.ndarray, side: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose fingerprints are near; a large group gives one edge a row at most."""
    sizes = np.bincount(group)
    small = np.flatnonzero(sizes[group] <= SMALL)
    pairs = []
    for by in range(1, min(SMALL, int(sizes.max()))):
        a, b = small[:-by], small[by:]
        same = group[a] == group[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        near = np.bitwise_count(own[a] ^ own[b]) <= bits
        pairs.append((a[near], b[near]))
    ends = np.cumsum(sizes)
    for g in np.flatnonzero(sizes > SMALL):
        at = np.arange(ends[g] - sizes[g], ends[g])
        mixed = side[at].any()
        left, right = (at[side[at] == 0], at[side[at] == 1]) if mixed else (at, at)
        for low in range(0, len(left), 256):
            some = left[low : low + 256]
            x, y = np.nonzero(np.bitwise_count(own[some][:, None] ^ own[right][None, :]) <= bits)
            roots = _roots(some[x] - at[0], right[y] - at[0], len(at))
            moved = np.flatnonzero(roots != np.arange(len(at)))
            pairs.append((at[moved], at[roots[moved]]))
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each of n rows is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        one, other = root[a], root[b]
        open_ = one != other
        if not open_.any():
            return root
        a, b, one, other = a[open_], b[open_], one[open_], other[open_]
        low = np.minimum(one, other)
        np.minimum.at(root, one, low)
        np.minimum.at(root, other, low)
        while (root != root[root]).any():
            root = root[root]


def link(
    docs: DataFrame, *, words: int = WORDS, seed: int = SEED, bits: int = BITS, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, fingerprint, component_id``.

    Documents of one fingerprint are a class.  Classes' fingerprints get keys of Golay codewords
    (``keys``); what shares a key is compared, and what differs in at most ``bits`` bits is linked.
    ``component_id`` is the smallest id that links reach, a document's own included.

    A text without words, or null, has fingerprint 0 and is linked like any other.  A null id names no
    component: its row gets the smallest id of the others, null if there are none.
    Rows that repeat an id each go by their own text.  A text is hashed a piece of 65,536 shingles at a
    time, whatever its length.  An empty table gives no rows.  Other columns are not read.
    """
    prints = stored(fingerprints(docs, words=words, seed=seed, id_col=id_col, text_col=text_col), "prints")
    classes = stored(prints.groupBy("print").agg(F.min("id").alias("first")), "classes")
    near = stored(links(classes, bits=bits, block=block).distinct(), "links")
    linked = components(near).withColumnRenamed("node", "print")
    linked = stored(linked.join(classes, "print"), "linked")
    leads = stored(linked.groupBy("component").agg(F.min("first").alias("lead")), "leads")
    led = stored(linked.join(leads, "component").select("print", "lead"), "led")
    named = stored(classes.join(led, "print", "left").select("print", F.coalesce("lead", "first").alias("component_id")), "named")
    # Scans on both sides, so that the class of a third of all rows can be split.
    return prints.join(named, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )

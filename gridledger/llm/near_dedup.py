"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

WORDS, PERCENT = 5, 75
#: Minima of a signature; those of them that make bands, whole minima of a band; bits kept of a minimum.
HASHES, BANDED, ROWS, BITS = 256, 128, 4, 4
#: Most signatures in a block of a bucket; most sets, and shingles, in a block of a cluster.
BLOCK, SETS, SHINGLES = 1024, 512, 1_500_000
#: Standard deviations that an estimate may lie below the threshold and still be confirmed exactly.
SIGMAS = 5.0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every task."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)


class _Hash(dict):
    """64-bit hashes of words, kept while there are fewer than ``most``."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, known: _Hash, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of all words as one if they are fewer than ``size``."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    factors = _series(7, size)
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        total += hashed[i : i + n] * factors[i]
    return np.unique(_mixed(total))


def _minima(shingles: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set, a block of the set at a time."""
    least = np.full(len(xors), np.uint64(2**64 - 1), np.uint64)
    for at in range(0, len(shingles), 2048):
        block = (shingles[None, at : at + 2048] ^ xors[:, None]) * factors[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least


def _arrays(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of longs."""
    ends = np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(np.int64)))


def signatures(
    docs: DataFrame, *, hashes: int = HASHES, banded: int = BANDED, rows: int = ROWS, bits: int = BITS, words: int = WORDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: ``id, h`` (hash of the text), ``n`` (set size), ``digest`` of the set, ``signature``, ``bands``.

    Of each of ``hashes`` minima the signature keeps the ``bits`` lowest bits, as
    ``bits`` planes of ``hashes`` bits packed in longs; ``rows`` whole minima of the
    first ``banded`` make the hash of a band.
    """
    def sign(batches) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        known, xors, factors = _Hash(), _series(1, hashes), _series(2, hashes)
        of_row, of_band = _series(3, rows), _series(4, banded // rows)
        for part in slices(batches):
            sets = [shingle_set(x, known, words) for x in part.column(1).to_pylist()]
            least = np.stack([_minima(s, xors, factors) for s in sets])
            bands = _mixed((least[:, :banded].reshape(len(sets), -1, rows) * of_row).sum(axis=2, dtype=np.uint64) ^ of_band)
            low = _mixed(least)
            planes = [((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(bits)]
            packed = np.concatenate([np.packbits(p, axis=1) for p in planes], axis=1).copy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _arrays(packed), _arrays(bands),
                ],
                names=["id", "h", "n", "digest", "signature", "bands"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(
        sign, "id long, h long, n long, digest binary, signature array<long>, bands array<long>"
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))


def floor_of_estimates(percent: int = PERCENT, *, hashes: int = HASHES, bits: int = BITS, sigmas: float = SIGMAS) -> float:
    """The estimate below which a pair of at least ``percent`` similarity lies with negligible probability."""
    chance = 2.0**-bits
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - sigmas * (p * (1 - p) / hashes) ** 0.5 / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """Per node of ``edges`` (a, b): ``node, component``, the smallest node reachable.

    Alternating large and small stars: each round links every node to the
    smallest it sees, with sums by node and joins by node only; the number of rounds is
    logarithmic.  Rounds are written, so none is computed twice.  So are the minima: both
    sides of the join then come straight from a shuffle, and the adaptive skew join can
    split the rows of a node that most others are linked to.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now, was = stored(now, "stars"), None
    while True:
        # An edge belongs to its smaller end's large star; that end moves to its own smallest neighbour, if it has one.
        least = stored(now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "minima")
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.*").filter("u > v").distinct(), "stars")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was:
            break
        was = mark
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _blocked(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """``rows`` dealt to pairs of blocks (i <= j) of their group ``key``, of which a row is in ``blocks`` many.

    ``side`` is 0 for rows of block i and 1 for those of block j.  Any two rows of a
    group meet in one pair of blocks, and no task gets more of a group than two blocks.
    """
    own = F.pmod(F.xxhash64("id", key), F.col(blocks)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    paired = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return paired.withColumn("side", (F.col("own") > F.col("i")).cast("int")).drop("own", "other", blocks)


def _groups(batches, keys: int, convert):
    """Columns of each run of rows with equal first ``keys`` columns; rows come sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)], axis=1)
        columns = [key, *convert(batch)]
        if held is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(held, columns, strict=True)]
            key = columns[0]
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
        for at, end in zip(edges, edges[1:], strict=False):
            yield [c[at:end] for c in columns[1:]]
        held = [c[edges[-1] :] for c in columns]
    if held is not None:
        yield held[1:]


def _forest(near: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the matrix ``near`` of ``one`` times ``other`` connects: one per node at most."""
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near, one, other = near[np.ix_(rows, columns)], one[rows], other[columns]
    top = np.iinfo(np.int64).max
    mine, yours = one.copy(), other.copy()
    while True:
        new_yours = np.minimum(yours, np.where(near, mine[:, None], top).min(axis=0))
        new_mine = np.minimum(mine, np.where(near, new_yours[None, :], top).min(axis=1))
        if (new_mine == mine).all() and (new_yours == yours).all():
            break
        mine, yours = new_mine, new_yours
    node, root = np.concatenate([one, other]), np.concatenate([mine, yours])
    return node[node != root], root[node != root]


def _edges(found) -> Iterator[pa.RecordBatch]:
    """(node, root) arrays as batches of rows."""
    held, size = [], 0
    for node, root in found:
        if len(node):
            held.append((node, root))
            size += len(node)
        if size > 50_000:
            yield _edge_batch(held)
            held, size = [], 0
    if held:
        yield _edge_batch(held)


def _edge_batch(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["a", "b"])


def similarity(one: np.ndarray, other: np.ndarray, *, bits: int = BITS) -> np.ndarray:
    """Estimated similarity of each pair of packed signatures: the share of equal minima, less chance agreement.

    A minimum differs if any of its bit planes does; the bits that differ are counted a
    long at a time.  Different minima agree in their low bits with probability ``2 ** -bits``.
    """
    longs = one.shape[1] // bits
    unequal = np.zeros((len(one), len(other)), np.uint16)
    for j in range(longs):
        diff = one[:, None, j] ^ other[None, :, j]
        for b in range(1, bits):
            diff |= one[:, None, b * longs + j] ^ other[None, :, b * longs + j]
        unequal += np.bitwise_count(diff)
    chance = 2.0**-bits
    return (1 - unequal / (64.0 * longs) - chance) / (1 - chance)


def candidates(buckets: DataFrame, *, percent: int, least: float, bits: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all rows of a bucket whose sizes and estimate allow the similarity.

    ``buckets``: band, id, n, signature, and ``m`` rows in the bucket.  Signatures are
    compared by bit counts, a pair of blocks at a time; a pair of blocks gives at most one
    edge per row, however many of its pairs are near.
    """
    def compare(batches):
        def convert(batch):
            sig = batch.column(6)
            flat = sig.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            return [*[batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5)], flat]

        def found():
            for side, ids, n, sig in _groups(batches, 3, convert):
                one, other = (side == 0, side == 1) if side.any() else (side == 0, side == 0)
                na, nb = n[one][:, None], n[other][None, :]
                near = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                near &= similarity(sig[one], sig[other], bits=bits) >= least
                near &= ids[one][:, None] != ids[other][None, :]
                yield _forest(near, ids[one], ids[other])

        yield from _edges(found())

    blocked = _blocked(buckets.withColumn("blocks", F.ceil(F.col("m") / block).cast("int")), "band", "blocks")
    rows = blocked.select("band", "i", "j", "side", "id", "n", "signature")
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(compare, "a long, b long")


def confirmed(members: DataFrame, *, percent: int, block: int = SETS, weight: int = SHINGLES) -> DataFrame:
    """Edges (a, b) that connect all members of a cluster whose full sets reach the similarity.

    ``members``: cluster, id, n, shingles, and the cluster's ``m`` rows and ``total``
    shingles.  Blocks hold ``block`` sets or ``weight`` shingles on average; the
    intersections of two blocks are one product of their incidence matrices, over the
    shingles that occur twice, a slice of shingles at a time.
    """
    def compare(batches):
        def convert(batch):
            sets = np.empty(batch.num_rows, object)
            column = batch.column(5)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i in range(batch.num_rows):
                sets[i] = flat[ends[i] - ends[0] : ends[i + 1] - ends[0]]
            return [*[batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)], sets]

        def found():
            for side, ids, sets in _groups(batches, 3, convert):
                one, other = (side == 0, side == 1) if side.any() else (side == 0, side == 0)
                both = _intersections(sets[one], sets[other])
                n = np.asarray([len(x) for x in sets], np.int64)
                near = 100 * both >= percent * (n[one][:, None] + n[other][None, :] - both)
                near &= ids[one][:, None] != ids[other][None, :]
                yield _forest(near, ids[one], ids[other])

        yield from _edges(found())

    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("total") / weight)).cast("int")
    rows = _blocked(members.withColumn("blocks", blocks), "cluster", "blocks")
    rows = rows.select("cluster", "i", "j", "side", "id", "shingles")
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(compare, "a long, b long")


def _intersections(one, other) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    same = len(one) == len(other) and all(x is y for x, y in zip(one, other, strict=True))
    lists = list(one) if same else [*one, *other]
    values, at, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    shared = times[at] > 1
    place = np.cumsum(times > 1)[at][shared] - 1
    row, width = row[shared], int((times > 1).sum())
    if same:  # a set with itself shares everything, singles too; such pairs are not asked for
        left = right = len(one)
    else:
        left, right = len(one), len(other)
    out = np.zeros((left, right), np.int64)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for low in range(0, width, 4096):
        a, z = np.searchsorted(place, [low, low + 4096])
        grid = np.zeros((len(lists), min(4096, width - low)), np.float32)
        grid[row[a:z], place[a:z] - low] = 1
        out += (grid @ grid.T if same else grid[:left] @ grid[left:].T).astype(np.int64)
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, shingles) of each class ``id`` of ``wanted``, from the document (doc, h) that stands for it."""
    def sets(batches):
        known = _Hash()
        for part in slices(batches):
            found = [shingle_set(x, known, words).view(np.int64) for x in part.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "shingles"])

    texts = docs.withColumnRenamed("id", "doc").join(wanted, ["doc", "h"]).dropDuplicates(["doc", "h"])
    return texts.select("id", "text").mapInArrow(sets, "id long, shingles array<long>")


def link(
    docs: DataFrame, *, percent: int = PERCENT, words: int = WORDS, hashes: int = HASHES, banded: int = BANDED,
    rows: int = ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``.

    1. Documents whose shingle sets have one 128-bit digest are a class, named by the number of one of its rows.
    2. Classes that share a band hash are a bucket.  Its members are compared by bit
       counts of their packed signatures, and those whose estimate is not more than
       SIGMAS deviations below the threshold are connected.
    3. What is connected over all buckets is a cluster.  Its members' full sets are made
       from the texts and compared; what reaches the threshold is connected.
    4. Components of that, with their classes, are the result, named by their smallest id.

    Buckets and clusters are compared in pairs of blocks of bounded size, which give
    at most one edge per row: a group's pairs are never rows, and no task
    holds a whole group.

    A text without words, or null, has no shingles and is linked with nothing.  A null id can
    not be linked: component_id is null and the row is kept.  Rows that
    repeat an id with different texts are judged each by its own text; of a component whose
    smallest id has several texts one class is kept.  An empty table gives no rows.
    Other columns are not read.
    """
    found = _linked(
        docs, percent=percent, words=words, hashes=hashes, banded=banded, rows=rows, bits=bits, id_col=id_col, text_col=text_col
    )
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _linked(
    docs: DataFrame, *, percent: int = PERCENT, words: int = WORDS, hashes: int = HASHES, banded: int = BANDED,
    rows: int = ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``link`` with ``id``, ``n`` and the hash ``h`` of the text; ``id`` names a class until the last step."""
    made = signatures(docs, hashes=hashes, banded=banded, rows=rows, bits=bits, words=words, id_col=id_col, text_col=text_col)
    # The row number holds once it is written: it picks one row of a class, whatever ids and texts repeat, and names the class.
    signed = stored(made.withColumn("row", F.monotonically_increasing_id()), "signed")
    named = signed.filter("n > 0 AND id IS NOT NULL")
    classes = stored(named.groupBy("digest").agg(F.min("id").alias("first"), F.min("row").alias("class")), "classes")
    members = stored(
        named.join(classes.select(F.col("class").alias("row")), "row").select(
            F.col("row").alias("id"), F.col("id").alias("doc"), "h", "n", "signature", "bands"
        ),
        "class-signatures",
    )
    band_rows = members.select("id", F.explode("bands").alias("band"))
    shared = band_rows.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    buckets = band_rows.join(shared, "band").join(members.select("id", "n", "signature"), "id")
    least = floor_of_estimates(percent, hashes=hashes, bits=bits)
    near = stored(candidates(buckets, percent=percent, least=least, bits=bits).distinct(), "candidates")

    clusters = stored(components(near).withColumnRenamed("component", "cluster").withColumnRenamed("node", "id"), "clusters")
    wanted = members.join(clusters, "id", "left_semi").select("id", "doc", "h")
    sets = stored(shingle_sets(_texts(docs, id_col, text_col), wanted, words), "sets")
    counted = clusters.join(members.select("id", "n"), "id").groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    links = confirmed(sets.join(clusters, "id").join(counted, "cluster"), percent=percent)
    labels = stored(components(links).withColumnRenamed("node", "class"), "labels")

    # From here on by doc_id: a component is led by the class of its smallest id; of several, by the smallest digest.
    alone = F.struct("first", "digest")
    linked = stored(labels.join(classes, "class").select("class", "component", alone.alias("own")), "linked")
    leads = stored(linked.groupBy("component").agg(F.min("own").alias("lead")), "leads")
    led = stored(linked.join(leads, "component").select("class", "lead"), "led")
    leading = classes.join(led, "class", "left").select("digest", F.coalesce("lead", alone).alias("lead"))
    mine = F.when(F.col("n") > 0, F.col("digest")).alias("digest")
    whole = signed.select("id", "h", "n", mine).join(leading, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("lead.first", "id"))
    stays = (F.col("lead.first") == F.col("id")) & (F.col("lead.digest") == F.col("digest"))
    kept = F.when(F.col("id").isNull() | F.col("lead").isNull(), True).otherwise(stays)
    return whole.select("id", "h", "n", component.alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns; see ``link``.

    Rows go by id and text, so a text stays though another one under its id is a near copy.
    """
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    found = _linked(docs, **how).filter(~F.col("kept"))
    gone = stored(found.select(F.col("id").alias("gone"), F.col("h").alias("text")).distinct(), "gone")
    # Whole rows go in one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"))
    return rows.join(gone, (F.col("_id") == F.col("gone")) & (F.col("_h") == F.col("text")), "left_anti").select("_row.*")

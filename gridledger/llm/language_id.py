"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Fitting: labelled documents of a language, and contexts of three bytes that the trees keep; both bound the model.
SAMPLE, CONTEXTS = 1500, 40_000
SEED, BLOCK = 11, 1 << 20
_letter = re.compile(r"[^\W\d_]").search


@dataclass
class Model:
    """Frozen code lengths. A byte is a symbol (``symbol``, the last for bytes never seen).

    ``row[c]`` is the row of a context of three symbols in ``bits``, or -1; rows from
    ``short`` on belong to contexts of two.  ``bits`` has a column per language.
    """

    langs: list[str]
    symbol: np.ndarray
    size: int
    row: np.ndarray
    short: int
    bits: np.ndarray


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(b"   " + text.lower().encode(), np.uint8)


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, *, sample: int = SAMPLE, contexts: int = CONTEXTS, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Byte context trees of every language from labelled documents that are not held out.

    Of each language the ``sample`` documents with the smallest seeded hash of their id
    are taken, whole.  Tasks count runs of four bytes; the sums, bounded by the
    sample, go to the driver.  Rows without id, label or text are not used.
    """
    known = docs.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1).filter(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    ).select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    ranked = known.select("lang", "h").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    last = {r.lang: r.h for r in ranked.filter(F.col("k") <= sample).groupBy("lang").agg(F.max("h").alias("h")).collect()}
    bound = F.lit(None).cast("long")
    for lang, h in last.items():
        bound = F.when(F.col("lang") == lang, F.lit(h)).otherwise(bound)

    def count(batches):
        for part in slices(batches, 1024):
            langs = np.asarray(part.column(0).to_pylist(), object)
            texts = part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                grams = [_grams(_bytes(texts[i])) for i in np.flatnonzero(langs == lang)]
                key, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
                )

    taken = known.filter(F.col("h") <= bound).select("lang", "text")
    sums = taken.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return _model(sorted(last), sums, contexts)


def _grams(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:] if len(d) > 3 else np.empty(0, np.uint32)


def _model(langs: list[str], sums, contexts: int) -> Model | None:
    if not langs or not len(sums):
        return None
    gram = sums["gram"].to_numpy(np.int64)
    parts = [(gram >> s & 255) for s in (24, 16, 8, 0)]
    seen = np.unique(np.concatenate(parts))
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    size = len(seen) + 1
    a, b, c, s = (symbol[p] for p in parts)
    three = (a * size + b) * size + c
    total = np.bincount(three, weights=sums["n"].to_numpy(float), minlength=size**3)
    kept = np.sort(np.argsort(-total, kind="stable")[: min(contexts, int((total > 0).sum()))])
    row = np.full(size**3, -1, np.int32)
    row[kept] = np.arange(len(kept))
    of = sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    n = sums["n"].to_numpy(float)
    bits = np.empty((len(langs), len(kept) + size * size, size), np.float32)
    for i in range(len(langs)):
        mine = of == i
        one, two, sym, times = c[mine], b[mine] * size + c[mine], s[mine], n[mine]
        lowest = np.full((1, size), 8.0)  # order -1: every byte alike
        order0 = _coded(np.bincount(sym, weights=times, minlength=size)[None, :], lowest)
        order1 = _coded(_table(one, sym, times, size, size), order0)
        order2 = _coded(_table(two, sym, times, size * size, size), order1[np.arange(size * size) % size])
        at = row[three[mine]]
        order3 = _table(at[at >= 0], sym[at >= 0], times[at >= 0], len(kept), size)
        bits[i, : len(kept)] = _coded(order3, order2[kept % (size * size)])
        bits[i, len(kept) :] = order2
    flat = np.ascontiguousarray(bits.reshape(len(langs), -1).T)
    return Model(langs, symbol.astype(np.int32), size, row, len(kept), flat)


def _table(context, symbol, times, contexts: int, size: int) -> np.ndarray:
    return np.bincount(context * size + symbol, weights=times, minlength=contexts * size).reshape(contexts, size)


def _coded(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Code lengths in bits of each symbol after each context.

    A context seen n times with t different symbols escapes with probability
    t / (n + t); a symbol it has seen k times has k / (n + t); any other costs the
    escape and its length after the shorter context.  A context never seen is passed over.
    """
    n, t = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = -np.log2(counts / (n + t))
        escape = np.where(n > 0, -np.log2(t / (n + t)), 0.0)
    return np.where(counts > 0, own, escape + shorter)


def code_lengths(model: Model, text: str) -> np.ndarray:
    """Bits that each language's tree needs for the text."""
    data = model.symbol[_bytes(text)]
    total = np.zeros(len(model.langs))
    for at in range(0, len(data) - 3, BLOCK):
        d = data[at : at + BLOCK + 3]
        two = d[1:-2] * model.size + d[2:-1]
        row = model.row[d[:-3] * (model.size * model.size) + two]
        key = np.where(row >= 0, row, model.short + two).astype(np.int64) * model.size + d[3:]
        total += model.bits[key].sum(axis=0, dtype=np.float64)
    return total


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col, held_out, lang_pred, score``.

    The language whose tree codes the text in the fewest bits (of equal ones the
    first by name); ``score`` is its share of ``2 ** -bits`` over all languages.  A null text, one without
    letters, or any text when there is no model: ``und`` with score 0.  Null ids are not held out.
    Repeated rows are rows like any other; an empty table gives no rows.  Other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(text: str):
        if shared.value is None or not _letter(text):
            return "und", 0.0
        bits = code_lengths(shared.value, text)
        best = int(bits.argmin())
        return shared.value.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())

    def run(batches):
        for part in slices(batches):
            found = [tell(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)

"""Quality rules: how far a document's characters and words are from its language's."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Base rules: fewest words; most per cent of words in repeated 3-word windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Divergence rules: fewest words to be judged; largest Jensen-Shannon distances from the nearest reference.
#: A histogram of n words is off by chance by some 1 / sqrt(n): the word bound is MOST_COMMON + CHANCE / sqrt(n).
GUARD, MOST_CHARS, MOST_COMMON, CHANCE = 50, 0.30, 0.15, 2.6
#: Common words of a reference; parts that a language's words are ranked in first; words a task counts before it passes them on.
COMMON, SALTS, HELD = 50, 4, 200_000

_SPACES, _SYMBOLS, _MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".,;:!?\"()"
CLASSES = ["lower", "upper", "digit", "space", "mark", "symbol", "other"]


def _class_of_byte() -> np.ndarray:
    """Class of each byte; a character beyond ASCII counts at its first byte, the following ones (class 7) not at all."""
    out = np.full(256, 6, np.uint8)
    for b in range(128):
        c = bytes([b])
        out[b] = (
            0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in _SPACES
            else 4 if c in b".,;:!?'\"()-" else 5
        )
    out[0x80:0xC0] = 7
    return out


_CLASS = _class_of_byte()
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)[:7]


def plain_words(data: bytes) -> list[bytes]:
    """Words in lower case without sentence marks, for the common-word histogram."""
    return data.lower().translate(_TO_SPACE).split()


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = data.split()
    n = len(words)
    inside = data.translate(None, _SPACES)
    chars = len(inside) - int(np.count_nonzero((np.frombuffer(inside, np.uint8) & 0xC0) == 0x80))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        two = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
        _, at, times = np.unique(two[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        marked = np.zeros(n, bool)
        for i in range(3):
            marked[i : n - 2 + i] |= twice
        repeated = int(marked.sum())
    return n, chars, len(data) - len(data.translate(None, _SYMBOLS)), dup, repeated


def distance(p: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of ``p`` from each row of ``references``."""
    mid = (p + references) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(mid > 0, mid, 1)), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (part(np.broadcast_to(p, references.shape)) + part(references)) / 2))


def references(docs: DataFrame, *, common: int = COMMON, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Per language: counts of character classes, of its ``common`` most frequent words, and of all words, over all documents.

    One pass over the texts counts every word of every language, exactly: a task passes on its
    words with their counts, Spark adds them up, and the most frequent (the smaller bytes first of
    equals) are chosen in two levels, so that of a language no task gets more than ``SALTS * common`` at the end.
    How the table is partitioned changes nothing.  The driver gets ``common + 8`` rows a
    language.  Documents without a language give no reference.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()

    def counted(batches):
        words, classes, size, held = defaultdict(Counter), defaultdict(lambda: np.zeros(7, np.int64)), Counter(), 0
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                data = text.encode()
                these, own = plain_words(data), words[lang]
                held -= len(own)
                own.update(these)
                held += len(own)
                classes[lang] += class_counts(data)
                size[lang] += len(these)
            if held > HELD:  # what comes later is added up by Spark
                yield _counts([(lang, w, k) for lang, c in words.items() for w, k in c.items()])
                words.clear()
                held = 0
        out = [(lang, w, k) for lang, c in words.items() for w, k in c.items()]
        out += [(lang, f" {name}".encode(), int(k)) for lang, c in classes.items() for name, k in zip(CLASSES, c, strict=True)]
        yield _counts(out + [(lang, b" words", k) for lang, k in size.items()])

    sums = stored(rows.mapInArrow(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    is_word = F.substring("word", 1, 1) != F.lit(b" ")
    most = sums.filter(is_word).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
        most = most.withColumn("k", first).filter(F.col("k") <= common)
    made: dict[str, dict] = defaultdict(lambda: {"classes": np.zeros(7), "words": {}, "n": 0})
    for r in [*sums.filter(~is_word).collect(), *sorted(most.collect(), key=lambda r: (r.lang, r.k))]:
        word, of = bytes(r.word), made[r.lang]
        if word == b" words":
            of["n"] = r.n
        elif word[:1] == b" ":
            of["classes"][CLASSES.index(word[1:].decode())] = r.n
        else:
            of["words"][word] = r.n
    return {lang: of for lang, of in sorted(made.items()) if of["n"]}


def _counts(rows) -> pa.RecordBatch:
    types = (pa.string(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["lang", "word", "n"])


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double"


def judge(
    docs: DataFrame, refs: dict, *, guard: int = GUARD, most_chars: float = MOST_CHARS, most_common: float = MOST_COMMON,
    chance: float = CHANCE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: ``id_col``, base counts, distances, ``base_failed, kept``.

    A document's class histogram and common-word histogram (common words and all
    others as one) are compared with every language's; the nearest counts,
    so a wrong or missing label or a text in two languages is no reason to reject.
    The bound of the word distance is wider for short texts, whose histograms are
    off by chance.  Documents under ``guard`` words are not judged by distance (their distances are
    null), nor is any if there is no reference.

    A null text has no words and fails the base rules, like an empty one.  Null and repeated
    ids are rows like any other; an empty table gives no rows.  Other columns are
    not read.
    """
    langs = list(refs.values())
    classes = np.stack([of["classes"] / max(1, of["classes"].sum()) for of in langs]) if langs else None
    commons = []
    for of in langs:
        shares = np.asarray([*of["words"].values()], float) / of["n"]
        commons.append((list(of["words"]), np.append(shares, max(0.0, 1 - shares.sum()))[None, :]))

    def distances(data: bytes, n: int):
        if n < guard or not langs:
            return None, None
        chars = class_counts(data)
        words = Counter(plain_words(data))
        size = max(1, sum(words.values()))
        near = []
        for names, shares in commons:
            own = np.asarray([words[w] for w in names], float) / size
            near.append(distance(np.append(own, 1 - own.sum()), shares)[0])
        return float(distance(chars / chars.sum(), classes).min()), float(min(near))

    def rate(batches):
        for part in slices(batches):
            out = []
            for text in part.column(1).to_pylist():
                data = text.encode()
                base = base_counts(data)
                out.append((*base, *distances(data, base[0])))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.float64()) for c in columns[5:]]],
                names=["id", *[f.split()[0] for f in _FIELDS.split(", ")]],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rated = rows.mapInArrow(rate, f"id {dict(rows.dtypes)['id']}, {_FIELDS}")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    bound = most_common + chance / F.sqrt(F.greatest("n_words", F.lit(1)))
    far = F.coalesce(F.col("char_distance") > most_chars, F.lit(False)) | F.coalesce(F.col("word_distance") > bound, F.lit(False))
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    return rated.select(F.col("id").alias(id_col), *names, failed.alias("base_failed"), (~failed & ~far).alias("kept"))

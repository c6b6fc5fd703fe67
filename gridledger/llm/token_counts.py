"""Token counts of whole texts, with overlap resynchronisation for huge ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, slices

#: Texts of more code points than HUGE are encoded in chunks of CHUNK that overlap by OVERLAP.
HUGE, CHUNK, OVERLAP, LIMIT = 32_768, 16_384, 256, 2048
#: Code points before a chunk's end in which a match may still depend on what follows.
MARGIN = 32


def count_huge(library, text: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of a text, never encoded as a whole, and how often an overlap had to be widened.

    Chunk i + 1 starts ``overlap`` before the end of chunk i.  They are spliced at a
    stable common boundary: a place where both begin a match of the
    pre-tokenizer, that is not so near the left chunk's end that more text could
    change a match before it, and where normalisation cannot reach across (an ASCII
    character, or white space before it).  From such a place both read the same
    text from the same state, so tokens left of it come from the left chunk and
    the others from the right one.  An overlap without one is doubled, with its
    chunk, up to the left chunk's start and then to the rest of the text.
    """
    total, widened, cut = 0, 0, 0  # tokens before the boundary ``cut``
    start, end = 0, min(len(text), chunk)
    left = _boundaries(library, text, start, end)
    while end < len(text):
        back, reach = overlap, chunk
        while True:
            begin, stop = max(cut + 1, end - back), min(len(text), end + reach)
            right = _boundaries(library, text, begin, stop)
            at = _common(text, left, right, end)
            if at is not None:
                break
            widened += 1
            if begin == cut + 1:  # all of the left chunk was tried: lengthen that chunk itself
                at, stop = cut, min(len(text), end + reach)
                right = _boundaries(library, text, at, stop)
                break
            back, reach = 2 * back, 2 * reach
        total += _tokens(left, cut, at)
        left, cut, end = right, at, stop
    return total + _tokens(left, cut, len(text) + 1), widened


def _boundaries(library, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Where tokens begin in ``text[start:end]``, and where matches of the pre-tokenizer do."""
    found = library.encode(text[start:end], add_special_tokens=False)
    begins = [start + a for a, _ in found.offsets]
    words = found.word_ids
    return begins, [b for i, b in enumerate(begins) if i == 0 or words[i] != words[i - 1] or words[i] is None]


def _common(text: str, left, right, end: int) -> int | None:
    known = set(left[1])
    for p in right[1]:
        if p >= end - MARGIN:
            return None
        if p in known and (text[p] < "\x80" or text[p - 1].isspace()):
            return p
    return None


def _tokens(part, low: int, high: int) -> int:
    return sum(low <= b < high for b in part[0])


def token_counts(
    docs: DataFrame, tokenizer: str, *, limit: int = LIMIT, huge: int = HUGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``id_col, n_bytes, n_tokens, over_limit, n_widened``.

    ``n_widened`` is how many overlaps had to be widened (0 for texts encoded
    whole).  A null text counts as empty: 0 bytes, 0 tokens.  Null and repeated ids
    are rows like any other; an empty table gives no rows.  Other columns are not
    read.  The rows stay where they are; nothing is shuffled.
    """
    def count(batches):
        tokens = Tokens(tokenizer)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            counts = [(0, 0)] * len(texts)
            short = [i for i, x in enumerate(texts) if len(x) <= huge]
            for i, ids in zip(short, tokens.of([texts[i] for i in short]), strict=True):
                counts[i] = (len(ids) // 4, 0)
            for i, x in enumerate(texts):
                if len(x) > huge:
                    counts[i] = count_huge(tokens.library, x)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([c for c, _ in counts], pa.int64()), pa.array([w for _, w in counts], pa.int64())],
                names=["id", "n_bytes", "n_tokens", "n_widened"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["id"]
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, n_widened long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_widened"
    )

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Letters that are one code point, lower-case or with a lower-case form in Latin-1; fixed values.
LATIN = "a-zA-ZÀ-ÖØ-öø-ÿ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Runs a job and cuts the lineage: what comes after does not recompute it, and
    a lost executor loses none of it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content(text: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast(
        "long"
    )


def slices(batches, rows: int = 256) -> Iterator:
    """Arrow batches cut into pieces of a few rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Tokens:
    """Token ids of texts by a tokenizer file of the ``tokenizers`` library.

    ``of(texts)`` gives each text's ids as unsigned 32-bit numbers, as bytes in the
    machine's (little-endian) order.  A tokenizer that drops white space before it
    merges (its pre-tokenizer keeps only matches that hold none) gives a text the ids
    of its words one after the other; then a word's ids are kept for when it comes
    back, and only new words go to the library.  Any other tokenizer gets
    whole texts.  At most ``most_words`` words are kept.
    """

    def __init__(self, path: str, most_words: int = 600_000):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_word = _drops_white_space(json.load(file))
        self.kept = _WordIds(self.library, most_words)

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            found = self.library.encode_batch_fast(texts, add_special_tokens=False)
            return [array("I", x.ids).tobytes() for x in found]
        ids = self.kept.__getitem__
        # Lower case for A-Z is what the tokenizer does first, but for its special strings.
        return [b"".join(map(ids, (x.encode() if "<|" in x else x.encode().lower()).split())) for x in texts]


class _WordIds(dict):
    """Ids of words (UTF-8), by the library when a word is new."""

    def __init__(self, library, most: int):
        import re

        self.library, self.merge, self.most = library, library.model.tokenize, most
        self.bytes_as = str.maketrans(_byte_letters())
        # Letters, then signs without an apostrophe: at most two matches of the pre-tokenizer.
        self.plain = re.compile(rf"([{LATIN}]+)([!-&(-/:-@\[-`{{-~]*)").fullmatch

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        parts = self.plain(text)
        if parts is None:
            ids = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        elif signs := parts[2]:
            ids = self[parts[1].encode()] + self._merged(signs)
        else:
            low = text.lower()
            ids = self._merged(low if low.isascii() else low.encode().decode("latin-1").translate(self.bytes_as))
        self[word] = ids
        return ids

    def _merged(self, match: str) -> bytes:
        """Ids of one match of the pre-tokenizer, in lower case and with letters for its bytes: the merges alone."""
        return array("I", [t.id for t in self.merge(match)]).tobytes()


def _drops_white_space(spec: dict) -> bool:
    """Whether the file describes a lower-casing tokenizer whose matches hold no white space."""
    import re

    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or norms != ["NFC", "Replace", "Lowercase"]:
        return False
    split = steps[0]
    added = spec.get("added_tokens", [])
    return (
        split["behavior"] == "Removed" and split["invert"] and "\\s" not in split["pattern"]["Regex"].replace("[^\\s", "")
        and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
        and not any(re.search(r"\s", x["content"]) for x in added)
    )


def _byte_letters() -> dict[str, str]:
    """The visible letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(0x100 + i) for i, b in enumerate(hidden)}

"""Contract text to sections to overlapping word windows.

The unit of work is one document row that holds its blocks as an array, so
splitting and chunking are narrow: text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions import text as X

_BLOCKS = "array<struct<page:int,text:string>>"


def clean_blocks(blocks: Column) -> Column:
    """Blocks with their text stripped, near-empty ones left out."""
    stripped = F.transform(
        blocks, lambda b: F.struct(b["page"].cast("int").alias("page"), X.strip(b["text"]).alias("text"))
    )
    return F.filter(stripped, lambda b: F.length(b["text"]) >= V.MIN_BLOCK_CHARS)


def not_heading_noise(blocks: DataFrame) -> DataFrame:
    """The same filter on a table with one row per block."""
    return blocks.filter(F.length(X.strip(F.col("text"))) >= V.MIN_BLOCK_CHARS)


def gather_blocks(blocks: DataFrame, *, doc: str = "contract_id", order=("page", "block_no")) -> DataFrame:
    """One row per block to one row per document; a document fits a row because it came from one file."""
    item = F.struct(*order, "text")
    return blocks.groupBy(doc).agg(
        F.transform(
            F.sort_array(F.collect_list(item)),
            lambda b: F.struct(b["page"].cast("int").alias("page"), b["text"].alias("text")),
        ).alias("blocks")
    )


def _section_columns(blocks: str) -> dict[str, Column]:
    """The steps from a document's blocks to its sections, each over the columns of those before."""
    def section(start, ord_):
        until = F.coalesce(F.get("_starts", ord_ + 1), F.size("_blocks"))
        head = F.get("_heads", start)
        body = F.slice("_blocks", start + 1, until - start)
        return F.struct(
            ord_.alias("section_ord"),
            F.coalesce(head["clause_id"], F.lit(V.PREAMBLE_CLAUSE)).alias("clause_id"),
            F.coalesce(head["section_title"], F.lit(V.PREAMBLE_TITLE)).alias("section_title"),
            F.when(head.isNull(), F.lit(1)).otherwise(F.get("_blocks", start)["page"]).alias("page_number"),
            F.array_join(F.transform(body, lambda b: b["text"]), " ").alias("section_text"),
        )

    return {
        "_blocks": clean_blocks(F.col(blocks)),
        "_heads": F.transform("_blocks", lambda b: X.detect_clause(b["text"])),
        "_starts": F.array_compact(F.transform("_heads", lambda h, i: F.when((i == 0) | h.isNotNull(), i))),
        # Sections are built inside the array, so a section row carries its own text only.
        "_sections": F.transform("_starts", section),
    }


def split_sections(docs: DataFrame, *, doc: str = "contract_id", blocks: str = "blocks",
                   columns: dict[str, Column] | None = None) -> DataFrame:
    """Documents to sections: a heading block opens one, blocks before the first heading form the preamble."""
    steps = columns or _section_columns(blocks)
    marked = docs.select(doc, steps["_blocks"].alias("_blocks")).withColumn("_heads", steps["_heads"])
    opened = marked.withColumn("_starts", steps["_starts"])
    built = opened.select(doc, steps["_sections"].alias("_sections"))
    # The outer form: for the inner one the optimizer adds a test of the array
    # below, which would detect all headings once more.
    return built.select(doc, F.inline_outer("_sections")).filter(F.col("section_ord").isNotNull())


def section_carry_forward(blocks: DataFrame, *, doc: str = "contract_id",
                          order=("page", "block_no")) -> DataFrame:
    """Row-per-block form: each block with the ordinal and heading of the section it belongs to.

    Sections are numbered in two steps, within a page and over the per-page
    counts of a document, so a window never holds more than a page of text.
    """
    page = order[0]
    kept = not_heading_noise(blocks).withColumn("_head", X.detect_clause(X.strip(F.col("text"))))
    within = Window.partitionBy(doc, page).orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("_head").isNotNull()
    kept = kept.withColumns({
        "_seen": F.count_if(opens).over(running),
        "_last": F.last("_head", ignorenulls=True).over(running),
    })
    pages = kept.groupBy(doc, page).agg(
        F.count_if(opens).alias("_n"),
        F.max_by("_head", F.when(opens, F.struct(*order))).alias("_page_head"),
    )
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select(
        doc, page,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.last("_page_head", ignorenulls=True).over(before).alias("_carried"),
    )
    head = F.coalesce("_last", "_carried")
    return kept.join(pages, [doc, page]).select(
        doc, *order, X.strip(F.col("text")).alias("text"),
        (F.col("_before") + F.col("_seen")).alias("headings_so_far"),
        F.coalesce(head["clause_id"], F.lit(V.PREAMBLE_CLAUSE)).alias("clause_id"),
        F.coalesce(head["section_title"], F.lit(V.PREAMBLE_TITLE)).alias("section_title"),
    )


def _word_columns(doc: str, size: int, overlap: int, legacy_ids: bool) -> tuple[Column, Column, list[Column]]:
    """The words of a section, the places where windows begin, and the columns of a window."""
    last = F.greatest(F.lit(1), F.size("_words") - overlap) - 1
    window = F.slice("_words", F.col("_pos") + 1, F.lit(size))
    ids = X.chunk_id(
        F.col(doc), F.col("clause_id"), F.col("_pos"), None if legacy_ids else F.col("section_ord")
    )
    return X.words(F.col("section_text")), F.explode(F.sequence(F.lit(0), last, F.lit(size - overlap))), [
        ids.alias("chunk_id"),
        F.col(doc).alias("contract_id"),
        F.array_join(window, " ").alias("chunk_text"),
        F.col("clause_id"),
        F.col("section_title"),
        F.col("page_number"),
        F.size(window).alias("token_count"),
        F.lit(None).cast("string").alias("risk_category"),
        (F.col("_pos") * V.CHARS_PER_WORD).alias("char_start"),
    ]


def chunk_words(sections: DataFrame, *, doc: str = "contract_id", size: int = V.WORDS_PER_CHUNK,
                overlap: int = V.WORDS_OVERLAP, legacy_ids: bool = False, columns: tuple | None = None) -> DataFrame:
    """Sections to windows of ``size`` words that share ``overlap`` words with the one before."""
    words, places, window = columns or _word_columns(doc, size, overlap, legacy_ids)
    placed = sections.withColumn("_words", words).withColumn("_pos", places)
    return placed.select(*window).filter(F.col("token_count") > 0)


def tag_batch(chunks: DataFrame, *, text: str = "chunk_text", out: str = "risk_category",
              taxonomy: dict = V.RISK_TAXONOMY, tag: Column | None = None) -> DataFrame:
    """Fill the category where it is still missing; ``tag`` is the category's expression, if it is built already."""
    found = X.tag_chunk(F.col(text), taxonomy) if tag is None else tag
    return chunks.withColumn(out, F.coalesce(F.col(out), found))


def chunker(*, doc: str = "contract_id", blocks: str = "blocks", size: int = V.WORDS_PER_CHUNK,
            overlap: int = V.WORDS_OVERLAP, legacy_ids: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A function from documents with blocks to tagged chunks, without a shuffle.

    The expressions for headings and tags take about a second of calls to build; they are built here, once for
    all batches that the function is given.
    """
    steps, words, tag = _section_columns(blocks), _word_columns(doc, size, overlap, legacy_ids), X.tag_chunk(F.col("chunk_text"))
    return lambda docs: tag_batch(chunk_words(split_sections(docs, doc=doc, columns=steps), columns=words), tag=tag)


def chunk_documents(docs: DataFrame, *, doc: str = "contract_id", blocks: str = "blocks", **chunking) -> DataFrame:
    """Documents with blocks to tagged chunks, without a shuffle."""
    return chunker(doc=doc, blocks=blocks, **chunking)(docs)


def extract_blocks(docs: DataFrame, *, extractor: Callable[[bytes], Iterable[tuple[int, str]]],
                   doc: str = "contract_id", content: str = "content") -> DataFrame:
    """Run a user-supplied decoder over file contents: (document, blocks, error).

    A file that cannot be decoded keeps a row with the error text instead of
    being dropped.
    """
    def decode(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch[doc], batch[content], strict=True):
                try:
                    found = [{"page": int(p), "text": t} for p, t in extractor(bytes(data))]
                    rows.append((name, found, None))
                except Exception as exc:  # noqa: BLE001 - any decoder error becomes a row
                    rows.append((name, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=[doc, "blocks", "error"])

    schema = T.StructType([
        T.StructField(doc, T.StringType()),
        T.StructField("blocks", T.ArrayType(T.StructType([
            T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()),
        ]))),
        T.StructField("error", T.StringType()),
    ])
    return docs.select(doc, content).mapInPandas(decode, schema)


def parse_documents(docs: DataFrame, *, extractor: Callable[[bytes], Iterable[tuple[int, str]]],
                    doc: str = "contract_id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """File contents to tagged chunks, and the files that failed with their errors."""
    decoded = extract_blocks(docs, extractor=extractor, doc=doc, content=content)
    good = decoded.filter(F.col("error").isNull())
    return chunk_documents(good, doc=doc), decoded.filter(F.col("error").isNotNull()).select(doc, "error")


# --- cover page ------------------------------------------------------------------

COVER_LABELS = {
    "asset": "Asset",
    "seller": "Seller",
    "buyer": "Buyer",
    "delivery_point": "Delivery Point",
    "strike_price": "Strike Price",
    "contract_volume": "Contract Volume",
    "tenor": "Tenor",
    "start_date": "Start Date",
}


def contract_metadata(covers: DataFrame, *, doc: str = "contract_id", text: str = "cover_text") -> DataFrame:
    """Header fields from ``Label: value`` lines; numbers are parsed where the label holds one."""
    def value(label: str) -> Column:
        return F.nullif(X.strip(F.regexp_extract(text, rf"(?m)^{label}:[ \t]*([^\n]*)$", 1)), F.lit(""))

    def number(label: str) -> Column:
        return F.regexp_extract(F.coalesce(value(label), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")

    kind = F.nullif(F.lower(F.regexp_extract(text, r"\((PHYSICAL|VIRTUAL|SLEEVED) PPA\)", 1)), F.lit(""))
    return covers.select(
        doc,
        kind.alias("ppa_type"),
        *[value(COVER_LABELS[c]).alias(c) for c in ("asset", "seller", "buyer", "delivery_point")],
        number(COVER_LABELS["strike_price"]).alias("strike_price_eur"),
        number(COVER_LABELS["contract_volume"]).alias("volume_mw"),
        number(COVER_LABELS["tenor"]).cast("int").alias("tenor_years"),
        F.to_date(F.try_to_timestamp(value(COVER_LABELS["start_date"]), F.lit("d MMMM yyyy"))).alias("start_date"),
    )

"""Text expressions: tokens, headings, risk tags and phrase tests.

Words, digits and blanks are the Unicode notions, so the character classes are
spelled out instead of relying on the engine's ASCII shorthands.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V

BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
BLANKS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Blank-separated words in order; empty array for blank text."""
    return F.array_remove(F.split(text, BLANK + "+"), "")


def token_set(text: Column) -> Column:
    """Distinct lower-cased blank-separated words (punctuation stays on the word)."""
    return F.array_distinct(words(F.lower(text)))


def joined_token_set(text: Column) -> Column:
    """The same of words that single spaces join, as in a chunk: split at a character, without a pattern."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), " ")), "")


def word_set(text: Column) -> Column:
    """Distinct lower-cased runs of word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), F.lit(1)))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of the words of ``b`` also found in ``a``; 0 where ``b`` has none."""
    wb = word_set(b)
    return F.when(F.size(wb) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(word_set(a), wb)) / F.size(wb)
    )


def contains_any(text: Column, phrases: list[str]) -> Column:
    """True if the lower-cased text holds any of the phrases; NULL text gives false."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: _any_in(low, phrases))


def _any_in(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(low, F.lit(p)) for p in phrases])


def has_floor(text: Column, phrases=V.FLOOR_PHRASES, negations=V.FLOOR_NEGATIONS) -> Column:
    """A price floor is granted: some floor phrase and no negated one."""
    return let(
        F.lower(F.coalesce(text, F.lit(""))), lambda low: _any_in(low, phrases) & ~_any_in(low, negations)
    )


def has_floor_simple(text: Column) -> Column:
    return contains_any(text, V.FLOOR_WORDS)


def no_compensation(text: Column) -> Column:
    return contains_any(text, V.NO_COMPENSATION_PHRASES)


# --- headings ---------------------------------------------------------------

_HEADINGS = [p.replace("{WS}", BLANK) for p in V.HEADING_PATTERNS]


def detect_clause(text: Column) -> Column:
    """Clause number and title of a heading, as a struct; NULL if the first line is no heading."""
    return let(strip(F.element_at(F.split(text, "\n"), 1)), lambda line: F.when(_may_open(line), _heading(line)))


def _may_open(line: Column) -> Column:
    # Headings start with one of A, S, a bracket or a digit; most lines are
    # settled by their first character.  Letters beyond ASCII go on to the patterns.
    first = F.ascii(line)
    return first.isin(*[ord(c) for c in "(AaSs"]) | first.between(ord("0"), ord("9")) | (first > 127)


def _heading(line: Column) -> Column:
    found = None
    for pattern in _HEADINGS:
        whole = F.regexp_extract(line, pattern, 0)
        rest = F.btrim(F.substring(line, F.length(whole) + 1, F.length(line)), F.lit(V.TITLE_TRIM))
        clause = strip(F.regexp_extract(line, pattern, 1))
        value = F.struct(
            clause.alias("clause_id"),
            F.when(rest != "", rest).otherwise(clause).alias("section_title"),
        )
        matched = F.rlike(line, F.lit(pattern))
        found = F.when(matched, value) if found is None else found.when(matched, value)
    return found


# --- risk tags ---------------------------------------------------------------


def _whole(term: str) -> str:
    """The pattern of a term as whole words: it is looked for as it stands, what is around it is tested where it was found."""
    return rf"\Q{term}\E(?<!{WORD}\Q{term}\E)(?!{WORD})"


def _mentions(low: Column, term: str) -> Column:
    """Whether the term stands in the lower-cased text as whole words; most texts are settled by not holding it at all."""
    return F.contains(low, F.lit(term)) & F.rlike(low, F.lit(_whole(term)))


def _in_category(low: Column, rule: dict[str, list[str]]) -> Column:
    primary = reduce(lambda x, y: x | y, [_mentions(low, t.lower()) for t in rule["primary"]])
    hits = reduce(lambda x, y: x + y, [_mentions(low, t.lower()).cast("int") for t in rule["secondary"]])
    return primary | (hits >= V.SECONDARY_HITS_NEEDED)


def _categories(low: Column, taxonomy: dict) -> list[Column]:
    return [F.when(_in_category(low, rule), F.lit(cat)) for cat, rule in taxonomy.items()]


def _lowered(text: Column, body: Callable[[Column], Column]) -> Column:
    # Lower case, and the long s counts as an s in case-insensitive matching.
    # Replaced as a string: a translation looks each character up.
    return let(F.replace(F.lower(text), F.lit("ſ"), F.lit("s")), body)


def tag_chunk(text: Column, taxonomy: dict = V.RISK_TAXONOMY) -> Column:
    """First risk category, in priority order, whose terms the text mentions; NULL if none."""
    return _lowered(text, lambda low: F.coalesce(*_categories(low, taxonomy)))


def tag_all(text: Column, taxonomy: dict = V.RISK_TAXONOMY) -> Column:
    """All matching risk categories in priority order."""
    return _lowered(text, lambda low: F.array_compact(F.array(*_categories(low, taxonomy))))


def register_tag_text(spark) -> None:
    """Make ``tag_text(string)`` callable from SQL; its body is the same built-in expression."""
    def mention(term: str) -> str:
        quoted, pattern = (t.replace("\\", "\\\\").replace("'", "\\'") for t in (term.lower(), _whole(term.lower())))
        return f"(contains(low, '{quoted}') AND low RLIKE '{pattern}')"

    branches = []
    for cat, rule in V.RISK_TAXONOMY.items():
        primary = " OR ".join(mention(t) for t in rule["primary"])
        hits = " + ".join(f"CAST({mention(t)} AS INT)" for t in rule["secondary"])
        branches.append(f"WHEN {primary} OR ({hits}) >= {V.SECONDARY_HITS_NEEDED} THEN '{cat}'")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tag_text(body STRING) RETURNS STRING RETURN "
        f"transform(array(replace(lower(body), 'ſ', 's')), low -> CASE {' '.join(branches)} END)[0]"
    )


def title_case_category(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def contract_id_from_name(name: Column) -> Column:
    """File name to contract id; NULL if the file is no PDF."""
    stem = F.lower(F.replace(name, F.lit(".pdf"), F.lit("")))
    return F.when(F.endswith(name, F.lit(".pdf")), F.replace(stem, F.lit(" "), F.lit("-")))


def flag_id(contract_id: Column, clause_id: Column, category: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", contract_id, clause_id, category)), 1, 12)


def chunk_id(contract_id: Column, clause_id: Column, position: Column, section: Column | None = None) -> Column:
    """Stable id of a word window.

    Clause numbers repeat within a contract (roman sub-clauses), so the ordinal
    of the section is part of the key; leave ``section`` out for the legacy ids,
    which may collide.
    """
    parts = [contract_id] + ([] if section is None else [section.cast("string")])
    return F.substring(F.md5(F.concat_ws(":", *parts, clause_id, position.cast("string"))), 1, 16)

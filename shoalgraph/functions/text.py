"""Text expressions with the semantics of Unicode-aware trimming, built from Catalyst functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoalgraph import literals

#: Unicode white space and the four ASCII separators go; zero-width characters and byte-order marks stay.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def na_to_null(c: Column) -> Column:
    """Null for the exact texts that a CSV reader takes for missing."""
    return F.when(~c.isin(literals.NA_TOKENS), c)


def any_of(c: Column, words: list[str]) -> Column:
    """Whether c contains one of the words; one regular expression keeps generated code small."""
    return c.rlike("|".join(words))


def ends_with(c: Column, endings: list[str]) -> Column:
    return c.rlike(f"(?:{'|'.join(endings)})\\z")


def relation(c: Column) -> Column:
    """The relation in upper case, "" for an unknown one or null."""
    name = F.upper(strip(c))
    return F.when(name.isin([r for r, _ in literals.RELATIONS]), name).otherwise("")


def label(c: Column) -> Column:
    return F.when(c.isin(literals.LABELS), c).otherwise("Entity")


def not_blank(c: Column) -> Column:
    return F.length(strip(c)) > 0


def chunked(c: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of at most ``size`` code points that start every ``size - overlap``; none for an empty text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.when(F.length(c) > 0, F.transform(starts, lambda s: F.substring(c, s, F.lit(size)))).otherwise(F.array().cast("array<string>"))

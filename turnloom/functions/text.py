"""String functions on whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom import fixed


def clean(text: Column) -> Column:
    """Collapse whitespace runs to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){fixed.SPACE}+", " "))


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends only."""
    return F.regexp_replace(text, rf"(?U)\A{fixed.SPACE}+|{fixed.SPACE}+\z", "")


def normalize(text: Column) -> Column:
    """Straighten typographic punctuation, then clean."""
    plain = F.translate(text, fixed.PUNCT_FROM, fixed.PUNCT_TO)
    return clean(F.replace(plain, F.lit(fixed.ELLIPSIS[0]), F.lit(fixed.ELLIPSIS[1])))


def words_of_clean(cleaned: Column) -> Column:
    """Word count of text that went through :func:`clean` already.

    Counts the separators instead of splitting, so no array is built, and
    branches nowhere, so generated code computes ``cleaned`` once.
    """
    gaps = F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit("")))
    return gaps + (cleaned != "").cast("int")


def word_count(text: Column) -> Column:
    """Whitespace word count in one pass; blank text has no words."""
    return F.regexp_count(text, F.lit(fixed.WORD_PATTERN))


def is_blank(text: Column) -> Column:
    return F.coalesce(clean(text) == "", F.lit(True))


def is_junk(cleaned: Column) -> Column:
    """The whole text is one filler word or phrase."""
    return cleaned.rlike(fixed.JUNK_PATTERN)


def points_at_picture(cleaned: Column) -> Column:
    """The text leans on something only visible on screen."""
    return cleaned.rlike(fixed.POINTING_PATTERN)


def leaked_speaker(text: Column, cast: Sequence[str] = fixed.CAST) -> Column:
    """The text opens with the name of a known speaker and a colon."""
    name = F.lower(F.trim(F.regexp_extract(text, fixed.SPEAKER_PREFIX_PATTERN, 1)))
    return F.coalesce(name.isin(*cast), F.lit(False))


def has_phrase(text: Column, phrase: str) -> Column:
    """Case-insensitive substring test; ``phrase`` is given in lower case."""
    return F.contains(F.lower(text), F.lit(phrase))


def role_of(is_target: Column) -> Column:
    return F.when(is_target, F.lit("assistant")).otherwise(F.lit("user"))


def canonical_url(href: Column) -> Column:
    """Drop the fragment and end in exactly one slash; the query string stays."""
    return F.concat(F.regexp_replace(F.split_part(href, F.lit("#"), F.lit(1)), "/+$", ""), F.lit("/"))


def percent_label(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value)


def signed_label(value: Column, digits: int) -> Column:
    return F.format_string(f"%+.{digits}f", value)

"""Text and line expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lintlake.catalog import maps as M
from lintlake.functions.lookup import literal_array


def lines(content: Column) -> Column:
    """The pieces of a text between newlines, the empty one after a final newline included."""
    return F.split(content, "\n")


def loc(content: Column) -> Column:
    """Lines of a text as an editor counts them: 0 for an empty one, none for a final newline."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return breaks + F.when((content == "") | content.endswith("\n"), 0).otherwise(1)


def real_lines(content: Column) -> Column:
    """The lines of a text; a final newline adds none, an empty text has none."""
    whole = F.when(content.endswith("\n"), F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content)
    return F.when(content != "", F.split(whole, "\n")).otherwise(F.array().cast("array<string>"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pattern_text(text: Column) -> Column:
    """Normal form for family keys: lower case, no back-ticked parts, no lone numbers."""
    plain = F.regexp_replace(F.lower(text), r"`[^`]+`", " ")
    plain = F.regexp_replace(plain, r"[^a-z0-9]+", " ")
    return squeeze(F.regexp_replace(plain, r"\b\d+\b", " "))


def family_key(*fields: Column) -> Column:
    """First field whose normal form is not empty, else ''.

    Each normal form is written once.  One that is written twice, to be compared and to be returned, is made beforehand for
    every row and field, wanted or not."""
    return F.coalesce(*[F.get(F.filter(F.array(pattern_text(f)), lambda t: t != ""), 0) for f in fields], F.lit(""))


def variant_key(*fields: Column, fallback: Column) -> Column:
    """First non-blank field, letters and digits of any script only."""
    def words(text):
        return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))

    picked = F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields])
    return F.when(picked.isNotNull(), words(picked)).otherwise(words(fallback))


def word_set(text: Column) -> Column:
    """Distinct lower-case words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def content_words(text: Column) -> Column:
    """Distinct lower-case words without stop words."""
    return F.array_except(word_set(text), literal_array(M.STOP_WORDS))


def code_names(text: Column) -> Column:
    """Names a description quotes: back-ticked parts and names followed by a parenthesis."""
    ticked = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"`([^`]+)`"), 1)
    called = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_]\w*)\("), 1)
    return F.array_sort(F.array_distinct(F.concat(ticked, called)))


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def slug(text: Column) -> Column:
    """Anchor form: letters and digits, everything else one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, 0 when there is no whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def density(count: Column, loc_: Column) -> Column:
    """Findings per thousand lines, at least a tenth of a thousand; 0 without lines."""
    kloc = F.greatest(loc_ / 1000.0, F.lit(0.1))
    return F.when(loc_ > 0, F.round(count / kloc, 1)).otherwise(F.lit(0.0))


def parsed_count(text: Column) -> Column:
    """'1,690' -> 1690."""
    return F.regexp_replace(text, ",", "").try_cast("long")

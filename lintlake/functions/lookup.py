"""Small constant tables as literal expressions: no join, no broadcast.

Wide expressions are handed to Spark as one SQL text each; building them column call by
column call costs more than many a query."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def quoted(value) -> str:
    """A value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(mapping: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in mapping.items()) + ")")


def literal_array(values) -> Column:
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """``mapping[key]``, or ``default`` (a value or a column) when the key is missing or null."""
    found = literal_map(mapping)[key]
    return found if default is None else F.coalesce(found, _col(default))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def first_match(cases, default) -> Column:
    """The value of the first true condition; ``cases`` is a list of (condition, value)."""
    chosen = None
    for condition, value in cases:
        chosen = F.when(condition, _col(value)) if chosen is None else chosen.when(condition, _col(value))
    return _col(default) if chosen is None else chosen.otherwise(_col(default))


def either(texts) -> str:
    """A regular expression for any one of the texts."""
    return "(?:" + "|".join(re.sub(r"([^\w\s/@])", r"\\\1", t) for t in texts) + ")"


def contains_any(text: Column, fragments) -> Column:
    """True when the text holds one of the fragments."""
    return text.rlike(either(fragments)) if fragments else F.lit(False)


def starts_with_any(text: Column, prefixes) -> Column:
    return text.rlike("^" + either(prefixes)) if prefixes else F.lit(False)


def ends_with_any(text: Column, suffixes) -> Column:
    return text.rlike(either(suffixes) + r"\z") if suffixes else F.lit(False)

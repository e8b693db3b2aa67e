"""A cheap test before a regular expression.

``rlike`` decodes the line to a Java string for every rule tried.  Most rules need some
fixed piece of text to be there; looking for that piece works on the raw bytes and rules
nearly every line out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column


def needed_text(pattern: str) -> str:
    """The longest piece of text every match must contain, '' when there is none.

    Only the top level of the pattern is looked at: a piece inside a choice or an optional
    part is not needed by every match."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, AttributeError):
        return ""
    if tree.state.flags & re.IGNORECASE:
        return ""
    pieces, run = [], ""
    for kind, value in tree:
        if str(kind) == "LITERAL":
            run += chr(value)
        else:
            pieces.append(run)
            run = ""
    return max([*pieces, run], key=len)


def guarded(text: Column, pattern: str) -> Column:
    """``text rlike pattern``, behind a search for the text it needs."""
    needed = needed_text(pattern)
    return text.contains(needed) & text.rlike(pattern) if needed else text.rlike(pattern)

"""Which patterns a text can hold at all.

Most patterns of a document need a digit, most documents have none, and every gate read the whole text.  So
one pass looks for a digit, and where there is none those gates are not tried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column

_UNSURE = r"&&|\\v|\(\?[a-zA-Z]*[ux]|\[[^\]]*(?<!\\)\[|\\[pP]"  # read differently by Java and Python


def _digit(parsed) -> bool:
    """Whether every match of a parsed pattern has a digit."""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL" and chr(arg) in "0123456789":
            return True
        if kind == "IN" and all((str(w) == "CATEGORY" and str(x) == "CATEGORY_DIGIT") or (str(w) == "RANGE" and 48 <= x[0] <= x[1] <= 57) or (str(w) == "LITERAL" and 48 <= x <= 57) for w, x in arg):
            return True
        if kind == "BRANCH" and all(map(_digit, arg[1])):
            return True
        if kind == "SUBPATTERN" and _digit(arg[3]):
            return True
        if kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] and _digit(arg[2]):
            return True
    return False


@lru_cache(4096)
def needs_digit(pattern: str) -> bool:
    """Whether every match has one of 0 to 9, as far as can be told."""
    if re.search(_UNSURE, pattern):
        return False
    try:
        return _digit(re._parser.parse(pattern))
    except (ValueError, re.error, RecursionError):
        return False


@dataclass(frozen=True)
class Cues:
    """The column that tells whether a text has a digit."""

    name: str

    def test(self, *patterns: str) -> str:
        """A condition in SQL, with its AND, that holds wherever all the patterns match; empty if none is known."""
        return f"`{self.name}` AND " if any(map(needs_digit, patterns)) else ""


def digits(folded: Column) -> Column:
    """What :class:`Cues` read: of the fold, which keeps the text's own digits."""
    return folded.rlike("[0-9]")

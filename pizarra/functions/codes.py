"""Establishment-code expressions (``DD-MM-NNNN-SS``).

All are built-in Spark expressions: plain string functions for the repair and
the municipality, ``split`` where a segment in the middle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionary import SEGMENT_LEVEL, label_map

# Characters a Python ``str.strip()`` removes (``str.isspace``). Spark's
# ``trim`` only removes blanks and Java's ``\s`` is ASCII-only, so the set is
# spelled out to make tabs, NBSP and the Unicode spaces behave the same way.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalise_code(col: Column | str) -> Column:
    """null -> null; text; strip surrounding whitespace; leading ``00-`` -> ``01-``.

    The ``00-`` prefix is a capital-city defect of department 1; the repair is
    applied to every row, as the batch it mirrors does.
    """
    trimmed = F.btrim(_c(col).cast("string"), F.lit(WHITESPACE))
    return F.when(F.startswith(trimmed, F.lit("00-")), F.concat(F.lit("01-"), F.substr(trimmed, F.lit(4)))).otherwise(trimmed)


def municipality(code: Column | str) -> Column:
    """First two ``-`` segments of a (normalised) code; null with < 2 segments."""
    c = _c(code)
    return F.when(F.contains(c, F.lit("-")), F.substring_index(c, "-", 2))


def code_segment(code: Column | str, i: int) -> Column:
    """1-based segment ``i`` of the code, null when absent."""
    return F.get(F.split(_c(code), "-", -1), i - 1)


def segment_level(code: Column | str) -> Column:
    """Level code implied by the 4th segment (40/41/42 pre-primary, ... 46)."""
    items = []
    for seg, lvl in SEGMENT_LEVEL.items():
        items += [F.lit(seg), F.lit(lvl).cast("int")]
    return F.create_map(*items)[code_segment(code, 4)]


__all__ = ["normalise_code", "municipality", "code_segment", "segment_level", "WHITESPACE", "label_map"]

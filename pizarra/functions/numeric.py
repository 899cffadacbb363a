"""Rates, rounding and number formatting as Spark expressions.

Rounding follows numpy/pandas ``round(1)``: scale by 10, round half to even
(``rint``), scale back. Spark's ``round`` is half-up (0.25 -> 0.3 where numpy
gives 0.2), so it is never used for rates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import per_context


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round1(x: Column | str) -> Column:
    """Round half to even to one decimal."""
    return F.rint(_c(x) * 10) / 10


@per_context
def rate(n: Column | str, total: Column | str) -> Column:
    """``n / total * 100`` rounded to one decimal; null (not an error) on total 0."""
    return round1(F.try_divide(_c(n), _c(total)) * 100)


def truncated_estimate(total: Column | str, rate_col: Column | str) -> Column:
    """``int(total * rate / 100)`` from the *rounded* rate (an estimate, not a count)."""
    return (_c(total) * _c(rate_col) / 100).cast("bigint")


def thousands(n: Column | str) -> Column:
    """``1234567`` -> ``'1,234,567'``."""
    return F.format_string("%,d", _c(n))


def one_decimal(x: Column | str) -> Column:
    return F.format_string("%.1f", _c(x))


def signed_one_decimal(x: Column | str) -> Column:
    return F.format_string("%+.1f", _c(x))

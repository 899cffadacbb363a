"""Distinct counts by mergeable sketches, as an option where exact ones are too dear.

An exact distinct count has to see the values again for every grouping; a
HyperLogLog sketch per cell of a cube is a few kilobytes, and the count of any
roll-up is that of the union of its cells' sketches, which has the registers that the
rows themselves would have given. The relative standard error is at most
``1.04 / sqrt(2 ** lg_k)`` (``error_bound`` gives three of them) and small counts are
exact or nearly so. The exact counts of ``operators.quality`` stay the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def error_bound(lg_k: int = LG_K) -> float:
    """Relative error that 99.7 % of estimates stay within."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def sketch_cube(df: DataFrame, dims: Sequence[str], values: dict[str, Column], lg_k: int = LG_K) -> DataFrame:
    """Per combination of ``dims``: n (rows) and a sketch of each of ``values``. Null
    values are not counted. Sketches are made map-side: a group with a third of all
    rows is one sketch per task."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), *(F.hll_sketch_agg(v, F.lit(lg_k)).alias(name) for name, v in values.items()))


def roll_up(cube: DataFrame, dims: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The cube of fewer dimensions; it can be rolled up again."""
    return cube.groupBy(*dims).agg(F.sum("n").alias("n"), *(F.hll_union_agg(v).alias(v) for v in values))


def estimates(cube: DataFrame, values: Sequence[str]) -> DataFrame:
    """The cube with distinct counts in place of its sketches."""
    return cube.select(*(F.hll_sketch_estimate(c).alias(c) if c in values else F.col(c) for c in cube.columns))

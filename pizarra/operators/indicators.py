"""Outcome aggregates: national indicators, shares, grouped outcome tables.

Every function takes a *decoded* enrolment frame and works unchanged on the
pre-aggregated ``outcome_cube`` (pass ``weight="n"``): counts become sums of
the weight. That is what lets one scan feed every output of an analytics
run (``plans.pipeline``).

Scale: each grouped aggregate is a partial (map-side) hash aggregate followed
by a final aggregate after a shuffle whose size is bounded by the number of
groups (code domains), not by rows; a hot department holding a third of all
rows is absorbed by the partial aggregation. Windows only ever run over such
aggregated results.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dictionary import DROPPED_OUT, NOT_PROMOTED, PROMOTED
from ..functions.columns import per_context
from ..functions.numeric import rate

RESULT = "resultado"
# Dimensions of the outcome cube (decoded label columns).
CUBE_DIMS = ["departamento", "area", "sector", "sexo", "nivel", "pueblo", RESULT]
GAP_DIMS = ["area", "sector", "pueblo", "nivel"]
SHARE_DIMS = ["nivel", "area", "sector", "sexo"]


def _count_where(pred: Column, weight: str | None) -> Column:
    if weight is None:
        return F.count_if(pred)
    return F.coalesce(F.sum(F.when(pred, F.col(weight))), F.lit(0)).cast("bigint")


def _rows(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")


def _non_null(col: str, weight: str | None) -> Column:
    return F.count(col) if weight is None else _count_where(F.col(col).isNotNull(), weight)


@per_context
def outcome_counts(
    weight: str | None = None,
    result: str = RESULT,
    with_not_promoted: bool = True,
    total: str = "non_null",
) -> tuple[Column, ...]:
    """``total, promovidos, [no_promovidos,] retirados`` aggregate columns.

    ``total="non_null"`` counts non-null outcomes (grouped tables);
    ``total="rows"`` counts rows (national figure)."""
    r = F.col(result)
    cols = [
        (_non_null(result, weight) if total == "non_null" else _rows(weight)).alias("total"),
        _count_where(r.isin(*PROMOTED), weight).alias("promovidos"),
    ]
    if with_not_promoted:
        cols.append(_count_where(r.isin(*NOT_PROMOTED), weight).alias("no_promovidos"))
    cols.append(_count_where(r.isin(*DROPPED_OUT), weight).alias("retirados"))
    return tuple(cols)


def with_rates(df: DataFrame, with_not_promoted: bool = True) -> DataFrame:
    rates = {"tasa_promocion": rate("promovidos", "total")}
    if with_not_promoted:
        rates["tasa_no_promocion"] = rate("no_promovidos", "total")
    rates["tasa_retiro"] = rate("retirados", "total")
    return df.withColumns(rates)


def national_indicators(df: DataFrame, weight: str | None = None, result: str = RESULT) -> DataFrame:
    """A1-A3: one row; rates over the *row* count (Vigente, Ignorado and
    Desconocido stay in the denominator, so rates need not sum to 100)."""
    agg = df.agg(*outcome_counts(weight, result, total="rows"))
    return with_rates(agg)


def share(df: DataFrame, dim: str, weight: str | None = None) -> DataFrame:
    """A4: ``(dim, n, pct)`` — share of each non-null label, by descending count.
    ``dim`` is a code column: one task sees a row per label, so this is not for
    columns with unbounded values."""
    counts = df.groupBy(dim).agg(_rows(weight).alias("n")).where(F.col(dim).isNotNull())
    grand = Window.partitionBy()  # over the (tiny) aggregated result only
    return counts.withColumn("pct", rate(F.col("n"), F.sum("n").over(grand))).orderBy(F.desc("n"), dim)


def shares_all(df: DataFrame, dims: Sequence[str] = SHARE_DIMS, weight: str | None = None) -> DataFrame:
    """A4 for several dimensions in one pass: long ``(dimension, label, n, pct)``.

    Pre-aggregates on the dimension combination first so the grouping-sets
    expansion multiplies groups, never raw rows."""
    dims = list(dims)
    pre = df.groupBy(*dims).agg(_rows(weight).alias("n"))
    sets = [[F.col(d)] for d in dims]
    g = pre.groupingSets(sets, *dims).agg(
        F.sum("n").cast("bigint").alias("n"), *[F.grouping(d).alias(f"__g_{d}") for d in dims]
    )
    dimension = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.lit(d)) for d in dims])
    label = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.col(d)) for d in dims])
    long = g.select(dimension.alias("dimension"), label.alias("label"), "n").where(F.col("label").isNotNull())
    per_dim = Window.partitionBy("dimension")
    return long.withColumn("pct", rate(F.col("n"), F.sum("n").over(per_dim)))


def outcome_by(
    df: DataFrame,
    dims: str | Sequence[str],
    weight: str | None = None,
    with_not_promoted: bool = False,
    result: str = RESULT,
    ordered: bool = True,
) -> DataFrame:
    """A8 (and A5 with ``with_not_promoted``): per-group totals and rates;
    null group keys are dropped; output ordered by the keys (``ordered=False``
    for internal consumers that order inside an aggregate anyway: a global
    sort adds a range-partitioning exchange and a sampling job)."""
    dims = [dims] if isinstance(dims, str) else list(dims)
    # Catalyst may push this filter on the keys below the aggregate
    agg = df.groupBy(*dims).agg(*outcome_counts(weight, result, with_not_promoted))
    agg = agg.where(functools.reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in dims]))
    out = with_rates(agg, with_not_promoted)
    return out.orderBy(*dims) if ordered else out


def department_summary(df: DataFrame, weight: str | None = None, dim: str = "departamento", ordered: bool = True) -> DataFrame:
    """A5 + A6: the department table, by descending dropout rate (ties by name)."""
    out = outcome_by(df, dim, weight, with_not_promoted=True, ordered=False)
    return out.orderBy(F.desc("tasa_retiro"), dim) if ordered else out


def gap_table(df: DataFrame, dim: str, weight: str | None = None, ordered: bool = True) -> DataFrame:
    """A8 for one dimension (``area``, ``sector``, ``pueblo``, ``nivel``)."""
    return outcome_by(df, dim, weight, ordered=ordered)


def gap_all(df: DataFrame, dims: Sequence[str] = GAP_DIMS, weight: str | None = None, ordered: bool = True) -> DataFrame:
    """All gap tables from one pass, long ``(dimension, label, ...)``.

    One partial aggregate over the dimension combination, then a grouping-sets
    roll-up of that small result."""
    dims = list(dims)
    r = F.col(RESULT)
    pre = df.groupBy(*dims).agg(
        _non_null(RESULT, weight).alias("t"),
        _count_where(r.isin(*PROMOTED), weight).alias("p"),
        _count_where(r.isin(*DROPPED_OUT), weight).alias("d"),
    )
    g = pre.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.sum("t").cast("bigint").alias("total"),
        F.sum("p").cast("bigint").alias("promovidos"),
        F.sum("d").cast("bigint").alias("retirados"),
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
    )
    dimension = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.lit(d)) for d in dims])
    label = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.col(d)) for d in dims])
    long = g.select(dimension.alias("dimension"), label.alias("label"), "total", "promovidos", "retirados")
    out = with_rates(long.where(F.col("label").isNotNull()), with_not_promoted=False)
    return out.orderBy("dimension", "label") if ordered else out


FIGURE_DIMS = ["departamento", "area", "sector", "sexo", "nivel", "pueblo"]
NATIONAL = "nacional"
TOTAL_LABEL = "Total"


def figures(df: DataFrame, weight: str | None = None, dims: Sequence[str] = FIGURE_DIMS) -> DataFrame:
    """Every published figure from ONE pass: long rows ``(dimension, label)``
    with counts, rates, the share of rows within the dimension and the year,
    plus the national row (``nacional``, ``Total``), whose rates divide by the
    row count; all others divide by the non-null outcomes.

    The rows are pre-aggregated on the dimension combination (bounded by the
    code domains), so the grouping sets multiply groups, never input rows. The
    result has one row per label: well under a hundred."""
    dims = list(dims)
    year = F.max("anio") if "anio" in df.columns else F.lit(None).cast("int")
    pre = df.groupBy(*dims).agg(_rows(weight).alias("filas"), *outcome_counts(weight), year.alias("anio"))
    counts = ["filas", "total", "promovidos", "no_promovidos", "retirados"]
    g = pre.groupingSets([[], *([F.col(d)] for d in dims)], *dims).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in counts],
        F.max("anio").alias("anio"),
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
    )
    one = [F.col(f"__g_{d}") == 0 for d in dims]
    dimension = F.coalesce(*[F.when(x, F.lit(d)) for x, d in zip(one, dims)], F.lit(NATIONAL))
    label = F.coalesce(*[F.when(x, F.col(d)) for x, d in zip(one, dims)], F.when(functools.reduce(lambda a, b: a & b, [~x for x in one]), F.lit(TOTAL_LABEL)))
    long = g.select(dimension.alias("dimension"), label.alias("label"), *counts, "anio").where(F.col("label").isNotNull())
    long = long.withColumn("total", F.when(F.col("dimension") == NATIONAL, F.col("filas")).otherwise(F.col("total")))
    share = rate(F.col("filas"), F.sum("filas").over(Window.partitionBy("dimension")))  # over these few rows
    return with_rates(long).withColumn("pct", share)


def outcome_cube(df: DataFrame, dims: Sequence[str] = CUBE_DIMS) -> DataFrame:
    """A10: enrolment counts per combination of the analysed dimensions.

    Bounded by the product of the code domains (about 690k cells with
    ``Desconocido``), independent of row count; every indicator of a run is a
    roll-up of it (pass ``weight="n"``)."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))


def count_semantics(raw: DataFrame, dim: str = "departamento_f", result: str = "resultado_f") -> DataFrame:
    """Per group, row count vs non-null outcome count on *raw* codes
    (they differ exactly by the null outcomes; after decode they coincide)."""
    return (
        raw.where(F.col(dim).isNotNull())
        .groupBy(dim)
        .agg(F.count(F.lit(1)).alias("filas"), F.count(result).alias("total_resultado"))
        .withColumn("sin_resultado", F.col("filas") - F.col("total_resultado"))
        .orderBy(dim)
    )

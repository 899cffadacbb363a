"""Sorts, top-k, row selection and reshapes over *aggregated* outcome tables.

Inputs here are group-level tables (departments, levels, peoples), whose size
is bounded by the code domains; the global windows below (``row_number`` over
an unpartitioned window) therefore only ever see a few dozen rows. Top-k is
``orderBy().limit(k)``, which Spark plans as ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dictionary import IGNORED, UNKNOWN

RATE_LABELS = {"tasa_promocion": "% Promoción", "tasa_retiro": "% Retiro"}


def ranked(df: DataFrame, by: str, label: str, descending: bool = True, name: str = "posicion") -> DataFrame:
    """Adds a 1-based position by ``by`` (ties broken by ``label``). For result
    tables with a row per label: a position over all rows is one task's work."""
    order = [F.desc(by) if descending else F.asc(by), F.asc(label)]
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint")).orderBy(name)


def top_k(df: DataFrame, by: str, label: str, k: int, descending: bool = True) -> DataFrame:
    """The ``k`` first rows by ``by`` with a deterministic tie-break."""
    order = [F.desc(by) if descending else F.asc(by), F.asc(label)]
    return df.orderBy(*order).limit(k)


def drop_unknown(df: DataFrame, col: str, labels: Sequence[str] = (IGNORED, UNKNOWN)) -> DataFrame:
    """remove ``Ignorado`` / ``Desconocido`` groups."""
    return df.where(~F.col(col).isin(*labels))


def worst(df: DataFrame, label: str, by: str = "tasa_retiro") -> DataFrame:
    """T4: arg-max of ``by`` after dropping unknown groups (0 or 1 row)."""
    return top_k(drop_unknown(df, label), by, label, 1)


def display_table(df: DataFrame, label: str, display: str) -> DataFrame:
    """Projection + rename for display."""
    return df.select(
        F.col(label).alias(display),
        F.col("tasa_promocion").alias(RATE_LABELS["tasa_promocion"]),
        F.col("tasa_retiro").alias(RATE_LABELS["tasa_retiro"]),
    )


def unpivot_rates(df: DataFrame, label: str, values: Sequence[str] = ("tasa_promocion", "tasa_retiro")) -> DataFrame:
    """P4 + P5: long ``(label, Indicador, Porcentaje)``, measure names relabelled."""
    long = df.unpivot([label], list(values), "Indicador", "Porcentaje")
    relabel = F.create_map(*[x for k, v in RATE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return long.withColumn("Indicador", F.coalesce(relabel[F.col("Indicador")], F.col("Indicador")))


def axis_ceiling(long: DataFrame, value: str = "Porcentaje", factor: float = 1.2) -> DataFrame:
    """Chart axis upper bound, ``max(value) * factor``."""
    return long.agg((F.max(value) * factor).alias("techo"))

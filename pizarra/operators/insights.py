"""Comparisons against the national figure, severity classes and written
insights — all as column expressions over aggregated tables (never a
driver-side loop over rows).

The national reference value is produced by the *same* aggregate as the
groups (``rollup``: the grand-total row), then attached with a window over
the few aggregated rows, so no cross join and no second scan is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dictionary import IGNORED, UNKNOWN
from ..functions.numeric import one_decimal, rate, signed_one_decimal, thousands, truncated_estimate
from . import indicators as ind

# ---------------------------------------------------------------------------
# FIXED VALUES: severity thresholds (points of dropout rate vs the national
# rate), evaluated in this order: >= 2 critical, >= 0.5 above average,
# <= -2 better than average, otherwise near average.
CRITICAL_AT = 2.0
ABOVE_AT = 0.5
BETTER_AT = -2.0
# ---------------------------------------------------------------------------

CLASS_CRITICAL = "crítica"
CLASS_ABOVE = "sobre el promedio"
CLASS_BETTER = "mejor que el promedio"
CLASS_NEAR = "cerca del promedio"

ADVICE = {
    CLASS_CRITICAL: "El retiro supera al del país en dos puntos o más: este departamento va primero en la lista.",
    CLASS_ABOVE: "El retiro supera al del país en medio punto o más.",
    CLASS_BETTER: "El retiro queda dos puntos o más por debajo del país.",
    CLASS_NEAR: "El retiro se parece al del país.",
}


def severity_class(diff: Column | str) -> Column:
    """Class of a (raw float) difference; a null difference is 'near'."""
    d = F.col(diff) if isinstance(diff, str) else diff
    return (
        F.when(d >= CRITICAL_AT, F.lit(CLASS_CRITICAL))
        .when(d >= ABOVE_AT, F.lit(CLASS_ABOVE))
        .when(d <= BETTER_AT, F.lit(CLASS_BETTER))
        .otherwise(F.lit(CLASS_NEAR))
    )


def vs_national(df: DataFrame, dim: str = "departamento", weight: str | None = None) -> DataFrame:
    """Per group ``total, retirados, tasa_retiro, promedio_nacional, diferencia``.

    ``diferencia`` subtracts the two *rounded* rates (float difference kept raw).
    ``dim`` is a code column: the window over the totals holds a row per label.
    The national rate divides by the row count, the group rates by the
    non-null outcome count, both from the same ``rollup`` aggregate."""
    agg = df.rollup(dim).agg(
        ind._rows(weight).alias("_filas"),
        *ind.outcome_counts(weight, with_not_promoted=True),
        F.grouping(dim).alias("_g"),
    )
    national = F.max(F.when(F.col("_g") == 1, rate("retirados", "_filas"))).over(Window.partitionBy())
    out = (
        agg.withColumn("promedio_nacional", national)
        .where((F.col("_g") == 0) & F.col(dim).isNotNull())
        .withColumn("tasa_retiro", rate("retirados", "total"))
        .withColumn("diferencia", F.col("tasa_retiro") - F.col("promedio_nacional"))
    )
    return out.select(dim, "total", "retirados", "tasa_retiro", "promedio_nacional", "diferencia").orderBy(F.desc("tasa_retiro"), dim)


def severity(df: DataFrame, dim: str = "departamento", weight: str | None = None) -> DataFrame:
    """I2 over every group."""
    return vs_national(df, dim, weight).withColumn("clase", severity_class("diferencia"))


def label_gap(gaps: DataFrame, dim: str, label_a: str, label_b: str, by: str = "tasa_retiro") -> DataFrame:
    """``by`` of label A minus label B; no row when either is absent."""
    return (
        gaps.agg(
            F.max(F.when(F.col(dim) == label_a, F.col(by))).alias("tasa_a"),
            F.max(F.when(F.col(dim) == label_b, F.col(by))).alias("tasa_b"),
        )
        .withColumn("brecha", F.col("tasa_a") - F.col("tasa_b"))
        .where(F.col("brecha").isNotNull())
        .select(
            F.lit(dim).alias("dimension"),
            F.lit(label_a).alias("label_a"),
            F.lit(label_b).alias("label_b"),
            "tasa_a",
            "tasa_b",
            "brecha",
        )
    )


def rural_urban_gap(df: DataFrame, weight: str | None = None) -> DataFrame:
    return label_gap(ind.gap_table(df, "area", weight), "area", "Rural", "Urbana")


def estimated_dropouts(df: DataFrame, dim: str = "departamento", weight: str | None = None) -> DataFrame:
    """Truncated estimate ``int(total * rounded_rate / 100)`` beside the
    exact count, per group and nationally (``ambito``)."""
    agg = df.rollup(dim).agg(
        ind._rows(weight).alias("_filas"),
        *ind.outcome_counts(weight, with_not_promoted=False),
        F.grouping(dim).alias("_g"),
    )
    national = F.col("_g") == 1
    total = F.when(national, F.col("_filas")).otherwise(F.col("total"))
    out = agg.where(national | F.col(dim).isNotNull()).select(
        F.when(national, F.lit("nacional")).otherwise(F.lit(dim)).alias("ambito"),
        F.when(~national, F.col(dim)).alias(dim),
        total.alias("total"),
        "retirados",
    )
    out = out.withColumn("tasa_retiro", rate("retirados", "total"))
    return out.withColumn("retirados_estimados", truncated_estimate("total", "tasa_retiro"))


# ------------------------------------------------------------------ texts
OVERVIEW = "Año %s. Inscripciones: %s. Promoción: %s%%. Retiro: %s%%, que equivale a %s inscripciones."
OVERVIEW_NO_YEAR = OVERVIEW.removeprefix("Año %s. ")
WORST_PLACE = "%s encabeza el retiro con %s%%, a %s puntos de la cifra del país, entre %s inscripciones."
RURAL_URBAN = "Retiro por área: Rural menos Urbana da %s puntos."
WORST_LEVEL = "Por nivel, el retiro más alto es el de %s: %s%%."
DEPARTMENT = "%s. Inscripciones: %s. Retiro: %s%% (%s puntos; país: %s%%), unas %s inscripciones. Clase: %s. %s"


def by_dimension(rows: Column, dimension: str) -> Column:
    return F.filter(rows, lambda r: r["dimension"] == dimension)


def highest(rows: Column, by: str = "tasa_retiro") -> Column:
    """The row with the highest ``by`` (ties by label); null for no rows."""
    order = F.transform(rows, lambda r: F.struct(F.coalesce(-r[by], F.lit(float("inf"))).alias("k"), r["label"].alias("label"), r.alias("r")))
    return F.get(F.array_sort(order), F.lit(0))["r"]


def known(rows: Column) -> Column:
    return F.filter(rows, lambda r: ~r["label"].isin(IGNORED, UNKNOWN))


def gathered(figures: DataFrame) -> DataFrame:
    """The figures (under a hundred rows, see ``indicators.figures``) as one row
    with an array ``filas``, so every text and document is an expression over it."""
    return figures.agg(F.collect_list(F.struct(*figures.columns)).alias("filas"))


def overview_text(nat: Column) -> Column:
    parts = (
        thousands(nat["total"]),
        one_decimal(nat["tasa_promocion"]),
        one_decimal(nat["tasa_retiro"]),
        thousands(truncated_estimate(nat["total"], nat["tasa_retiro"])),
    )
    text = F.when(nat["anio"].isNull(), F.format_string(OVERVIEW_NO_YEAR, *parts)).otherwise(
        F.format_string(OVERVIEW, nat["anio"].cast("string"), *parts)
    )
    return F.when(nat.isNotNull(), text)


def national_texts(rows: Column) -> Column:
    """I5 as array<struct<orden, tipo, texto>>: only what the data supports."""
    nat = F.get(by_dimension(rows, ind.NATIONAL), F.lit(0))
    place = highest(by_dimension(rows, "departamento"))
    areas, level = by_dimension(rows, "area"), highest(known(by_dimension(rows, "nivel")))

    def dropout(label: str) -> Column:
        return F.get(F.filter(areas, lambda r: r["label"] == label), F.lit(0))["tasa_retiro"]

    gap = dropout("Rural") - dropout("Urbana")
    diff = place["tasa_retiro"] - nat["tasa_retiro"]
    texts = (
        ("panorama", overview_text(nat)),
        ("zona_critica", F.when(place.isNotNull(), F.format_string(WORST_PLACE, place["label"], one_decimal(place["tasa_retiro"]), one_decimal(diff), thousands(place["total"])))),
        ("brecha_rural_urbana", F.when(gap.isNotNull(), F.format_string(RURAL_URBAN, one_decimal(gap)))),
        ("nivel_critico", F.when(level.isNotNull(), F.format_string(WORST_LEVEL, level["label"], one_decimal(level["tasa_retiro"])))),
    )
    built = F.array(*[F.struct(F.lit(i).alias("orden"), F.lit(kind).alias("tipo"), text.alias("texto")) for i, (kind, text) in enumerate(texts, 1)])
    return F.filter(built, lambda t: t["texto"].isNotNull())


def insights_national(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Up to four ``(orden, tipo, texto)`` rows, from one pass."""
    return gathered(ind.figures(df, weight)).select(F.inline(national_texts(F.col("filas"))))


def insights_department(df: DataFrame, dim: str = "departamento", weight: str | None = None) -> DataFrame:
    """One sentence per group — figures, signed difference, class, advice."""
    sev = severity(df, dim, weight)
    advice = F.create_map(*[x for k, v in ADVICE.items() for x in (F.lit(k), F.lit(v))])
    text = F.format_string(
        DEPARTMENT,
        F.col(dim),
        thousands("total"),
        one_decimal("tasa_retiro"),
        signed_one_decimal("diferencia"),
        one_decimal("promedio_nacional"),
        thousands(truncated_estimate("total", "tasa_retiro")),
        F.col("clase"),
        advice[F.col("clase")],
    )
    return sev.select(dim, "clase", text.alias("texto"))

"""Aggregate-only answers: ad-hoc filtered counts, grouped arg-min, a batch of
structured questions answered from aggregates (with provenance and an
explicit "not available"), and the JSON context document.

Nothing here reads raw rows more than once: facts and documents are expressions
over ``indicators.figures``, the one roll-up with a row per label (no job while
a plan is built, no driver-side assembly, no cross join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dictionary import IGNORED, UNKNOWN, local_table
from . import indicators as ind
from . import insights as ins

NOT_AVAILABLE = "No disponible en los datos agregados"


def filtered_count(df: DataFrame, **equals: str) -> DataFrame:
    """``count(*)`` under equality filters, e.g. nivel='Primaria'."""
    cond = F.lit(True)
    for col, value in equals.items():
        cond = cond & (F.col(col) == value)
    return df.where(cond).agg(F.count(F.lit(1)).alias("n"))


def argmin_group(df: DataFrame, group: str, metric: str = "tasa_promocion", **equals: str) -> DataFrame:
    """The group with the lowest ``metric`` under filters (ties by name)."""
    cond = F.lit(True)
    for col, value in equals.items():
        cond = cond & (F.col(col) == value)
    table = ind.outcome_by(df.where(cond), group, with_not_promoted=True)
    return table.orderBy(F.asc(metric), F.asc(group)).limit(1)


# ------------------------------------------------------------------ facts
HIGHEST = "(mayor)"
OVERVIEW_METRIC = "panorama"
RATES = ("tasa_promocion", "tasa_no_promocion", "tasa_retiro")


def _said(metric: Column, value: Column) -> Column:
    return F.when(metric == "total", F.format_string("%,d", value.cast("bigint"))).otherwise(F.format_string("%.1f%%", value))


def facts(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Long ``(dimension, label, metrica, valor, texto, fuente)`` table of every
    published aggregate: national indicators, department table, gap tables, the
    highest known label of each dimension (``(mayor)``) and the overview. One
    pass over the input; a few hundred rows, bounded by the label domains."""
    rows = ind.figures(df, weight).where(F.col("dimension") != "sexo")
    dim = F.col("dimension")
    source = (
        F.when(dim == ind.NATIONAL, F.lit("indicadores_nacionales"))
        .when(dim == "departamento", F.lit("resumen_departamentos"))
        .otherwise(F.concat(F.lit("brecha_"), dim))
    )
    full = dim.isin(ind.NATIONAL, "departamento")  # the gap tables have no such rate

    def cell(metric: str, value: Column, text: Column) -> Column:
        return F.struct(F.lit(metric).alias("metrica"), value.cast("double").alias("valor"), text.cast("string").alias("texto"))

    none = F.lit(None)
    cells = [cell("total", F.col("total"), none)]
    cells += [F.when(full, cell(m, F.col(m), none)) if m == "tasa_no_promocion" else cell(m, F.col(m), none) for m in RATES]
    whole = F.struct(*[F.col(c) for c in rows.columns])
    cells.append(F.when(dim == ind.NATIONAL, cell(OVERVIEW_METRIC, F.col("total"), ins.overview_text(whole))))
    long = rows.select("dimension", "label", source.alias("fuente"), F.inline(F.array_compact(F.array(*cells))))
    # over these few hundred rows; ties by label
    first = Window.partitionBy("dimension", "metrica").orderBy(F.desc_nulls_last("valor"), "label")
    top = (
        long.where((dim != ind.NATIONAL) & ~F.col("label").isin(IGNORED, UNKNOWN) & F.col("valor").isNotNull())
        .withColumn("_k", F.row_number().over(first))
        .where("_k = 1")
        .select("dimension", F.lit(HIGHEST).alias("label"), "fuente", "metrica", "valor", F.concat("label", F.lit(": "), _said(F.col("metrica"), F.col("valor"))).alias("texto"))
    )
    return long.unionByName(top)


# Structured stand-ins for the sample questions a user asks the assistant.
SAMPLE_QUESTIONS = [
    (1, "¿Cuántas inscripciones hay en total?", "nacional", "Total", "total"),
    (2, "¿Qué tasa de retiro tiene Alta Verapaz?", "departamento", "Alta Verapaz", "tasa_retiro"),
    (3, "¿Qué tasa de promoción tiene el área rural?", "area", "Rural", "tasa_promocion"),
    (4, "¿Qué tasa de retiro tiene el nivel Básico?", "nivel", "Básico", "tasa_retiro"),
    (5, "¿Qué tasa de retiro tiene el pueblo Xinka?", "pueblo", "Xinka", "tasa_retiro"),
    (6, "¿Qué tasa de no promoción tiene el sector Privado?", "sector", "Privado", "tasa_no_promocion"),
    (7, "¿Cuántos estudiantes tienen alguna discapacidad?", "discapacidad", "Sí", "total"),
    (8, "¿Cuántas inscripciones tiene Guatemala?", "departamento", "Guatemala", "total"),
    (9, "¿En qué departamento es mayor la tasa de retiro?", "departamento", HIGHEST, "tasa_retiro"),
    (10, "¿Cuál es el panorama general?", "nacional", "Total", OVERVIEW_METRIC),
]


def questions(spark: SparkSession, rows=SAMPLE_QUESTIONS) -> DataFrame:
    return local_table(spark, rows, "pregunta_id int, pregunta string, dimension string, label string, metrica string")


def answer_batch(df: DataFrame, asked: DataFrame, weight: str | None = None) -> DataFrame:
    """Each question answered only from aggregates; unknown -> explicit
    "not available" and a null source."""
    joined = asked.join(facts(df, weight), ["dimension", "label", "metrica"], "left")
    text = F.when(F.col("valor").isNull(), F.lit(NOT_AVAILABLE)).otherwise(F.coalesce("texto", _said(F.col("metrica"), F.col("valor"))))
    return joined.select("pregunta_id", "pregunta", "dimension", "label", "metrica", "valor", text.alias("respuesta"), "fuente")


# ------------------------------------------------------------------- JSON
def json_value(col: Column | str) -> Column:
    """JSON text of any value (scalar, array, map or struct)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def json_text(*members: tuple[str, Column]) -> Column:
    """A JSON object of (key, JSON text) members; a null member is left out."""
    texts = [F.concat(F.lit(f'"{key}":'), value) for key, value in members]
    return F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}"))


def _sorted(rows: Column, *keys) -> Column:
    pairs = F.transform(rows, lambda r: F.struct(*[k(r).alias(f"k{i}") for i, k in enumerate(keys)], r.alias("r")))
    return F.transform(F.array_sort(pairs), lambda p: p["r"])


def _share_map(rows: Column, dim: str) -> Column:
    """Shares of a dimension, by descending count, then label."""
    listed = _sorted(ins.by_dimension(rows, dim), lambda r: -r["filas"], lambda r: r["label"])
    return F.concat(F.lit("{"), F.array_join(F.transform(listed, lambda r: F.concat(json_value(r["label"]), F.lit(":"), json_value(r["pct"]))), ","), F.lit("}"))


def indicators_text(rows: Column) -> Column:
    """The ``indicadores`` object: national figures and four share maps."""
    nat = F.get(ins.by_dimension(rows, ind.NATIONAL), F.lit(0))
    scalars = [("total_estudiantes", "total"), ("tasa_promocion", "tasa_promocion"), ("tasa_no_promocion", "tasa_no_promocion"), ("tasa_retiro", "tasa_retiro")]
    return json_text(*[(key, json_value(nat[c])) for key, c in scalars], *[(f"por_{d}", _share_map(rows, d)) for d in ind.SHARE_DIMS])


def _insights_text(rows: Column) -> Column:
    return F.to_json(F.transform(ins.national_texts(rows), lambda t: t["texto"]))


def _national_rate(rows: Column) -> Column:
    return json_value(F.get(ins.by_dimension(rows, ind.NATIONAL), F.lit(0))["tasa_retiro"])


def indicators_document(df: DataFrame, weight: str | None = None) -> DataFrame:
    """K5 content: ``{"indicadores": ..., "insights": [...], "promedio_retiro_nacional": x}``."""
    rows = F.col("filas")
    text = json_text(("indicadores", indicators_text(rows)), ("insights", _insights_text(rows)), ("promedio_retiro_nacional", _national_rate(rows)))
    return ins.gathered(ind.figures(df, weight)).select(text.alias("documento"))


RECORD = ("total", "tasa_promocion", "tasa_retiro")
GAP_RECORD = ("total", "promovidos", "retirados", "tasa_promocion", "tasa_retiro")
CONTEXT_GAPS = ("area", "sector", "nivel")


def _department_records(rows: Column) -> Column:
    listed = _sorted(rows, lambda r: -r["tasa_retiro"], lambda r: r["label"])
    return F.to_json(F.transform(listed, lambda r: F.struct(r["label"].alias("departamento"), *[r[c].alias(c) for c in RECORD])))


def _gap_records(rows: Column, dim: str) -> Column:
    listed = _sorted(rows, lambda r: r["label"])
    return F.to_json(F.transform(listed, lambda r: F.struct(r["label"].alias(dim), *[r[c].alias(c) for c in GAP_RECORD])))


def context_document(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Aggregate-only context — indicators, insights, national dropout,
    department records (4 columns, ranking order) and the area / sector /
    level gap tables (not peoples). Size is bounded by group counts."""
    rows = F.col("filas")
    text = json_text(
        ("indicadores", indicators_text(rows)),
        ("insights", _insights_text(rows)),
        ("promedio_retiro", _national_rate(rows)),
        ("por_departamento", _department_records(ins.by_dimension(rows, "departamento"))),
        *[(f"brecha_{d}", _gap_records(ins.by_dimension(rows, d), d)) for d in CONTEXT_GAPS],
    )
    return ins.gathered(ind.figures(df, weight)).select(text.alias("contexto"))


def context_from_outputs(document: DataFrame | None = None, summary: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """C1 from what the batch has written: the indicator document (one JSON
    text column), the department table and the long gap table. A part that is
    not there is left out of the context."""
    parts = []
    if document is not None:
        text = F.col(document.columns[0])
        for i, (key, path) in enumerate((("indicadores", "$.indicadores"), ("insights", "$.insights"), ("promedio_retiro", "$.promedio_retiro_nacional"))):
            parts.append(document.select(F.lit(i).alias("orden"), F.lit(key).alias("clave"), F.get_json_object(text, path).alias("valor")))
    if summary is not None:
        rows = F.collect_list(F.struct(F.col("departamento").alias("label"), *RECORD))
        parts.append(summary.agg(rows.alias("r")).select(F.lit(3).alias("orden"), F.lit("por_departamento").alias("clave"), _department_records(F.col("r")).alias("valor")))
    if gaps is not None:
        packed = gaps.agg(F.collect_list(F.struct("dimension", "label", *GAP_RECORD)).alias("r"))
        found = F.array(
            *[
                F.struct(F.lit(4 + i).alias("orden"), F.lit(f"brecha_{d}").alias("clave"), _gap_records(ins.by_dimension(F.col("r"), d), d).alias("valor"))
                for i, d in enumerate(CONTEXT_GAPS)
            ]
        )
        parts.append(packed.select(F.inline(F.filter(found, lambda p: p["valor"] != "[]"))))
    if not parts:
        raise ValueError("no output to build a context from")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    listed = F.array_sort(F.collect_list(F.struct("orden", "clave", "valor")))  # at most seven rows
    members = F.transform(F.filter(listed, lambda e: e["valor"].isNotNull()), lambda e: F.concat(json_value(e["clave"]), F.lit(":"), e["valor"]))
    return every.agg(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("contexto"))

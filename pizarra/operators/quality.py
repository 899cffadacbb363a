"""Data-quality checks and controls the data specification asks for.

Distinct counts are computed in two steps: the distinct key combinations are
first reduced map-side (a partial hash aggregate whose output is bounded by
the number of distinct codes, ~tens of thousands, not by rows), then counted
on that small result. That avoids the ``Expand`` that several
``count(DISTINCT)`` in one aggregate would apply to every raw row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import WHITESPACE, code_segment, municipality, normalise_code, segment_level
from ..functions.dictionary import CONTROL_SHARES, CONTROL_TOTALS, DEPARTAMENTOS, DEPARTMENT_FILES, DEPARTMENT_RECORDS, GRADE_RANGES, local_table
from ..functions.numeric import rate
from . import indicators as ind

CODE = "cod_establecimiento"


def code_segments(df: DataFrame, code: str = CODE) -> DataFrame:
    """B1: the four segments of the establishment code (null when absent)."""
    return df.select(
        F.col(code),
        code_segment(code, 1).alias("seg_departamento"),
        code_segment(code, 2).alias("seg_municipio"),
        code_segment(code, 3).alias("seg_establecimiento"),
        code_segment(code, 4).alias("seg_nivel"),
    )


def level_mismatch(df: DataFrame, code: str = CODE, level_code: str = "nivel_codigo") -> DataFrame:
    """B2: level implied by the 4th code segment vs the declared level, counted
    per combination; ``coincide`` is false when either side is unknown."""
    implied = segment_level(code)
    return (
        df.groupBy(F.col(level_code).alias("nivel_declarado"), implied.alias("nivel_segmento"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("coincide", F.coalesce(F.col("nivel_declarado") == F.col("nivel_segmento"), F.lit(False)))
    )


def municipality_counts(raw: DataFrame, dept: str = "departamento_f", code: str = CODE) -> DataFrame:
    """Distinct municipalities per department and nationally, from codes
    stripped only (prefix defect kept) vs fully normalised (defect repaired)."""
    stripped = F.btrim(F.col(code).cast("string"), F.lit(WHITESPACE))
    # both keys are functions of the code: reduce to distinct (department,
    # code) pairs first and run the string work once per code, not per row
    keys = (
        raw.select(dept, code)
        .distinct()
        .select(F.col(dept), municipality(stripped).alias("m_raw"), municipality(normalise_code(code)).alias("m_fixed"))
    )
    out = keys.rollup(dept).agg(
        F.count_distinct("m_raw").alias("municipios_sin_reparar"),
        F.count_distinct("m_fixed").alias("municipios"),
        F.grouping(dept).alias("_g"),
    )
    national = F.col("_g") == 1
    return out.where(national | F.col(dept).isNotNull()).select(
        F.when(national, F.lit("nacional")).otherwise(F.lit("departamento")).alias("ambito"),
        F.when(~national, F.col(dept)).alias(dept),
        "municipios_sin_reparar",
        "municipios",
    )


def school_counts(decoded: DataFrame, dept: str = "departamento", code: str = CODE) -> DataFrame:
    """Distinct establishments (segments 1-3) vs distinct codes; a school
    serving several levels has several codes."""
    school = F.when(F.size(F.split(F.col(code), "-", -1)) >= 3, F.substring_index(F.col(code), "-", 3))
    # the school key is a function of the code: reduce to distinct
    # (group, code) pairs first, derive it once per code, not once per row
    keys = decoded.select(dept, code).distinct().select(dept, school.alias("_school"), F.col(code).alias("_code"))
    return keys.groupBy(dept).agg(
        F.count_distinct("_school").alias("establecimientos"), F.count_distinct("_code").alias("codigos")
    )


def grade_coherence(decoded: DataFrame, level: str = "nivel", level_code: str = "nivel_codigo", grade: str = "grado") -> DataFrame:
    """Per level, grades inside / outside the documented range; levels
    without a documented range are counted as ``sin_rango``."""
    lo = F.create_map(*[x for k, (a, _) in GRADE_RANGES.items() for x in (F.lit(k), F.lit(a))])[F.col(level_code)]
    hi = F.create_map(*[x for k, (_, b) in GRADE_RANGES.items() for x in (F.lit(k), F.lit(b))])[F.col(level_code)]
    inside = F.col(grade).between(lo, hi)
    return decoded.groupBy(level).agg(
        F.count(F.lit(1)).alias("filas"),
        F.count_if(inside).alias("en_rango"),
        F.count_if(~inside).alias("fuera_de_rango"),
        F.count_if(lo.isNull() | F.col(grade).isNull()).alias("sin_rango"),
    )


def constant_columns(df: DataFrame, group: str = "departamento_f", columns: Sequence[str] = ("depto_mupio", "anio")) -> DataFrame:
    """Per group and column, min/max/non-null count and whether it is constant."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    g = df.groupBy(group).agg(*aggs)
    parts = [
        g.select(
            group,
            F.lit(c).alias("columna"),
            F.col(f"{c}__min").cast("bigint").alias("minimo"),
            F.col(f"{c}__max").cast("bigint").alias("maximo"),
        )
        for c in columns
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("constante", F.col("minimo") == F.col("maximo"))


def code_profile(raw: DataFrame, columns: Sequence[str], ignored_code: int = 9) -> DataFrame:
    """Per raw column, rows, nulls and code-9 (``Ignorado``) counts — one
    aggregate of conditional counts, then unpivoted to long form."""
    aggs = [F.count(F.lit(1)).alias("filas")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulos"), F.count_if(F.col(c) == ignored_code).alias(f"{c}__ignorados")]
    wide = raw.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__nulos`, `{c}__ignorados`" for c in columns)
    return wide.selectExpr("filas", f"stack({len(columns)}, {stack}) AS (columna, nulos, ignorados)").withColumn(
        "pct_ignorados", rate("ignorados", "filas")
    )


def expected_shares(spark: SparkSession, expected: dict[str, dict[str, float]] = CONTROL_SHARES) -> DataFrame:
    rows = [(dim, label, float(v)) for dim, labels in expected.items() for label, v in labels.items()]
    return local_table(spark, rows, "dimension string, label string, esperado double")


def _tenths(c: Column) -> Column:
    return F.rint(c * 10)


def control_check(decoded: DataFrame, expected: DataFrame | None = None, tolerance: float = 0.1) -> DataFrame:
    """Computed shares vs published control figures, both given to one
    decimal, so they are compared in whole tenths (in doubles 0.4 - 0.3 is more
    than 0.1). The published 5.5 % of retirement is compared with the share of
    outcome code 3 (``Retirado``) alone, without code 4 (``Retirado definitivo``).

    Spark's measured-size check picks the join."""
    expected = expected_shares(decoded.sparkSession) if expected is None else expected
    dims = sorted({r for r in CONTROL_SHARES})
    got = ind.shares_all(decoded, dims).select("dimension", "label", F.col("pct").alias("calculado"))
    difference = F.col("calculado") - F.col("esperado")
    return (
        expected.join(got, ["dimension", "label"], "left")
        .select("dimension", "label", "esperado", "calculado")
        .withColumn("diferencia", difference)
        .withColumn("dentro_tolerancia", F.coalesce(_tenths(F.abs(difference)) <= _tenths(F.lit(tolerance)), F.lit(False)))
    )


def control_totals(decoded: DataFrame) -> DataFrame:
    """The published totals against the data: enrolments, municipalities of
    the department of Guatemala and of the country. ``aproximado`` marks the
    figure that is published as "about"; it holds within 2 %."""
    keys = decoded.groupBy("departamento", "cod_establecimiento").agg(F.count(F.lit(1)).alias("n"))
    keys = keys.select("departamento", municipality("cod_establecimiento").alias("m"), "n")
    got = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("inscripciones"),
        F.count_distinct(F.when(F.col("departamento") == "Guatemala", F.col("m"))).alias("municipios_guatemala"),
        F.count_distinct("m").alias("municipios"),
    )
    rows = [F.struct(F.lit(k).alias("control"), F.lit(v).cast("bigint").alias("esperado"), F.col(k).cast("bigint").alias("calculado"), F.lit(about).alias("aproximado")) for k, (v, about) in CONTROL_TOTALS.items()]
    off = F.abs(F.col("calculado") - F.col("esperado"))
    return got.select(F.inline(F.array(*rows))).withColumn(
        "cumple", F.when(F.col("aproximado"), off * 50 <= F.col("esperado")).otherwise(off == 0)
    )


def catalogue(spark: SparkSession) -> DataFrame:
    """Department catalogue ``(departamento_f, departamento, archivo, registros_publicados)``."""
    rows = [(k, DEPARTAMENTOS[k], DEPARTMENT_FILES[k], DEPARTMENT_RECORDS[k]) for k in DEPARTAMENTOS]
    return local_table(spark, rows, "departamento_f int, departamento string, archivo string, registros_publicados bigint")


def record_reconcile(raw: DataFrame, dept: str = "departamento_f") -> DataFrame:
    """Records per department vs the published per-file counts (full
    outer join: departments missing on either side show up)."""
    counts = raw.groupBy(dept).agg(F.count(F.lit(1)).alias("registros"))
    cat = catalogue(raw.sparkSession).select(dept, "departamento", "registros_publicados")
    return (
        counts.join(cat, dept, "full_outer")
        .withColumn("registros", F.coalesce("registros", F.lit(0)).cast("bigint"))
        .withColumn("diferencia", F.col("registros") - F.col("registros_publicados"))
    )


def repeat_graduate_rates(decoded: DataFrame, dim: str = "departamento") -> DataFrame:
    """Repetition and graduation rates per group and nationally."""
    agg = decoded.rollup(dim).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("repitente") == "Sí").alias("repitentes"),
        F.count_if(F.col("graduando") == "Sí").alias("graduandos"),
        F.grouping(dim).alias("_g"),
    )
    national = F.col("_g") == 1
    return (
        agg.where(national | F.col(dim).isNotNull())
        .select(
            F.when(national, F.lit("nacional")).otherwise(F.lit(dim)).alias("ambito"),
            F.when(~national, F.col(dim)).alias(dim),
            "total",
            "repitentes",
            "graduandos",
        )
        .withColumn("tasa_repitencia", rate("repitentes", "total"))
        .withColumn("tasa_graduacion", rate("graduandos", "total"))
    )


def _per_municipality(decoded: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
    """Counts per (department, municipality). The municipality is a function of
    the code: rows are counted per distinct code first, the string work is done
    once per code, and rows without one are dropped by a test on an aggregate,
    which (unlike one on the key) can't be pushed below into the scan."""
    counts = decoded.groupBy("departamento", CODE).agg(*aggregates)
    names = [c for c in counts.columns if c not in ("departamento", CODE)]
    key = counts.select("departamento", municipality(CODE).alias("municipio_codigo"), *names)
    return (
        key.groupBy("departamento", "municipio_codigo")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in names], F.max(F.col("departamento").isNotNull() & F.col("municipio_codigo").isNotNull()).alias("_known"))
        .where("_known")
        .drop("_known")
    )


def municipality_summary(decoded: DataFrame) -> DataFrame:
    """Outcome table per (department, municipality)."""
    return ind.with_rates(_per_municipality(decoded, ind.outcome_counts(None, with_not_promoted=True)))


def municipality_names(decoded: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Municipality key ``DD-MM`` -> 4-digit catalogue code ``DDMM`` and its
    name from a catalogue ``(codigo, municipio)`` when one is supplied (the
    catalogue is a sheet of the data dictionary, a few hundred rows). The
    catalogue comes from the caller, so no broadcast hint: Spark's
    measured-size check broadcasts it when small, sort-merge otherwise."""
    munis = _per_municipality(decoded, [F.count(F.lit(1)).alias("n")])
    munis = munis.withColumn("codigo", F.replace("municipio_codigo", F.lit("-"), F.lit("")))
    if names is None:
        return munis.withColumn("municipio", F.lit(None).cast("string"))
    return munis.join(names.select("codigo", "municipio"), "codigo", "left")


# Documented in the data dictionary but absent from the data files.
DOCUMENTED_ABSENT = ("modalidad",)


def schema_conformance(df: DataFrame, expected: Sequence[str] | None = None) -> DataFrame:
    """Expected raw columns vs the frame's schema (a metadata diff, no
    data scan): one row per column with ``esperada``, ``presente``, ``tipo``.
    Columns documented but absent (``modalidad``) are listed as not expected."""
    from ..sources.fixture import RAW_COLUMNS

    expected = list(expected or RAW_COLUMNS)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = expected + [c for c in types if c not in expected] + [c for c in DOCUMENTED_ABSENT if c not in types and c not in expected]
    rows = [(c, c in expected, c in types, types.get(c)) for c in names]
    schema = T.StructType(
        [
            T.StructField("columna", T.StringType()),
            T.StructField("esperada", T.BooleanType()),
            T.StructField("presente", T.BooleanType()),
            T.StructField("tipo", T.StringType()),
        ]
    )
    return df.sparkSession.createDataFrame(rows, schema)

"""Registry of named queries: each is ``(spark, sf_dir) -> DataFrame`` over the
fixture view, paired with its DuckDB oracle text (``None`` = rows-only).

Keys follow the operator inventory; every query reads the driver's tables
(through the fixture view, or files Spark wrote from it) in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import WHITESPACE, normalise_code
from ..functions.dictionary import CONTROL_SHARES, DEPARTAMENTOS, DEPARTMENT_FILES, DEPARTMENT_RECORDS, GRADE_RANGES, SEGMENT_LEVEL, TRIAL_DEPARTMENTS
from ..functions.numeric import one_decimal, thousands
from ..operators import answers as ans
from ..operators import decode as dec
from ..operators import indicators as ind
from ..operators import insights as ins
from ..operators import quality as qual
from ..operators import ranking as rk
from ..session import fresh_dir
from ..sources import files
from ..sources.fixture import RAW_COLUMNS, enrolments
from ..streaming import ingest as st
from . import oracle as o
from . import pipeline as pl
from .registry import REGISTRY, register  # noqa: F401

def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.decode_all(enrolments(spark, sf_dir))


W = o.with_views
DROP = "('Retirado', 'Retirado definitivo')"
CLEAN = "NOT IN ('Ignorado', 'Desconocido')"


def fmt1(x: str) -> str:
    return f"printf('%.1f', {x})"


def thousands_sql(x: str) -> str:
    return f"format('{{:,}}', {x})"


def trunc_est(total: str, rate: str) -> str:
    return f"CAST(trunc({total} * {rate} / 100) AS BIGINT)"


# ============================================================ 2.2 decode
@register("decode_all", W("SELECT * FROM d"))
def q_decode_all(spark, sf_dir):
    return decoded(spark, sf_dir)


@register("normalise_code", W(f"SELECT cod_establecimiento AS cod_original, {o.NORM} AS cod_establecimiento FROM e"))
def q_normalise_code(spark, sf_dir):
    e = enrolments(spark, sf_dir)
    return e.select(F.col("cod_establecimiento").alias("cod_original"), normalise_code("cod_establecimiento").alias("cod_establecimiento"))


@register("municipality", W("SELECT cod_establecimiento, municipio_codigo FROM d"))
def q_municipality(spark, sf_dir):
    return dec.with_municipality(enrolments(spark, sf_dir)).select("cod_establecimiento", "municipio_codigo")


@register("decode_join", W("SELECT * FROM d"))
def q_decode_join(spark, sf_dir):
    out = dec.decode_join(dec.with_municipality(enrolments(spark, sf_dir)))
    return out.select(*dec.DECODED_ORDER)


# ========================================================= 2.3 aggregates
@register("national_indicators", W(o.NATIONAL))
def q_national(spark, sf_dir):
    return ind.national_indicators(decoded(spark, sf_dir))


@register("department_summary", W(o.DEPARTMENT_SUMMARY))
def q_department_summary(spark, sf_dir):
    return ind.department_summary(decoded(spark, sf_dir))


def share_sql(dim: str) -> str:
    return (
        f"SELECT {dim}, n, {o.rate('n', 'sum(n) OVER ()')} AS pct FROM "
        f"(SELECT {dim}, count(*) AS n FROM d WHERE {dim} IS NOT NULL GROUP BY {dim})"
    )


def _share_query(dim: str):
    def fn(spark, sf_dir):
        return ind.share(decoded(spark, sf_dir), dim)

    return fn


for _dim in ind.SHARE_DIMS:
    register(f"share_{_dim}", W(share_sql(_dim)))(_share_query(_dim))


def share_all_sql(dims) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS label, n, {o.rate('n', 'sum(n) OVER ()')} AS pct FROM "
        f"(SELECT {d}, count(*) AS n FROM d WHERE {d} IS NOT NULL GROUP BY {d})"
        for d in dims
    )


@register("share_all", W(share_all_sql(ind.SHARE_DIMS)))
def q_share_all(spark, sf_dir):
    return ind.shares_all(decoded(spark, sf_dir))


@register(
    "count_semantics",
    W(
        "SELECT departamento_f, count(*) AS filas, count(resultado_f) AS total_resultado, "
        "count(*) - count(resultado_f) AS sin_resultado FROM e WHERE departamento_f IS NOT NULL GROUP BY departamento_f"
    ),
)
def q_count_semantics(spark, sf_dir):
    return ind.count_semantics(enrolments(spark, sf_dir))


def _gap_query(dim: str):
    def fn(spark, sf_dir):
        return ind.gap_table(decoded(spark, sf_dir), dim)

    return fn


for _dim in ind.GAP_DIMS:
    register(f"gap_{_dim}", W(o.grouped(_dim)))(_gap_query(_dim))


def gap_all_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS label, total, promovidos, retirados, tasa_promocion, tasa_retiro FROM ({o.grouped(d)})"
        for d in ind.GAP_DIMS
    )


GAP_ALL = gap_all_sql()


@register("gap_all", W(GAP_ALL))
def q_gap_all(spark, sf_dir):
    return ind.gap_all(decoded(spark, sf_dir))


@register("outcome_cube", W("SELECT departamento, area, sector, sexo, nivel, pueblo, resultado, count(*) AS n FROM d GROUP BY ALL"))
def q_outcome_cube(spark, sf_dir):
    return ind.outcome_cube(decoded(spark, sf_dir))


@register(
    "rounding",
    W(
        f"SELECT departamento, retirados, total, (CAST(retirados AS DOUBLE) / total) * 100 AS pct_exacto, tasa_retiro "
        f"FROM ({o.DEPARTMENT_SUMMARY})"
    ),
)
def q_rounding(spark, sf_dir):
    s = ind.department_summary(decoded(spark, sf_dir))
    return s.select("departamento", "retirados", "total", (F.try_divide("retirados", "total") * 100).alias("pct_exacto"), "tasa_retiro")


ESTIMATED = (
    f"SELECT *, {trunc_est('total', 'tasa_retiro')} AS retirados_estimados FROM ("
    f"SELECT *, {o.rate('retirados', 'total')} AS tasa_retiro FROM ("
    "SELECT CASE WHEN grouping(departamento) = 1 THEN 'nacional' ELSE 'departamento' END AS ambito, "
    "CASE WHEN grouping(departamento) = 0 THEN departamento END AS departamento, "
    "CASE WHEN grouping(departamento) = 1 THEN count(*) ELSE count(resultado) END AS total, "
    f"count(CASE WHEN resultado IN {DROP} THEN 1 END) AS retirados "
    "FROM d GROUP BY ROLLUP (departamento) HAVING grouping(departamento) = 1 OR departamento IS NOT NULL))"
)


@register("estimated_dropouts", W(ESTIMATED))
def q_estimated(spark, sf_dir):
    return ins.estimated_dropouts(decoded(spark, sf_dir))


# ============================================================ 2.4 ranking
RANKING = f"SELECT *, row_number() OVER (ORDER BY tasa_retiro DESC, departamento) AS posicion FROM ({o.DEPARTMENT_SUMMARY})"


@register("department_ranking", W(RANKING))
def q_department_ranking(spark, sf_dir):
    return rk.ranked(ind.department_summary(decoded(spark, sf_dir)), "tasa_retiro", "departamento")


@register("top_critical", W(f"SELECT * FROM ({o.DEPARTMENT_SUMMARY}) ORDER BY tasa_retiro DESC, departamento LIMIT 8"))
def q_top_critical(spark, sf_dir):
    return rk.top_k(ind.department_summary(decoded(spark, sf_dir)), "tasa_retiro", "departamento", 8)


@register("most_critical", W(f"SELECT * FROM ({o.DEPARTMENT_SUMMARY}) ORDER BY tasa_retiro DESC, departamento LIMIT 1"))
def q_most_critical(spark, sf_dir):
    return rk.top_k(ind.department_summary(decoded(spark, sf_dir)), "tasa_retiro", "departamento", 1)


@register("worst_level", W(f"SELECT * FROM ({o.grouped('nivel')}) WHERE nivel {CLEAN} ORDER BY tasa_retiro DESC, nivel LIMIT 1"))
def q_worst_level(spark, sf_dir):
    return rk.worst(ind.gap_table(decoded(spark, sf_dir), "nivel"), "nivel")


@register("clean_groups", W(f"SELECT * FROM ({o.grouped('pueblo')}) WHERE pueblo {CLEAN}"))
def q_clean_groups(spark, sf_dir):
    return rk.drop_unknown(ind.gap_table(decoded(spark, sf_dir), "pueblo"), "pueblo")


@register(
    "people_ranking",
    W(f"SELECT *, row_number() OVER (ORDER BY tasa_retiro DESC, pueblo) AS posicion FROM ({o.grouped('pueblo')}) WHERE pueblo {CLEAN}"),
)
def q_people_ranking(spark, sf_dir):
    return rk.ranked(rk.drop_unknown(ind.gap_table(decoded(spark, sf_dir), "pueblo"), "pueblo"), "tasa_retiro", "pueblo")


# ============================================================ 2.5 reshape
@register("level_table", W(f'SELECT nivel AS "Nivel", tasa_promocion AS "% Promoción", tasa_retiro AS "% Retiro" FROM ({o.grouped("nivel")})'))
def q_level_table(spark, sf_dir):
    return rk.display_table(ind.gap_table(decoded(spark, sf_dir), "nivel"), "nivel", "Nivel")


UNPIVOT = (
    f"SELECT area, '% Promoción' AS \"Indicador\", tasa_promocion AS \"Porcentaje\" FROM ({o.grouped('area')}) "
    f"UNION ALL SELECT area, '% Retiro', tasa_retiro FROM ({o.grouped('area')})"
)


@register("unpivot_rates", W(UNPIVOT))
def q_unpivot(spark, sf_dir):
    return rk.unpivot_rates(ind.gap_table(decoded(spark, sf_dir), "area"), "area")


@register("axis_ceiling", W(f'SELECT max("Porcentaje") * CAST(1.2 AS DOUBLE) AS techo FROM ({UNPIVOT})'))
def q_axis_ceiling(spark, sf_dir):
    return rk.axis_ceiling(rk.unpivot_rates(ind.gap_table(decoded(spark, sf_dir), "area"), "area"))


@register(
    "kpi_row",
    W(
        f"SELECT {thousands_sql('total')} AS total_estudiantes, printf('%.1f%%', tasa_promocion) AS promovidos, "
        f"printf('%.1f%%', tasa_no_promocion) AS no_promovidos, printf('%.1f%%', tasa_retiro) AS retirados FROM ({o.NATIONAL})"
    ),
)
def q_kpi_row(spark, sf_dir):
    nat = ind.national_indicators(decoded(spark, sf_dir))
    pct = lambda c: F.concat(one_decimal(c), F.lit("%"))
    return nat.select(
        thousands("total").alias("total_estudiantes"),
        pct("tasa_promocion").alias("promovidos"),
        pct("tasa_no_promocion").alias("no_promovidos"),
        pct("tasa_retiro").alias("retirados"),
    )


# ======================================================== 2.6 comparisons
VS_NATIONAL = (
    "SELECT departamento, total, retirados, tasa_retiro, (SELECT tasa_retiro FROM nat) AS promedio_nacional, "
    "tasa_retiro - (SELECT tasa_retiro FROM nat) AS diferencia FROM s"
)
VS_CTES = f"s AS ({o.DEPARTMENT_SUMMARY}), nat AS ({o.NATIONAL})"


@register("vs_national", W(VS_NATIONAL, VS_CTES))
def q_vs_national(spark, sf_dir):
    return ins.vs_national(decoded(spark, sf_dir))


CLASS_SQL = (
    f"CASE WHEN diferencia >= {ins.CRITICAL_AT} THEN '{ins.CLASS_CRITICAL}' WHEN diferencia >= {ins.ABOVE_AT} THEN '{ins.CLASS_ABOVE}' "
    f"WHEN diferencia <= {ins.BETTER_AT} THEN '{ins.CLASS_BETTER}' ELSE '{ins.CLASS_NEAR}' END"
)
SEVERITY = f"SELECT *, {CLASS_SQL} AS clase FROM ({VS_NATIONAL})"


@register("severity", W(SEVERITY, VS_CTES))
def q_severity(spark, sf_dir):
    return ins.severity(decoded(spark, sf_dir))


def label_gap_sql(dim: str, a: str, b: str) -> str:
    return (
        f"SELECT '{dim}' AS dimension, '{a}' AS label_a, '{b}' AS label_b, tasa_a, tasa_b, tasa_a - tasa_b AS brecha FROM ("
        f"SELECT max(CASE WHEN {dim} = '{a}' THEN tasa_retiro END) AS tasa_a, max(CASE WHEN {dim} = '{b}' THEN tasa_retiro END) AS tasa_b "
        f"FROM ({o.grouped(dim)})) WHERE tasa_a - tasa_b IS NOT NULL"
    )


@register("rural_urban_gap", W(label_gap_sql("area", "Rural", "Urbana")))
def q_rural_urban(spark, sf_dir):
    return ins.rural_urban_gap(decoded(spark, sf_dir))


@register("label_gap", W(label_gap_sql("sector", "Público", "Privado")))
def q_label_gap(spark, sf_dir):
    return ins.label_gap(ind.gap_table(decoded(spark, sf_dir), "sector"), "sector", "Público", "Privado")


def sql_text(template: str) -> str:
    return o.q(template)


def insights_sql(year: bool = True) -> str:
    when = "CAST((SELECT max(anio) FROM d) AS VARCHAR), " if year else ""
    return (
        f"SELECT 1 AS orden, 'panorama' AS tipo, printf({sql_text(ins.OVERVIEW if year else ins.OVERVIEW_NO_YEAR)}, {when}{thousands_sql('total')}, {fmt1('tasa_promocion')}, "
        f"{fmt1('tasa_retiro')}, {thousands_sql(trunc_est('total', 'tasa_retiro'))}) AS texto FROM nat "
        f"UNION ALL SELECT 2, 'zona_critica', printf({sql_text(ins.WORST_PLACE)}, departamento, {fmt1('tasa_retiro')}, {fmt1('diferencia')}, "
        f"{thousands_sql('total')}) FROM (SELECT * FROM ({VS_NATIONAL}) ORDER BY tasa_retiro DESC, departamento LIMIT 1) "
        f"UNION ALL SELECT 3, 'brecha_rural_urbana', printf({sql_text(ins.RURAL_URBAN)}, {fmt1('brecha')}) FROM ({label_gap_sql('area', 'Rural', 'Urbana')}) "
        f"UNION ALL SELECT 4, 'nivel_critico', printf({sql_text(ins.WORST_LEVEL)}, nivel, {fmt1('tasa_retiro')}) FROM "
        f"(SELECT * FROM ({o.grouped('nivel')}) WHERE nivel {CLEAN} ORDER BY tasa_retiro DESC, nivel LIMIT 1)"
    )


INSIGHTS = insights_sql()


@register("insights_national", W(INSIGHTS, VS_CTES))
def q_insights_national(spark, sf_dir):
    return ins.insights_national(decoded(spark, sf_dir))


ADVICE_SQL = "CASE clase " + " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in ins.ADVICE.items()) + " END"
INSIGHTS_DEPT = (
    f"SELECT departamento, clase, printf({sql_text(ins.DEPARTMENT)}, departamento, {thousands_sql('total')}, {fmt1('tasa_retiro')}, "
    f"printf('%+.1f', diferencia), {fmt1('promedio_nacional')}, {thousands_sql(trunc_est('total', 'tasa_retiro'))}, clase, {ADVICE_SQL}) AS texto "
    f"FROM ({SEVERITY})"
)


@register("insights_department", W(INSIGHTS_DEPT, VS_CTES))
def q_insights_department(spark, sf_dir):
    return ins.insights_department(decoded(spark, sf_dir))


# ======================================================= 2.7 context / O1
def _j(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def _share_map(dim: str) -> str:
    return (
        f"(SELECT '{{' || string_agg({_j('label')} || ':' || {_j('pct')}, ',' ORDER BY n DESC, label) || '}}' "
        f"FROM sh WHERE dimension = '{dim}')"
    )


INDICATORS_OBJ = (
    "'{\"total_estudiantes\":' || " + _j("nat.total") + " || ',\"tasa_promocion\":' || " + _j("nat.tasa_promocion")
    + " || ',\"tasa_no_promocion\":' || " + _j("nat.tasa_no_promocion") + " || ',\"tasa_retiro\":' || " + _j("nat.tasa_retiro")
    + "".join(f" || ',\"por_{d}\":' || {_share_map(d)}" for d in ind.SHARE_DIMS)
    + " || '}'"
)
INSIGHTS_ARR = f"(SELECT {_j('list(texto ORDER BY orden)')} FROM it)"


def doc_ctes(year: bool = True) -> str:
    return f"{VS_CTES}, sh AS ({share_all_sql(ind.SHARE_DIMS)}), it AS ({insights_sql(year)})"


DOC_CTES = doc_ctes()
INDICATORS_DOC = (
    "SELECT '{\"indicadores\":' || " + INDICATORS_OBJ + " || ',\"insights\":' || " + INSIGHTS_ARR
    + " || ',\"promedio_retiro_nacional\":' || " + _j("nat.tasa_retiro") + " || '}' AS documento FROM nat"
)


def _records_sql(fields, order: str, source: str) -> str:
    pack = ", ".join(f"{f} := {f}" for f in fields)
    return f"(SELECT {_j(f'list(struct_pack({pack}) ORDER BY {order})')} FROM ({source}))"


CONTEXT_DOC = (
    "SELECT '{\"indicadores\":' || " + INDICATORS_OBJ + " || ',\"insights\":' || " + INSIGHTS_ARR
    + " || ',\"promedio_retiro\":' || " + _j("nat.tasa_retiro")
    + " || ',\"por_departamento\":' || "
    + _records_sql(["departamento", "total", "tasa_promocion", "tasa_retiro"], "tasa_retiro DESC, departamento", "SELECT * FROM s")
    + "".join(
        f" || ',\"brecha_{d}\":' || "
        + _records_sql([d, "total", "promovidos", "retirados", "tasa_promocion", "tasa_retiro"], d, o.grouped(d))
        for d in ["area", "sector", "nivel"]
    )
    + " || '}' AS contexto FROM nat"
)


@register("context_document", W(CONTEXT_DOC, DOC_CTES))
def q_context(spark, sf_dir):
    return ans.context_document(decoded(spark, sf_dir))


@register("context_outputs", W(CONTEXT_DOC, doc_ctes(year=False)))
def q_context_outputs(spark, sf_dir):
    """The context from the files the batch has written."""
    return pl.context(spark, pipeline_out(spark, sf_dir))


@register("indicators_json", W(INDICATORS_DOC, DOC_CTES))
def q_indicators_json(spark, sf_dir):
    return ans.indicators_document(decoded(spark, sf_dir))


# ================================================ 2.1 sources and sinks
CSV_CATALOGUE = {k: v.replace(".xlsx", ".csv") for k, v in DEPARTMENT_FILES.items()}


def exported(spark: SparkSession, sf_dir: str) -> str:
    """The fixture written as per-department CSV files named by the catalogue,
    in a new folder for each call."""
    return files.export_departments(enrolments(spark, sf_dir), fresh_dir(spark, "departamentos"), DEPARTMENT_FILES, "csv")


def pipeline_out(spark: SparkSession, sf_dir: str) -> str:
    """Runs the whole batch (O1), returns its output folder."""
    out = fresh_dir(spark, "salida")
    pl.run_pipeline(spark, exported(spark, sf_dir), out, CSV_CATALOGUE, "csv")
    return out


@register("scan_departments", W("SELECT * FROM e"))
def q_scan_departments(spark, sf_dir):
    return files.scan_departments(spark, exported(spark, sf_dir), CSV_CATALOGUE, "csv")


STEM_SQL = "CASE departamento_f " + " ".join(f"WHEN {k} THEN {o.q(files.stem_of(v))}" for k, v in DEPARTMENT_FILES.items()) + " END"


@register("stamp_department", W(f"SELECT {STEM_SQL} AS archivo, departamento_f, count(*) AS n FROM e GROUP BY ALL"))
def q_stamp_department(spark, sf_dir):
    folder = exported(spark, sf_dir)
    paths = list(files.existing_files(spark, folder, CSV_CATALOGUE).values())
    raw = files.scan_csv(spark, paths)
    stamped = files.stamp_department(raw.drop("departamento_f").withColumn("departamento_f", F.lit(None).cast("int")), CSV_CATALOGUE, F.col("_file"))
    return stamped.groupBy(files.file_stem(F.col("_file"), CSV_CATALOGUE).alias("archivo"), "departamento_f").agg(F.count(F.lit(1)).alias("n"))


TRIAL = ", ".join(str(d) for d in TRIAL_DEPARTMENTS)


@register("trial_subset", W(f"SELECT * FROM d WHERE departamento_f_codigo IN ({TRIAL})"))
def q_trial_subset(spark, sf_dir):
    return files.trial_subset(spark, f"{pipeline_out(spark, sf_dir)}/{pl.PROCESSED}")


@register("scan_processed", W("SELECT * FROM d"))
def q_scan_processed(spark, sf_dir):
    return files.scan_processed(spark, f"{pipeline_out(spark, sf_dir)}/{pl.PROCESSED}")


@register("union_departments", W("SELECT * REPLACE (CASE WHEN departamento_f % 2 = 1 THEN NULL ELSE graduando END AS graduando) FROM e"))
def q_union_departments(spark, sf_dir):
    folder = exported(spark, sf_dir)
    even = files.scan_departments(spark, folder, CSV_CATALOGUE, "csv", only=[k for k in DEPARTMENT_FILES if k % 2 == 0])
    odd = files.scan_departments(spark, folder, CSV_CATALOGUE, "csv", only=[k for k in DEPARTMENT_FILES if k % 2 == 1])
    return files.union_departments([even, odd.drop("graduando")])


SAMPLE_HASH = "md5(concat_ws('|', '42', " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in dec.DECODED_ORDER) + "))"


@register("sample_exact", W(f"SELECT * FROM d ORDER BY {SAMPLE_HASH} LIMIT 5000"))
def q_sample_exact(spark, sf_dir):
    return files.sample_exact(decoded(spark, sf_dir), 5000, 42)


@register("pipeline_summary", W(o.DEPARTMENT_SUMMARY))
def q_pipeline_summary(spark, sf_dir):
    return pl.read_summary(spark, pipeline_out(spark, sf_dir))


@register("pipeline_gaps", W(GAP_ALL))
def q_pipeline_gaps(spark, sf_dir):
    return spark.read.parquet(f"{pipeline_out(spark, sf_dir)}/{pl.GAPS}")


@register(
    "scan_indicators_json",
    W(
        "SELECT total AS total_estudiantes, tasa_promocion, tasa_no_promocion, tasa_retiro, "
        f"tasa_retiro AS promedio_retiro_nacional FROM ({o.NATIONAL})"
    ),
)
def q_scan_indicators_json(spark, sf_dir):
    doc = files.scan_indicators_json(spark, f"{pipeline_out(spark, sf_dir)}/{pl.INDICATORS}")
    return doc.select("indicadores.total_estudiantes", "indicadores.tasa_promocion", "indicadores.tasa_no_promocion", "indicadores.tasa_retiro", "promedio_retiro_nacional")


@register(
    "pipeline_cube",
    W("SELECT departamento, area, sector, sexo, nivel, pueblo, resultado, count(*) AS n FROM d GROUP BY ALL"),
)
def q_pipeline_cube(spark, sf_dir):
    return spark.read.parquet(f"{pipeline_out(spark, sf_dir)}/{pl.CUBE}")


# ===================================================== 2.8 spec controls
def seg_sql(c: str, i: int) -> str:
    return f"(CASE WHEN len(string_split({c}, '-')) >= {i} THEN string_split({c}, '-')[{i}] END)"


@register(
    "code_segments",
    W(
        "SELECT cod_establecimiento, "
        + ", ".join(f"{seg_sql('cod_establecimiento', i)} AS {n}" for i, n in enumerate(["seg_departamento", "seg_municipio", "seg_establecimiento", "seg_nivel"], 1))
        + " FROM d"
    ),
)
def q_code_segments(spark, sf_dir):
    return qual.code_segments(decoded(spark, sf_dir))


SEG_LEVEL_SQL = "CASE " + seg_sql("cod_establecimiento", 4) + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_LEVEL.items()) + " END"


@register(
    "level_mismatch",
    W(
        f"SELECT nivel_codigo AS nivel_declarado, {SEG_LEVEL_SQL} AS nivel_segmento, count(*) AS n, "
        f"COALESCE(nivel_codigo = {SEG_LEVEL_SQL}, false) AS coincide FROM d GROUP BY ALL"
    ),
)
def q_level_mismatch(spark, sf_dir):
    return qual.level_mismatch(decoded(spark, sf_dir))


_WS = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)
MUNI_COUNTS = (
    "SELECT CASE WHEN grouping(departamento_f) = 1 THEN 'nacional' ELSE 'departamento' END AS ambito, "
    "CASE WHEN grouping(departamento_f) = 0 THEN departamento_f END AS departamento_f, "
    "count(DISTINCT m_raw) AS municipios_sin_reparar, count(DISTINCT m_fixed) AS municipios FROM ("
    f"SELECT DISTINCT departamento_f, {o.municipality_sql(f'trim(cod_establecimiento, {_WS})')} AS m_raw, "
    f"{o.municipality_sql(o.NORM)} AS m_fixed FROM e) "
    "GROUP BY ROLLUP (departamento_f) HAVING grouping(departamento_f) = 1 OR departamento_f IS NOT NULL"
)


@register("municipality_counts", W(MUNI_COUNTS))
def q_municipality_counts(spark, sf_dir):
    return qual.municipality_counts(enrolments(spark, sf_dir))


SCHOOL_SQL = (
    "CASE WHEN len(string_split(cod_establecimiento, '-')) >= 3 THEN split_part(cod_establecimiento, '-', 1) || '-' || "
    "split_part(cod_establecimiento, '-', 2) || '-' || split_part(cod_establecimiento, '-', 3) END"
)


@register(
    "school_counts",
    W(f"SELECT departamento, count(DISTINCT {SCHOOL_SQL}) AS establecimientos, count(DISTINCT cod_establecimiento) AS codigos FROM d GROUP BY departamento"),
)
def q_school_counts(spark, sf_dir):
    return qual.school_counts(decoded(spark, sf_dir))


LO = "CASE nivel_codigo " + " ".join(f"WHEN {k} THEN {a}" for k, (a, _) in GRADE_RANGES.items()) + " END"
HI = "CASE nivel_codigo " + " ".join(f"WHEN {k} THEN {b}" for k, (_, b) in GRADE_RANGES.items()) + " END"


@register(
    "grade_coherence",
    W(
        f"SELECT nivel, count(*) AS filas, count(CASE WHEN grado BETWEEN {LO} AND {HI} THEN 1 END) AS en_rango, "
        f"count(CASE WHEN NOT (grado BETWEEN {LO} AND {HI}) THEN 1 END) AS fuera_de_rango, "
        f"count(CASE WHEN ({LO}) IS NULL OR grado IS NULL THEN 1 END) AS sin_rango FROM d GROUP BY nivel"
    ),
)
def q_grade_coherence(spark, sf_dir):
    return qual.grade_coherence(decoded(spark, sf_dir))


CONST_COLS = ("depto_mupio", "anio")


@register(
    "constant_columns",
    W(
        " UNION ALL ".join(
            f"SELECT departamento_f, '{c}' AS columna, CAST(min({c}) AS BIGINT) AS minimo, CAST(max({c}) AS BIGINT) AS maximo, "
            f"min({c}) = max({c}) AS constante FROM e GROUP BY departamento_f"
            for c in CONST_COLS
        )
    ),
)
def q_constant_columns(spark, sf_dir):
    return qual.constant_columns(enrolments(spark, sf_dir), "departamento_f", CONST_COLS)


PROFILE_COLS = [c for c in RAW_COLUMNS if c in dec.DECODE_SPEC]


@register(
    "code_profile",
    W(
        f"SELECT *, {o.rate('ignorados', 'filas')} AS pct_ignorados FROM ("
        + " UNION ALL ".join(
            f"SELECT count(*) AS filas, '{c}' AS columna, count(CASE WHEN {c} IS NULL THEN 1 END) AS nulos, "
            f"count(CASE WHEN {c} = 9 THEN 1 END) AS ignorados FROM e"
            for c in PROFILE_COLS
        )
        + ")"
    ),
)
def q_code_profile(spark, sf_dir):
    return qual.code_profile(enrolments(spark, sf_dir), PROFILE_COLS)


EXPECTED_VALUES = ", ".join(f"({o.q(d)}, {o.q(lbl)}, CAST({v} AS DOUBLE))" for d, labels in CONTROL_SHARES.items() for lbl, v in labels.items())
CONTROL = (
    "SELECT x.dimension, x.label, x.esperado, g.pct AS calculado, g.pct - x.esperado AS diferencia, "
    "COALESCE(round(abs(g.pct - x.esperado) * 10) <= 1, false) AS dentro_tolerancia "
    f"FROM (VALUES {EXPECTED_VALUES}) x(dimension, label, esperado) LEFT JOIN ({share_all_sql(sorted(CONTROL_SHARES))}) g "
    "ON x.dimension = g.dimension AND x.label = g.label"
)


@register("control_check", W(CONTROL))
def q_control_check(spark, sf_dir):
    return qual.control_check(decoded(spark, sf_dir))


TOTALS = (
    "SELECT 'inscripciones' AS control, count(*) AS calculado FROM d "
    f"UNION ALL SELECT 'municipios_guatemala', count(DISTINCT municipio_codigo) FROM d WHERE departamento = 'Guatemala' "
    "UNION ALL SELECT 'municipios', count(DISTINCT municipio_codigo) FROM d"
)


@register(
    "control_totals",
    W(
        "SELECT t.control, x.esperado, t.calculado, x.aproximado, "
        "CASE WHEN x.aproximado THEN abs(t.calculado - x.esperado) * 50 <= x.esperado ELSE t.calculado = x.esperado END AS cumple "
        f"FROM ({TOTALS}) t JOIN (VALUES ('inscripciones', CAST(4298887 AS BIGINT), false), ('municipios_guatemala', 17, false), ('municipios', 340, true)) "
        "x(control, esperado, aproximado) ON t.control = x.control"
    ),
)
def q_control_totals(spark, sf_dir):
    return qual.control_totals(decoded(spark, sf_dir))


CATALOGUE_VALUES = ", ".join(f"({k}, {o.q(DEPARTAMENTOS[k])}, CAST({DEPARTMENT_RECORDS[k]} AS BIGINT))" for k in DEPARTAMENTOS)
RECONCILE = (
    "SELECT COALESCE(c.departamento_f, k.departamento_f) AS departamento_f, CAST(COALESCE(c.registros, 0) AS BIGINT) AS registros, "
    "k.departamento, k.registros_publicados, CAST(COALESCE(c.registros, 0) AS BIGINT) - k.registros_publicados AS diferencia "
    "FROM (SELECT departamento_f, count(*) AS registros FROM e GROUP BY departamento_f) c "
    f"FULL OUTER JOIN (VALUES {CATALOGUE_VALUES}) k(departamento_f, departamento, registros_publicados) ON c.departamento_f = k.departamento_f"
)


@register("record_reconcile", W(RECONCILE))
def q_record_reconcile(spark, sf_dir):
    return qual.record_reconcile(enrolments(spark, sf_dir))


REPEAT = (
    f"SELECT *, {o.rate('repitentes', 'total')} AS tasa_repitencia, {o.rate('graduandos', 'total')} AS tasa_graduacion FROM ("
    "SELECT CASE WHEN grouping(departamento) = 1 THEN 'nacional' ELSE 'departamento' END AS ambito, "
    "CASE WHEN grouping(departamento) = 0 THEN departamento END AS departamento, count(*) AS total, "
    "count(CASE WHEN repitente = 'Sí' THEN 1 END) AS repitentes, count(CASE WHEN graduando = 'Sí' THEN 1 END) AS graduandos "
    "FROM d GROUP BY ROLLUP (departamento) HAVING grouping(departamento) = 1 OR departamento IS NOT NULL)"
)


@register("repeat_graduate_rates", W(REPEAT))
def q_repeat(spark, sf_dir):
    return qual.repeat_graduate_rates(decoded(spark, sf_dir))


@register("filtered_count", W("SELECT count(*) AS n FROM d WHERE nivel = 'Primaria' AND departamento = 'Alta Verapaz'"))
def q_filtered_count(spark, sf_dir):
    return ans.filtered_count(decoded(spark, sf_dir), nivel="Primaria", departamento="Alta Verapaz")


@register(
    "argmin_group",
    W(f"SELECT * FROM ({o.grouped('departamento', True, source='(SELECT * FROM d WHERE nivel = ' + o.q('Básico') + ')')}) ORDER BY tasa_promocion, departamento LIMIT 1"),
)
def q_argmin_group(spark, sf_dir):
    return ans.argmin_group(decoded(spark, sf_dir), "departamento", "tasa_promocion", nivel="Básico")


MUNI_SUMMARY = (
    f"SELECT *, {o.rate_cols(True)} FROM (SELECT departamento, municipio_codigo, {o.outcome_cols()} FROM d "
    "WHERE departamento IS NOT NULL AND municipio_codigo IS NOT NULL GROUP BY departamento, municipio_codigo)"
)


@register("municipality_summary", W(MUNI_SUMMARY))
def q_municipality_summary(spark, sf_dir):
    return qual.municipality_summary(decoded(spark, sf_dir))


@register(
    "municipality_names",
    W(
        "SELECT departamento, municipio_codigo, count(*) AS n, replace(municipio_codigo, '-', '') AS codigo, "
        "CASE WHEN substr(municipio_codigo, 5, 1) <> '9' THEN 'Municipio ' || replace(municipio_codigo, '-', '') END AS municipio "
        "FROM d WHERE municipio_codigo IS NOT NULL GROUP BY departamento, municipio_codigo"
    ),
)
def q_municipality_names(spark, sf_dir):
    """With a catalogue built from the data's own codes, those ending in 9 left out."""
    view = decoded(spark, sf_dir)
    codes = view.select(F.replace("municipio_codigo", F.lit("-"), F.lit("")).alias("codigo")).distinct()
    names = codes.where(~F.col("codigo").endswith("9")).withColumn("municipio", F.concat(F.lit("Municipio "), "codigo"))
    return qual.municipality_names(view, names)


def facts_sql() -> str:
    nat = " UNION ALL ".join(
        f"SELECT 'nacional' AS dimension, 'Total' AS label, 'indicadores_nacionales' AS fuente, '{m}' AS metrica, CAST({m} AS DOUBLE) AS valor FROM ({o.NATIONAL})"
        for m in ["total", "tasa_promocion", "tasa_no_promocion", "tasa_retiro"]
    )
    dep = " UNION ALL ".join(
        f"SELECT 'departamento', departamento, 'resumen_departamentos', '{m}', CAST({m} AS DOUBLE) FROM ({o.DEPARTMENT_SUMMARY})"
        for m in ["total", "tasa_promocion", "tasa_no_promocion", "tasa_retiro"]
    )
    gaps = " UNION ALL ".join(
        f"SELECT dimension, label, 'brecha_' || dimension, '{m}', CAST({m} AS DOUBLE) FROM ({GAP_ALL})"
        for m in ["total", "tasa_promocion", "tasa_retiro"]
    )
    base = f"SELECT *, CAST(NULL AS VARCHAR) AS texto FROM ({nat} UNION ALL {dep} UNION ALL {gaps})"
    said = f"CASE WHEN metrica = 'total' THEN {thousands_sql('CAST(valor AS BIGINT)')} ELSE printf('%.1f%%', valor) END"
    top = (
        f"SELECT dimension, {o.q(ans.HIGHEST)}, fuente, metrica, valor, label || ': ' || {said} FROM (SELECT *, "
        "row_number() OVER (PARTITION BY dimension, metrica ORDER BY valor DESC NULLS LAST, label) AS k "
        f"FROM ({base}) WHERE dimension <> 'nacional' AND label {CLEAN} AND valor IS NOT NULL) WHERE k = 1"
    )
    overview = f"SELECT 'nacional', 'Total', 'indicadores_nacionales', '{ans.OVERVIEW_METRIC}', CAST(nat.total AS DOUBLE), it.texto FROM nat, it WHERE it.orden = 1"
    return f"{base} UNION ALL {top} UNION ALL {overview}"


QUESTION_VALUES = ", ".join(f"({i}, {o.q(p)}, {o.q(d)}, {o.q(lbl)}, {o.q(m)})" for i, p, d, lbl, m in ans.SAMPLE_QUESTIONS)
ANSWERS = (
    "SELECT q.pregunta_id, q.pregunta, q.dimension, q.label, q.metrica, f.valor, "
    f"CASE WHEN f.valor IS NULL THEN {o.q(ans.NOT_AVAILABLE)} WHEN f.texto IS NOT NULL THEN f.texto WHEN q.metrica = 'total' THEN {thousands_sql('CAST(f.valor AS BIGINT)')} "
    "ELSE printf('%.1f%%', f.valor) END AS respuesta, f.fuente "
    f"FROM (VALUES {QUESTION_VALUES}) q(pregunta_id, pregunta, dimension, label, metrica) "
    f"LEFT JOIN ({facts_sql()}) f ON q.dimension = f.dimension AND q.label = f.label AND q.metrica = f.metrica"
)


@register("answer_batch", W(ANSWERS, f"{VS_CTES}, it AS ({INSIGHTS})"))
def q_answer_batch(spark, sf_dir):
    return ans.answer_batch(decoded(spark, sf_dir), ans.questions(spark))


# ============================================================ streaming
def streamed_out(spark: SparkSession, sf_dir: str) -> str:
    """Runs the incremental ingest and cube streams over a new landing folder."""
    out, landing = fresh_dir(spark, "stream"), exported(spark, sf_dir)
    q1 = st.start_ingest(spark, landing, f"{out}/processed", CSV_CATALOGUE, checkpoint=f"{out}/_ckpt_ingest")
    q2 = st.start_cube(spark, landing, f"{out}/cube", CSV_CATALOGUE, checkpoint=f"{out}/_ckpt_cube")
    q1.awaitTermination()
    q2.awaitTermination()
    return out


@register("stream_ingest", W("SELECT * FROM d"))
def q_stream_ingest(spark, sf_dir):
    return files.scan_processed(spark, f"{streamed_out(spark, sf_dir)}/processed")


@register(
    "stream_cube",
    W("SELECT departamento, area, sector, sexo, nivel, pueblo, resultado, count(*) AS n FROM d GROUP BY ALL"),
)
def q_stream_cube(spark, sf_dir):
    return st.read_cube(spark, f"{streamed_out(spark, sf_dir)}/cube")


# ================================================= 2.9 time and versions
from . import events, versions  # noqa: E402, F401  (they register their queries)

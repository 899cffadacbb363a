import pytest
from pyspark.sql import functions as F

from pizarra.functions.dictionary import UNKNOWN
from pizarra.operators import answers as ans
from pizarra.operators import decode as dec
from pizarra.operators import indicators as ind
from pizarra.operators import insights as ins
from pizarra.operators import quality as qual
from pizarra.operators import ranking as rk
from pizarra.sources.files import RAW_SCHEMA

# anio, cod, depto, depto_mupio, sector, area, sexo, grado, nivel, pueblo, plan, jornada, resultado, repitente, graduando
ROWS = [
    (2024, "00-01-0001-42", 1, 101, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2),
    (2024, " 01-01-0001-43", 1, 101, 1, 2, 2, 2, 2, 2, 1, 1, 3, 2, 2),
    (2024, "01-02-0002-45\t", 1, 101, 2, 2, 1, 1, 3, 9, 2, 2, 5, 9, 1),
    (2024, None, 2, 201, 8, 9, 9, 4, 4, 5, 1, 9, None, 1, 1),
    (2024, "02-01-0003-46", 2, 201, 1, 1, 2, 5, 4, 5, 3, 3, 4, 2, 2),
    (2024, "02-01", 2, 201, 1, 2, 1, 9, 9, 6, 4, 4, 2, 2, 9),
    (2024, "19", 19, 1901, 3, 2, 1, 3, 2, 1, 5, 5, 3, 2, 2),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, RAW_SCHEMA)


@pytest.fixture(scope="module")
def decoded(raw):
    return dec.decode_all(raw).cache()


def test_decode_null_unmapped_and_ignored(decoded):
    rows = {r["grado"]: r for r in decoded.collect()}
    assert rows[4]["sector"] == UNKNOWN and rows[4]["sector_codigo"] == 8  # unmapped
    assert rows[4]["resultado"] == UNKNOWN and rows[4]["resultado_f_codigo"] is None  # null
    assert rows[4]["area"] == "Ignorado"  # 9 is a real value
    assert rows[4]["municipio_codigo"] is None and rows[4]["cod_establecimiento"] is None
    assert rows[9]["municipio_codigo"] == "02-01"
    assert rows[3]["municipio_codigo"] is None  # fewer than two segments


def test_decode_layout_and_row_count(raw, decoded):
    assert decoded.columns == dec.DECODED_ORDER
    assert len(decoded.columns) == 27
    assert decoded.count() == raw.count()


def test_decode_prefix_repair(decoded):
    codes = sorted(r[0] for r in decoded.select("cod_establecimiento").collect() if r[0])
    assert "01-01-0001-42" in codes and not any(c.startswith("00-") or c != c.strip() for c in codes)


def test_decode_only_present_columns(spark):
    df = spark.createDataFrame([(1, 2, "x")], "sector int, area int, other string")
    out = dec.decode_all(df)
    assert out.columns == ["sector", "area", "sector_codigo", "area_codigo", "other"]
    assert tuple(out.first()) == ("Público", "Rural", 1, 2, "x")


def test_decode_code_typing(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (None,)], "sector double")
    assert [r[0] for r in dec.decode_all(df).select("sector").collect()] == ["Público", UNKNOWN, UNKNOWN]
    txt = spark.createDataFrame([("1",), ("x",)], "sector string")
    assert [r[0] for r in dec.decode_all(txt).select("sector").collect()] == ["Público", UNKNOWN]


def test_decode_join_equals_map_decode(raw, decoded):
    joined = dec.decode_join(dec.with_municipality(raw)).select(*dec.DECODED_ORDER)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, decoded.collect()), key=str)


def test_national_uses_row_count(decoded):
    r = ind.national_indicators(decoded).first()
    assert (r.total, r.promovidos, r.no_promovidos, r.retirados) == (7, 1, 1, 3)
    assert r.tasa_retiro == round(3 / 7 * 100, 1)


def test_group_total_counts_non_null_outcomes(raw):
    rows = {r.departamento_f: r for r in ind.count_semantics(raw).collect()}
    assert (rows[2].filas, rows[2].total_resultado, rows[2].sin_resultado) == (3, 2, 1)


def test_cube_rollups_equal_direct(decoded):
    cube = ind.outcome_cube(decoded)
    assert cube.agg(F.sum("n")).first()[0] == decoded.count()
    pairs = [
        (ind.department_summary(decoded), ind.department_summary(cube, "n")),
        (ind.gap_all(decoded), ind.gap_all(cube, weight="n")),
        (ind.national_indicators(decoded), ind.national_indicators(cube, "n")),
        (ind.shares_all(decoded), ind.shares_all(cube, weight="n")),
    ]
    for direct, rolled in pairs:
        assert sorted(map(tuple, direct.collect()), key=str) == sorted(map(tuple, rolled.collect()), key=str)


def test_gap_all_matches_single_tables(decoded):
    long = ind.gap_all(decoded)
    for dim in ind.GAP_DIMS:
        one = {tuple(r) for r in ind.gap_table(decoded, dim).collect()}
        part = {tuple(r)[1:] for r in long.where(F.col("dimension") == dim).collect()}
        assert one == part


def test_shares_sum_to_100(decoded):
    for dim in ind.SHARE_DIMS:
        total = sum(r.pct for r in ind.share(decoded, dim).collect())
        assert abs(total - 100) <= 0.1 * 6


def test_empty_input_gives_null_rates(spark):
    empty = dec.decode_all(spark.createDataFrame([], RAW_SCHEMA))
    r = ind.national_indicators(empty).first()
    assert r.total == 0 and r.tasa_retiro is None
    assert ind.department_summary(empty).count() == 0


def test_ranking_ties_break_by_label(spark):
    df = spark.createDataFrame([("B", 5.0), ("A", 5.0), ("C", 7.0)], "departamento string, tasa_retiro double")
    assert [r.departamento for r in rk.ranked(df, "tasa_retiro", "departamento").collect()] == ["C", "A", "B"]
    assert [r.departamento for r in rk.top_k(df, "tasa_retiro", "departamento", 2).collect()] == ["C", "A"]


def test_rural_urban_gap_absent_side(spark):
    only_rural = spark.createDataFrame([("Rural", 4.0)], "area string, tasa_retiro double")
    assert ins.label_gap(only_rural, "area", "Rural", "Urbana").count() == 0


def test_insights_skip_absent_rural_side(spark):
    rows = [r for r in ROWS if r[5] != 1]  # no urban rows
    d = dec.decode_all(spark.createDataFrame(rows, RAW_SCHEMA))
    kinds = [r.tipo for r in ins.insights_national(d).orderBy("orden").collect()]
    assert kinds == ["panorama", "zona_critica", "nivel_critico"]


def test_vs_national_and_severity(decoded):
    sev = {r.departamento: r for r in ins.severity(decoded).collect()}
    nat = ind.national_indicators(decoded).first().tasa_retiro
    for r in sev.values():
        assert r.promedio_nacional == nat
        assert r.diferencia == r.tasa_retiro - nat


def test_unpivot_and_ceiling(decoded):
    long = rk.unpivot_rates(ind.gap_table(decoded, "area"), "area")
    assert {r.Indicador for r in long.collect()} == {"% Promoción", "% Retiro"}
    top = max(r.Porcentaje for r in long.collect())
    assert rk.axis_ceiling(long).first().techo == top * 1.2


def test_quality_checks(raw, decoded):
    muni = {(r.ambito, r.departamento_f): r for r in qual.municipality_counts(raw).collect()}
    assert muni[("departamento", 1)].municipios_sin_reparar == 3  # 00-01, 01-01, 01-02
    assert muni[("departamento", 1)].municipios == 2
    grade = {r.nivel: r for r in qual.grade_coherence(decoded).collect()}
    assert grade["Ignorado"].sin_rango == 1
    const = {(r.departamento_f, r.columna): r.constante for r in qual.constant_columns(raw).collect()}
    assert all(const.values())
    prof = {r.columna: r for r in qual.code_profile(raw, ["area", "resultado_f"]).collect()}
    assert prof["area"].ignorados == 1 and prof["resultado_f"].nulos == 1


def test_answers_not_available(spark, decoded):
    asked = ans.questions(spark)
    out = {r.pregunta_id: r for r in ans.answer_batch(decoded, asked).collect()}
    assert out[7].respuesta == ans.NOT_AVAILABLE and out[7].fuente is None
    assert out[1].respuesta == "7" and out[1].fuente == "indicadores_nacionales"


def test_context_document_is_valid_json(decoded):
    import json

    doc = json.loads(ans.context_document(decoded).first()[0])
    assert list(doc) == ["indicadores", "insights", "promedio_retiro", "por_departamento", "brecha_area", "brecha_sector", "brecha_nivel"]
    assert doc["indicadores"]["total_estudiantes"] == 7
    assert [d["departamento"] for d in doc["por_departamento"]] == [
        r.departamento for r in ind.department_summary(decoded).collect()
    ]
    assert set(doc["por_departamento"][0]) == {"departamento", "total", "tasa_promocion", "tasa_retiro"}
    assert "brecha_pueblo" not in doc


def test_schema_conformance(raw):
    rows = {r.columna: r for r in qual.schema_conformance(raw).collect()}
    assert all(rows[c].presente and rows[c].esperada for c in raw.columns)
    assert len([r for r in rows.values() if r.esperada]) == 15
    assert rows["modalidad"].presente is False and rows["modalidad"].esperada is False
    missing = {r.columna: r for r in qual.schema_conformance(raw.drop("graduando").withColumn("extra", F.lit(1))).collect()}
    assert missing["graduando"].presente is False and missing["extra"].esperada is False

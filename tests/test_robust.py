"""What the sources must not lose, what must not be reused, and published
values written out here instead of being taken from the library."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from pizarra.functions import dictionary as dic
from pizarra.operators import answers as ans
from pizarra.operators import decode as dec
from pizarra.operators import indicators as ind
from pizarra.operators import insights as ins
from pizarra.operators import quality as qual
from pizarra.plans import pipeline as pl
from pizarra.plans.queries import REGISTRY
from pizarra.session import build_session
from pizarra.sources import files
from pizarra.sources.fixture import RAW_COLUMNS, enrolments
from pizarra.sources.xlsx import HEADERS
from pizarra.streaming import ingest as st

from .xlsx_writer import write_xlsx

ROW = [2024, "01-02-0003-43", 1, 101, 1, 2, 1, 3, 2, 1, 1, 1, 1, 2, 2]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- work on every call


@pytest.fixture
def small_copy(tmp_path, sf_small):
    for name in ("lineitem", "orders", "customer"):
        shutil.copy(f"{sf_small}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["scan_departments", "pipeline_cube", "stream_ingest"])
def test_a_replaced_table_is_seen(spark, small_copy, sf_small, name):
    def rows():
        df = REGISTRY[name].fn(spark, small_copy)
        return df.agg(F.sum("n")).first()[0] if "n" in df.columns else df.count()

    before = rows()
    fewer = spark.read.parquet(f"{sf_small}/lineitem.parquet").limit(1000)
    fewer.write.parquet(f"{small_copy}/new")
    os.remove(f"{small_copy}/lineitem.parquet")
    shutil.copytree(f"{small_copy}/new", f"{small_copy}/lineitem.parquet")
    assert before == 6005 or before > 1000
    assert rows() == 1000


def test_export_again_after_an_interrupted_run(spark, sf_small, tmp_path):
    raw = enrolments(spark, sf_small)
    folder = str(tmp_path / "out")
    files.export_departments(raw, folder)
    shutil.copytree(f"{folder}/guatemala.csv", f"{folder}/_staging-old/archivo=guatemala.csv")  # what a crash may leave
    files.export_departments(raw.where("departamento_f < 5"), folder)
    got = files.scan_departments(spark, folder, {k: v.replace(".xlsx", ".csv") for k, v in dic.DEPARTMENT_FILES.items()}, "csv")
    assert got.where("departamento_f < 5").count() == raw.where("departamento_f < 5").count()
    assert got.count() == raw.count()


def test_export_fails_on_rows_outside_the_catalogue(spark, sf_small, tmp_path):
    raw = enrolments(spark, sf_small).limit(5).withColumn("departamento_f", F.lit(77))
    with pytest.raises(Exception, match="outside the catalogue"):
        files.export_departments(raw, str(tmp_path / "out"))


# --- readers


def _csv(folder, name, header, rows):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def test_csv_is_bound_by_header(spark, tmp_path):
    by = dict(zip(RAW_COLUMNS, ROW))
    swapped = ["area", "sector", *[c for c in RAW_COLUMNS if c not in ("area", "sector")]]
    lacking = [c for c in RAW_COLUMNS if c != "sector"]
    extra = ["nota", *RAW_COLUMNS]
    _csv(tmp_path, "guatemala.csv", swapped, [[by[c] for c in swapped]])
    _csv(tmp_path, "solola.csv", lacking, [[by[c] for c in lacking]])
    _csv(tmp_path, "peten.csv", list(HEADERS), [ROW])
    _csv(tmp_path, "izabal.csv", extra, [["x", *ROW]])
    got = files.scan_departments(spark, str(tmp_path), {1: "guatemala.csv", 7: "solola.csv", 17: "peten.csv", 18: "izabal.csv"}, "csv")
    rows = {r["departamento_f"]: r for r in got.collect()}
    assert got.columns == RAW_COLUMNS and set(rows) == {1, 7, 17, 18}
    for dep, r in rows.items():
        want = {**by, "departamento_f": dep, "sector": None if dep == 7 else by["sector"]}
        assert r.asDict() == want


def test_csv_without_code_or_outcome_is_an_error(spark, tmp_path):
    _csv(tmp_path, "guatemala.csv", ["sector", "area"], [[1, 2]])
    with pytest.raises(ValueError, match="lacks"):
        files.scan_departments(spark, str(tmp_path), {1: "guatemala.csv"}, "csv")


def test_stream_rejects_another_header(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    swapped = ["sector", *[c for c in RAW_COLUMNS if c != "sector"]]
    _csv(tmp_path / "in", "guatemala.csv", swapped, [[1] * len(swapped)])
    q = st.start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), {1: "guatemala.csv"}, checkpoint=str(tmp_path / "ck"))
    with pytest.raises(Exception):
        q.awaitTermination()


def test_workbook_notes_first_and_two_data_sheets(spark, tmp_path):
    other = [*ROW[:4], 2, *ROW[5:]]
    write_xlsx(str(tmp_path / "a.xlsx"), ["Sexo", "nota"], [[1, "x"]], 1, more=[(list(HEADERS), [ROW, ROW]), (["solo"], []), (list(HEADERS), [other])])
    got = files.scan_departments(spark, str(tmp_path), {1: "a.xlsx"}, "xlsx")
    assert sorted(r["sector"] for r in got.collect()) == [1, 1, 2]


def test_workbook_without_data_sheet_is_an_error(spark, tmp_path):
    write_xlsx(str(tmp_path / "a.xlsx"), ["Sexo", "nota"], [[1, "x"]])
    with pytest.raises(Exception, match="no sheet has"):
        files.scan_departments(spark, str(tmp_path), {1: "a.xlsx"}, "xlsx").collect()


def test_workbook_code_over_32_bits_is_null(spark, tmp_path):
    write_xlsx(str(tmp_path / "a.xlsx"), list(HEADERS), [[*ROW[:4], 2**31, -(2**31) - 1, *ROW[6:]]])
    r = files.scan_departments(spark, str(tmp_path), {1: "a.xlsx"}, "xlsx").first()
    assert r["sector"] is None and r["area"] is None and r["sexo"] == 1


# --- sample, session, cube versions


def test_sample_leaves_nothing_cached(spark, sf_small):
    df = dec.decode_all(enrolments(spark, sf_small))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for seed in range(3):
        assert files.sample_exact(df, 100, seed).count() == 100
    assert files.sample_exact(df, 10**9).count() == df.count()
    assert files.sample_exact(df.where("1 = 0"), 10).count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_an_existing_session_keeps_its_settings(spark):
    before = dict(r for r in spark.sql("SET").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert build_session() is not None
        assert build_session(master="local[2]", shuffle_partitions=3).conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before["spark.sql.shuffle.partitions"])
    assert dict(r for r in spark.sql("SET").collect()) == before


def test_cube_readers_take_the_newest_complete_version(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t/version=000000000000")
    spark.range(5).write.parquet(f"{tmp_path}/t/version=000000000001")
    spark.range(9).write.parquet(f"{tmp_path}/t/version=000000000002")
    os.remove(f"{tmp_path}/t/version=000000000002/_SUCCESS")
    assert st.read_cube(spark, f"{tmp_path}/t").count() == 5


# --- plans


@pytest.mark.parametrize("name", ["context_document", "indicators_json", "insights_national"])
def test_documents_take_one_scan(spark, sf_small, name):
    plan = _plan(REGISTRY[name].fn(spark, sf_small))
    assert plan.count("l_orderkey:") == 1  # lineitem is read once


def test_municipality_plans_have_no_regex(spark, sf_small):
    for name in ("municipality_summary", "municipality_names", "municipality_counts", "normalise_code"):
        assert "regexp" not in _plan(REGISTRY[name].fn(spark, sf_small)), name


def test_constants_are_local_tables(spark, sf_small):
    for name in ("decode_join", "control_check", "record_reconcile", "answer_batch"):
        plan = _plan(REGISTRY[name].fn(spark, sf_small))
        assert "ExistingRDD" not in plan and "LocalTableScan" in plan, name


# --- operators


def test_decode_with_a_callers_dictionary(spark):
    raw = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "sector int, area int")
    own = spark.createDataFrame([("sector", 1, "uno"), ("sector", 2, "b"), ("sector", 2, "a")], "domain string, code int, label string")
    got = dec.decode_join(raw, ["sector"], own).collect()
    assert sorted((r["sector_codigo"], r["sector"]) for r in got) == [(1, "uno"), (2, "a"), (3, "Desconocido")]


def test_control_tolerance_at_the_boundary(spark):
    rows = [("Municipal",)] * 4 + [("Público",)] * 996
    df = spark.createDataFrame(rows, "sector string").selectExpr("sector", "'x' area", "'x' sexo", "'x' nivel", "'x' resultado")
    expected = spark.createDataFrame([("sector", "Municipal", 0.3), ("sector", "Público", 99.8), ("sector", "Otro", 1.0)], "dimension string, label string, esperado double")
    got = {r["label"]: r["dentro_tolerancia"] for r in qual.control_check(df, expected).collect()}
    assert got == {"Municipal": True, "Público": False, "Otro": False}  # 0.4 - 0.3 is a tenth; 99.6 is two off


def test_context_from_outputs_leaves_missing_parts_out(spark, sf_small, tmp_path):
    import json

    cube = ind.outcome_cube(dec.decode_all(enrolments(spark, sf_small)))
    out = str(tmp_path)
    files.write_table(ind.department_summary(cube, "n"), f"{out}/{pl.SUMMARY}")
    assert list(json.loads(pl.context(spark, out).first()[0])) == ["por_departamento"]
    files.write_json_document(ans.indicators_document(cube, "n"), f"{out}/{pl.INDICATORS}")
    doc = json.loads(pl.context(spark, out).first()[0])
    assert list(doc) == ["indicadores", "insights", "promedio_retiro", "por_departamento"]
    text = spark.read.text(f"{out}/{pl.INDICATORS}", wholetext=True).first()[0]
    assert text.count("\n") > 10 and json.loads(text)["insights"] == doc["insights"]
    files.write_table(ind.gap_all(cube, weight="n"), f"{out}/{pl.GAPS}", partition_by="dimension")
    assert list(json.loads(pl.context(spark, out).first()[0]))[4:] == ["brecha_area", "brecha_sector", "brecha_nivel"]
    with pytest.raises(ValueError):
        ans.context_from_outputs()


def test_highest_and_overview_answers(spark, sf_small):
    got = {r["pregunta_id"]: r["respuesta"] for r in REGISTRY["answer_batch"].fn(spark, sf_small).collect()}
    first = REGISTRY["department_ranking"].fn(spark, sf_small).orderBy("posicion").first()
    assert got[9] == f"{first['departamento']}: {first['tasa_retiro']:.1f}%"
    assert got[10].startswith("Año 2024. Inscripciones:")
    assert got[7] == ans.NOT_AVAILABLE


def test_year_comes_from_the_data(spark, sf_small):
    df = dec.decode_all(enrolments(spark, sf_small)).withColumn("anio", F.lit(1999))
    assert ins.insights_national(df).first()["texto"].startswith("Año 1999.")
    assert ins.insights_national(ind.outcome_cube(df), "n").first()["texto"].startswith("Inscripciones:")


# --- published values, written out

DICTIONARIES = {
    "sector": {1: "Público", 2: "Privado", 3: "Municipal", 4: "Cooperativa"},
    "area": {1: "Urbana", 2: "Rural", 9: "Ignorado"},
    "sexo": {1: "Hombre", 2: "Mujer", 9: "Ignorado"},
    "nivel": {1: "Preprimaria", 2: "Primaria", 3: "Básico", 4: "Diversificado", 5: "Primaria de adultos", 9: "Ignorado"},
    "pueblo_per": {
        1: "Maya", 2: "Garífuna", 3: "Xinka", 4: "Afrodescendiente/Creole/Afromestizo", 5: "Ladino/Mestizo", 6: "Extranjero", 9: "Ignorado",
    },
    "plan_est": {1: "Diario", 2: "Fin de semana", 3: "Virtual a distancia", 4: "Semipresencial", 5: "Mixto"},
    "jornada_est": {1: "Matutina", 2: "Vespertina", 3: "Nocturna", 4: "Doble", 5: "Intermedia", 9: "Ignorado"},
    "resultado_f": {1: "Promovido", 2: "Vigente", 3: "Retirado", 4: "Retirado definitivo", 5: "No promovido", 9: "Ignorado"},
    "repitente": {1: "Sí", 2: "No", 9: "Ignorado"},
    "graduando": {1: "Sí", 2: "No", 9: "Ignorado"},
    "departamento_f": {
        1: "Guatemala", 2: "El Progreso", 3: "Sacatepéquez", 4: "Chimaltenango", 5: "Escuintla", 6: "Santa Rosa", 7: "Sololá",
        8: "Totonicapán", 9: "Quetzaltenango", 10: "Suchitepéquez", 11: "Retalhuleu", 12: "San Marcos", 13: "Huehuetenango",
        14: "Quiché", 15: "Baja Verapaz", 16: "Alta Verapaz", 17: "Petén", 18: "Izabal", 19: "Zacapa", 20: "Chiquimula", 21: "Jalapa", 22: "Jutiapa",
    },
}
RECORDS = {
    1: ("guatemala", 863879), 2: ("el_progreso", 49803), 3: ("sacatepequez", 91552), 4: ("chimaltenango", 166965), 5: ("escuintla", 207618),
    6: ("santa_rosa", 108264), 7: ("solola", 122831), 8: ("totonicapan", 113139), 9: ("quetzaltenango", 232627), 10: ("suchitepequez", 159287),
    11: ("retalhuleu", 98128), 12: ("san_marcos", 303565), 13: ("huehuetenango", 316771), 14: ("quiche", 268998), 15: ("baja_verapaz", 81736),
    16: ("alta_verapaz", 391085), 17: ("peten", 169629), 18: ("izabal", 120326), 19: ("zacapa", 71079), 20: ("chiquimula", 127409),
    21: ("jalapa", 99625), 22: ("jutiapa", 134571),
}
SHARES = {
    ("sector", "Público"): 74.7, ("sector", "Privado"): 20.9, ("sector", "Cooperativa"): 4.0, ("sector", "Municipal"): 0.3,
    ("area", "Rural"): 61.4, ("area", "Urbana"): 38.6, ("sexo", "Hombre"): 50.7, ("sexo", "Mujer"): 49.3,
    ("nivel", "Primaria"): 56.4, ("nivel", "Básico"): 17.8, ("nivel", "Preprimaria"): 17.1, ("nivel", "Diversificado"): 8.5,
    ("resultado", "Promovido"): 85.2, ("resultado", "No promovido"): 9.2, ("resultado", "Retirado"): 5.5,
}


def test_published_values(spark):
    assert dic.DOMAINS == DICTIONARIES
    assert {k: (v.removesuffix(".xlsx"), dic.DEPARTMENT_RECORDS[k]) for k, v in dic.DEPARTMENT_FILES.items()} == RECORDS
    assert sum(n for _, n in RECORDS.values()) == 4298887
    assert {(r["dimension"], r["label"]): r["esperado"] for r in qual.expected_shares(spark).collect()} == SHARES
    assert dic.CONTROL_TOTALS == {"inscripciones": (4298887, False), "municipios_guatemala": (17, False), "municipios": (340, True)}
    assert dic.GRADE_RANGES == {1: (0, 6), 2: (1, 6), 3: (1, 3), 4: (4, 7), 5: (1, 4)}
    assert dic.SEGMENT_LEVEL == {"40": 1, "41": 1, "42": 1, "43": 2, "44": 5, "45": 3, "46": 4}
    assert sorted(dic.TRIAL_DEPARTMENTS) == [2, 15, 19]


def test_published_labels_reach_the_decode(spark):
    for raw, labels in DICTIONARIES.items():
        df = spark.createDataFrame([(c,) for c in [*labels, 77, None]], "c int")
        got = {r["c"]: r["l"] for r in df.select("c", dic.decode_expr("c", dic.DOMAINS[raw]).alias("l")).collect()}
        assert got == {**labels, 77: "Desconocido", None: "Desconocido"}


def test_severity_thresholds(spark):
    diffs = [2.0, 1.99, 0.5, 0.49, 0.0, -1.99, -2.0, None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(diffs)], "i int, d double")
    got = [r["c"] for r in df.select("i", ins.severity_class("d").alias("c")).orderBy("i").collect()]
    above, near = "sobre el promedio", "cerca del promedio"
    assert got == ["crítica", above, above, near, near, near, "mejor que el promedio", near]

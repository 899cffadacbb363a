import json
import os
import tempfile
import warnings

import pytest
from pyspark.sql import functions as F

from pizarra.functions.dictionary import DEPARTMENT_FILES
from pizarra.operators import answers as ans
from pizarra.operators import decode as dec
from pizarra.operators import indicators as ind
from pizarra.plans import pipeline as pl
from pizarra.sources import files
from pizarra.sources.fixture import RAW_COLUMNS, enrolments
from pizarra.sources.xlsx import HEADERS

from .xlsx_writer import write_xlsx


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def scratch():
    return tempfile.mkdtemp(prefix="pizarra-test-", dir="/tmp")


@pytest.fixture(scope="module")
def raw(spark, sf_small):
    return enrolments(spark, sf_small).cache()


def test_workbooks_scan_picks_data_sheet_and_stamps(spark, raw, scratch):
    folder = os.path.join(scratch, "xlsx")
    os.makedirs(folder)
    header = list(HEADERS)  # published headers, accents included
    wanted = {2: 0, 19: 2, 15: 0}  # department -> empty sheets before the data sheet
    for dep, empties in wanted.items():
        rows = [tuple(r) for r in raw.where(F.col("departamento_f") == dep).collect()]
        rows = [tuple(99 if c == "departamento_f" else v for c, v in zip(RAW_COLUMNS, r)) for r in rows]  # data column is wrong on purpose
        write_xlsx(os.path.join(folder, DEPARTMENT_FILES[dep]), header, rows, empty_sheets_before=empties)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        got = files.scan_departments(spark, folder, DEPARTMENT_FILES, "xlsx")
        assert any("not found" in str(w.message) for w in caught)  # 19 catalogue files are missing
    want = raw.where(F.col("departamento_f").isin(*wanted))
    assert got.columns == RAW_COLUMNS
    assert _rows(got) == _rows(want)  # department re-stamped from the file name


def test_workbook_cell_typing(spark, scratch):
    path = os.path.join(scratch, "solola.xlsx")
    header = list(HEADERS)
    row = [2024, "\t07-01-0001-43 ", 7, 701, 1.5, "2", 1, 3, 2, 1, 1, 1, 1, 2, 2]
    write_xlsx(path, header, [row], empty_sheets_before=1)
    got = files.scan_departments(spark, scratch, {7: "solola.xlsx"}, "xlsx").first()
    assert got.sector is None  # fractional code: no label, decodes to Desconocido
    assert got.area == 2  # numeric text
    assert got.cod_establecimiento == "\t07-01-0001-43 "  # raw; repaired by the decode
    assert dec.decode_all(files.scan_departments(spark, scratch, {7: "solola.xlsx"}, "xlsx")).first().municipio_codigo == "07-01"


def test_no_file_found_is_an_error(spark, scratch):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(FileNotFoundError):
            files.scan_departments(spark, os.path.join(scratch, "nothing"), DEPARTMENT_FILES, "csv")


def test_scan_processed_missing_table(spark, scratch):
    with pytest.raises(FileNotFoundError, match="ingest"):
        files.scan_processed(spark, os.path.join(scratch, "no_table"))


def test_pipeline_round_trip_and_pruning(spark, raw, scratch):
    csv_cat = {k: v.replace(".xlsx", ".csv") for k, v in DEPARTMENT_FILES.items()}
    folder = files.export_departments(raw, os.path.join(scratch, "csv"), DEPARTMENT_FILES, "csv")
    out = os.path.join(scratch, "out")
    written = pl.run_pipeline(spark, folder, out, csv_cat, "csv")
    decoded = dec.decode_all(raw)
    assert _rows(files.scan_processed(spark, written and f"{out}/{pl.PROCESSED}")) == _rows(decoded)
    assert _rows(pl.read_summary(spark, out)) == _rows(ind.department_summary(decoded))
    ranking = [r.departamento for r in ind.department_summary(decoded).collect()]
    assert [r.departamento for r in pl.read_summary(spark, out).collect()] == ranking  # written in ranking order
    trial = files.trial_subset(spark, f"{out}/{pl.PROCESSED}")
    plan = trial._jdf.queryExecution().executedPlan().toString()
    pruned = [x for x in plan.split(", ") if x.startswith("PartitionFilters")]
    assert pruned and "IN (2,19,15)" in pruned[0]
    doc = files.scan_indicators_json(spark, f"{out}/{pl.INDICATORS}").first()
    nat = ind.national_indicators(decoded).first()
    assert doc.indicadores.total_estudiantes == nat.total and doc.promedio_retiro_nacional == nat.tasa_retiro
    assert 2 <= len(doc.insights) <= 4
    adhoc = ans.filtered_count(files.scan_processed(spark, f"{out}/{pl.PROCESSED}"), nivel="Primaria", departamento="Alta Verapaz")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # plan text in full, not cut at 100 characters
    try:
        scan = [ln for ln in adhoc._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in ln][0]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(nivel,Primaria)" in scan and "EqualTo(departamento,Alta Verapaz)" in scan  # pushed to Parquet
    assert "ReadSchema: struct<departamento:string,nivel:string>" in scan  # two columns read
    sample = spark.read.option("header", True).csv(f"{out}/{pl.SAMPLE}")
    assert sample.count() == min(5000, raw.count())
    text = spark.read.text(f"{out}/{pl.INDICATORS}", wholetext=True).first()[0]
    assert json.loads(text)["indicadores"]["por_nivel"]  # valid UTF-8 JSON, accents unescaped
    assert "\\u00e1" not in text  # no escaping of accented labels


def test_sample_exact_equals_brute_force(spark, raw):
    d = dec.decode_all(raw)
    n = 500
    got = files.sample_exact(d, n, 42)
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in d.columns]
    brute = d.orderBy(F.md5(F.concat_ws("|", F.lit("42"), *cols))).limit(n)
    assert got.count() == n
    assert _rows(got) == _rows(brute)
    assert _rows(files.sample_exact(d, 10**7, 42)) == _rows(d)  # fewer rows than n: all of them


def test_union_missing_column_is_null(spark, raw):
    a = raw.where(F.col("departamento_f") == 1)
    b = raw.where(F.col("departamento_f") == 2).drop("graduando")
    out = files.union_departments([a, b])
    assert out.where(F.col("departamento_f") == 2).where(F.col("graduando").isNotNull()).count() == 0
    assert out.count() == a.count() + b.count()


def test_context_from_pipeline_cube_matches_direct(spark, raw, scratch):
    cube = spark.read.parquet(f"{scratch}/out/{pl.CUBE}")
    decoded = dec.decode_all(raw)
    assert ans.context_document(cube, "n").first()[0] == ans.context_document(decoded.drop("anio")).first()[0]  # a cube holds no year


def exported_csv(spark, raw, folder):
    files.export_departments(raw, folder, DEPARTMENT_FILES, "csv")
    return {k: v.replace(".xlsx", ".csv") for k, v in DEPARTMENT_FILES.items()}


def test_one_header_is_read_per_department(spark, raw, scratch, monkeypatch):
    """However many part files a department has, the driver opens one; empty ones
    have no rows, and another header within a department is an error."""
    folder = os.path.join(scratch, "many")
    catalogue = exported_csv(spark, raw, folder)
    target = os.path.join(folder, catalogue[3])
    opened = []
    plain = files.csv_header
    monkeypatch.setattr(files, "csv_header", lambda s, p: opened.append(p) or plain(s, p))
    for k in range(40):
        open(os.path.join(target, f"part-9{k:04d}.csv"), "w").close()
    open(os.path.join(target, "aaa.csv"), "w").close()
    got = files.scan_departments(spark, folder, catalogue, "csv")
    assert got.count() == raw.count() and len(opened) == len(files.existing_files(spark, folder, catalogue))
    names = list(raw.columns)
    with open(os.path.join(target, "part-99999.csv"), "w") as f:
        f.write(",".join([names[1], names[0], *names[2:]]) + "\n" + ",".join(["x"] * len(names)) + "\n")
    with pytest.raises(Exception, match="header|Header"):
        files.scan_departments(spark, folder, catalogue, "csv").collect()


def test_headers_differ_between_departments(spark, raw, scratch):
    """Published and snake_case names, any order, a missing column."""
    folder = os.path.join(scratch, "mixed")
    os.makedirs(folder)
    rows = {d: raw.where(f"departamento_f = {d}").toPandas().convert_dtypes() for d in (1, 2, 3)}
    published = {v: k for k, v in HEADERS.items()}
    names = {k: v.replace(".xlsx", ".csv") for k, v in DEPARTMENT_FILES.items()}
    rows[1].to_csv(os.path.join(folder, names[1]), index=False)
    rows[2].rename(columns=published)[[published[c] for c in reversed(raw.columns)]].to_csv(os.path.join(folder, names[2]), index=False)
    rows[3].drop(columns="graduando").to_csv(os.path.join(folder, names[3]), index=False)
    got = files.scan_departments(spark, folder, names, "csv")
    want = raw.where("departamento_f < 4").withColumn("graduando", F.when(F.col("departamento_f") < 3, F.col("graduando")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    with open(os.path.join(folder, names[4]), "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks or repeats"):
        files.scan_departments(spark, folder, names, "csv")


def test_sample_hash_is_computed_once(spark, sf_small):
    """What finds the sample reads the written hash: no hashing, no join is left in the plan."""
    from pizarra.operators.decode import decode_all

    plan = files.sample_exact(decode_all(enrolments(spark, sf_small)), 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Join" not in plan


def test_batch_with_own_dictionary_and_names(spark, raw, scratch, capsys):
    """Dictionary and municipality catalogue from files; context, questions and one
    department from the outputs, by the command line."""
    from pizarra import __main__ as cli
    from pizarra.functions.dictionary import dictionary_df

    folder, out = os.path.join(scratch, "own-in"), os.path.join(scratch, "own-out")
    catalogue = exported_csv(spark, raw, folder)
    own = dictionary_df(spark).withColumn("label", F.when((F.col("domain") == "sector") & (F.col("code") == 1), "Oficial").otherwise(F.col("label")))
    own.select("domain", "code", "label").coalesce(1).write.option("header", True).csv(os.path.join(scratch, "dictionary"))
    with open(os.path.join(scratch, "names.csv"), "w") as f:
        f.write("codigo,municipio\n0101,Guatemala\n")
    dictionary = cli.table(spark, os.path.join(scratch, "dictionary"), "domain string, code int, label string")
    names = cli.table(spark, os.path.join(scratch, "names.csv"), "codigo string, municipio string")
    outputs = pl.run_pipeline(spark, folder, out, catalogue, "csv", dictionary=dictionary, municipalities=names)
    labels = {r["sector"] for r in spark.read.parquet(outputs[pl.CUBE]).select("sector").distinct().collect()}
    assert "Oficial" in labels and "Público" not in labels
    places = spark.read.parquet(outputs[pl.MUNICIPALITIES])
    assert places.where("codigo = '0101'").select("municipio").distinct().collect()[0][0] == "Guatemala"
    one = pl.department(spark, out, "Petén").collect()
    assert len(one) == 1 and "Petén" in one[0]["texto"] and one[0]["total"] > 0
    # the command line stops its session; here it must not
    stopped = []
    import pyspark.sql

    original = pyspark.sql.SparkSession.stop
    pyspark.sql.SparkSession.stop = lambda self: stopped.append(1)
    try:
        assert cli.main(["context", "--output", out]) == 0
        assert cli.main(["ask", "--output", out]) == 0
        assert cli.main(["show", "--output", out, "--department", "Petén"]) == 0
        assert cli.main(["show", "--output", out, "--department", "Nowhere"]) == 1
    finally:
        pyspark.sql.SparkSession.stop = original
    said = capsys.readouterr().out
    assert '"por_departamento"' in said and "1. " in said and "tasa_retiro" in said and len(stopped) == 4


def test_sample_of_files_writes_little_more_than_the_sample(spark, tmp_path, monkeypatch):
    """Of rows read from files only those near the smallest hashes are written; with many
    equal rows, which have one hash, every row is."""
    written = []

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    cut = files.cut
    monkeypatch.setattr(files, "cut", counted)
    odd = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("a"), F.lit(None).cast("int").alias("b"))
    same = odd.select((F.col("id") % 2).alias("id"), F.lit("x").alias("a"), "b")
    n = 500
    for name, df in (("odd", odd), ("same", same)):
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
        brute = df.orderBy(F.md5(F.concat_ws("|", F.lit("42"), *cols))).limit(n)
        written.clear()
        got = files.sample_exact(df, n)
        assert got.columns == df.columns
        assert _rows(got) == _rows(brute)
        if name == "odd":
            assert sum(written) < 3 * n
        assert _rows(files.sample_exact(df, 30_000)) == _rows(df)


def test_batch_deals_raw_rows_and_decodes_where_it_writes(spark, raw, scratch, monkeypatch):
    seen, write = [], files.write_processed

    def spy(rows, *args):
        seen.append(rows.columns)
        write(rows, *args)

    monkeypatch.setattr(files, "write_processed", spy)
    folder, out = os.path.join(scratch, "dealt-in"), os.path.join(scratch, "dealt-out")
    catalogue = exported_csv(spark, raw, folder)
    stored = files.scan_processed(spark, pl.ingest(spark, folder, out, catalogue, "csv"))
    assert seen == [raw.columns]
    assert _rows(stored) == _rows(dec.decode_all(raw))

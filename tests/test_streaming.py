import os
import shutil
import tempfile

import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from pizarra.functions.dictionary import DEPARTMENT_FILES
from pizarra.operators import decode as dec
from pizarra.operators import indicators as ind
from pizarra.session import clear_stage
from pizarra.sources import files
from pizarra.sources.fixture import enrolments
from pizarra.streaming import ingest as st

CSV = {k: v.replace(".xlsx", ".csv") for k, v in DEPARTMENT_FILES.items()}


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_incremental_ingest_is_exactly_once(spark, sf_small):
    raw = enrolments(spark, sf_small)
    base = tempfile.mkdtemp(prefix="pizarra-stream-", dir="/tmp")
    exported = files.export_departments(raw, os.path.join(base, "all"), DEPARTMENT_FILES, "csv")
    landing, processed, ckpt = (os.path.join(base, x) for x in ("landing", "processed", "ckpt"))
    os.makedirs(landing)

    def land(dep):
        name = CSV[dep]
        shutil.copytree(os.path.join(exported, name), os.path.join(landing, name))

    def run():
        st.start_ingest(spark, landing, processed, CSV, checkpoint=ckpt).awaitTermination()
        return files.scan_processed(spark, processed)

    land(1)
    land(2)
    first = run()
    want = dec.decode_all(raw)
    assert _rows(first) == _rows(want.where(F.col("departamento_f_codigo").isin(1, 2)))

    land(19)  # a new department file arrives
    second = run()
    assert _rows(second) == _rows(want.where(F.col("departamento_f_codigo").isin(1, 2, 19)))

    again = run()  # nothing new: nothing appended twice
    assert again.count() == second.count()

    cube_table = os.path.join(base, "cube")
    st.start_cube(spark, landing, cube_table, CSV, checkpoint=os.path.join(base, "ckpt_cube")).awaitTermination()
    got = st.read_cube(spark, cube_table)
    assert _rows(got) == _rows(ind.outcome_cube(second))


def test_default_checkpoint_resumes_in_another_application(spark, sf_small, tmp_path, monkeypatch):
    raw = enrolments(spark, sf_small)
    exported = files.export_departments(raw, str(tmp_path / "all"), DEPARTMENT_FILES, "csv")
    landing, processed, cube_table = (str(tmp_path / x) for x in ("landing", "processed", "cube"))
    os.makedirs(landing)
    want = dec.decode_all(raw)
    landed = []
    for dep in (1, 2, 19):  # one application each
        monkeypatch.setattr(SparkContext, "applicationId", property(lambda _, dep=dep: f"app-{dep}"))
        shutil.copytree(os.path.join(exported, CSV[dep]), os.path.join(landing, CSV[dep]))
        landed.append(dep)
        st.start_ingest(spark, landing, processed, CSV).awaitTermination()
        st.start_cube(spark, landing, cube_table, CSV).awaitTermination()
        clear_stage(spark)
        here = want.where(F.col("departamento_f_codigo").isin(*landed))
        assert _rows(files.scan_processed(spark, processed)) == _rows(here)
        assert _rows(st.read_cube(spark, cube_table)) == _rows(ind.outcome_cube(here))


def test_a_table_of_another_checkpoint_is_not_continued_by_default(spark, sf_small, tmp_path):
    exported = files.export_departments(enrolments(spark, sf_small), str(tmp_path / "all"), DEPARTMENT_FILES, "csv")
    for start, name in ((st.start_ingest, "processed"), (st.start_cube, "cube")):
        table = str(tmp_path / name)
        start(spark, exported, table, CSV, checkpoint=str(tmp_path / f"ckpt_{name}")).awaitTermination()
        with pytest.raises(ValueError, match="another checkpoint"):
            start(spark, exported, table, CSV)


@pytest.mark.parametrize("own_order", [False, True])
def test_published_files_are_streamed(spark, sf_small, tmp_path, own_order):
    """Files with published headers, or in an order of their own with a column missing."""
    from pizarra.sources.xlsx import HEADERS

    raw = enrolments(spark, sf_small)
    published = {v: k for k, v in HEADERS.items()}
    names = sorted(k for k, v in HEADERS.items() if v != "plan_est") if own_order else list(HEADERS)
    landing = tmp_path / "landing"
    landing.mkdir()
    for dep in (1, 2):
        raw.where(f"departamento_f = {dep}").toPandas().convert_dtypes().rename(columns=published)[names].to_csv(landing / CSV[dep], index=False)
    st.start_ingest(spark, str(landing), str(tmp_path / "out"), CSV, header=names if own_order else None).awaitTermination()
    got = files.scan_processed(spark, str(tmp_path / "out"))
    plan = F.lit(None).cast("int") if own_order else F.col("plan_est")
    want = dec.decode_all(raw.where("departamento_f < 3").withColumn("plan_est", plan))
    assert _rows(got) == _rows(want.select(*got.columns))

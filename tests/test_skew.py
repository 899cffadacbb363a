"""A department holding a third of all rows must not become one task."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from pizarra.operators import decode as dec
from pizarra.operators import indicators as ind
from pizarra.sources import files
from pizarra.sources.fixture import enrolments


def test_hot_department_write_is_split(spark, sf_small):
    raw = enrolments(spark, sf_small)
    hot = raw.where(F.col("departamento_f") == 1)
    # department 1 copied until it holds well over a third of the rows
    skewed = raw
    for _ in range(11):
        skewed = skewed.unionByName(hot)
    decoded = dec.decode_all(skewed)
    n_hot = decoded.where(F.col("departamento_f_codigo") == 1).count()
    assert n_hot * 3 > decoded.count()
    out = os.path.join(tempfile.mkdtemp(prefix="pizarra-skew-", dir="/tmp"), "processed")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        files.write_processed(decoded, out)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    hot_files = glob.glob(os.path.join(out, "departamento_f_codigo=1", "*.parquet"))
    assert len(hot_files) > 1  # split across tasks, not one task per department
    back = files.scan_processed(spark, out)
    assert back.count() == decoded.count()
    # aggregates are unaffected by the split (partial aggregation absorbs the hot key)
    got = {r.departamento: r.total for r in ind.department_summary(back).collect()}
    want = {r.departamento: r.total for r in ind.department_summary(decoded).collect()}
    assert got == want

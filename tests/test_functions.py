import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pizarra.functions.codes import WHITESPACE, code_segment, municipality, normalise_code, segment_level
from pizarra.functions.numeric import rate, round1, signed_one_decimal, thousands, truncated_estimate
from pizarra.operators.insights import CLASS_ABOVE, CLASS_BETTER, CLASS_CRITICAL, CLASS_NEAR, severity_class


def _one(spark, values, expr, dtype=T.StringType()):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", dtype)]))
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_normalise_code_edges(spark):
    values = [None, "00-01-0001-42", "  00-05-0002-43 ", "\t01-02-0003-45\n", "\xa001-03-0004-46　", "10-00-0005-42", "0000-1", ""]
    got = _one(spark, values, normalise_code)
    # same contract as Python: strip() then '00-' prefix -> '01-'
    want = [None if v is None else ("01-" + v.strip()[3:] if v.strip().startswith("00-") else v.strip()) for v in values]
    assert got == want


def test_municipality_segments(spark):
    values = [None, "01-02-0003-42", "01-02", "01", "", "-", "a-", "01-02-03"]
    got = _one(spark, values, municipality)
    want = [None if v is None else ("-".join(v.split("-")[:2]) if len(v.split("-")) >= 2 else None) for v in values]
    assert got == want


def test_code_segment_out_of_range_is_null(spark):
    got = _one(spark, ["19-01-0001-42", "19-01"], lambda c: code_segment(c, 4))
    assert got == ["42", None]
    assert _one(spark, ["19-01-0001-45", "19-01-0001-47", "x"], segment_level) == [3, None, None]


@pytest.mark.parametrize("n,total", [(1, 8), (3, 8), (1, 40), (7, 40), (1, 400), (5, 200), (25, 1000), (35, 1000), (45, 100), (1, 3), (2, 3)])
def test_rate_is_numpy_half_even(spark, n, total):
    df = spark.createDataFrame([(n, total)], "n long, t long")
    got = df.select(rate("n", "t")).first()[0]
    assert got == float(np.round(n / total * 100, 1))


def test_round1_ties_go_to_even(spark):
    got = _one(spark, [0.25, 0.35, 0.45, 2.5, -0.25], round1, T.DoubleType())
    assert got == [float(np.round(v, 1)) for v in [0.25, 0.35, 0.45, 2.5, -0.25]]


def test_rate_zero_total_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "n long, t long")
    assert df.select(rate("n", "t")).first()[0] is None


def test_estimate_truncates_from_rounded_rate(spark):
    df = spark.createDataFrame([(202618, 6.1)], "t long, r double")
    assert df.select(truncated_estimate("t", "r")).first()[0] == int(202618 * 6.1 / 100)


def test_number_formats(spark):
    df = spark.createDataFrame([(4298887, 1.9999999999999991, -0.04)], "n long, a double, b double")
    row = df.select(thousands("n"), signed_one_decimal("a"), signed_one_decimal("b")).first()
    assert tuple(row) == ("4,298,887", "+2.0", "-0.0")


def test_severity_thresholds_in_order(spark):
    diffs = [2.0, 8.2 - 6.2, 0.5, 0.49, -2.0, -1.99, None, 5.0]
    got = _one(spark, diffs, severity_class, T.DoubleType())
    assert got == [CLASS_CRITICAL, CLASS_ABOVE, CLASS_ABOVE, CLASS_NEAR, CLASS_BETTER, CLASS_NEAR, CLASS_NEAR, CLASS_CRITICAL]


def test_whitespace_set_is_pythons():
    # the code repair strips exactly what Python's str.strip() strips
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def _repair_model(v):
    """Plain-Python model of the code repair and the municipality key."""
    if v is None:
        return None, None
    s = v.strip()
    s = "01-" + s[3:] if s.startswith("00-") else s
    parts = s.split("-")
    return s, ("-".join(parts[:2]) if len(parts) >= 2 else None)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="001-- \t\n\xa0 　x", max_size=12)), min_size=1, max_size=60))
def test_code_repair_matches_python_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", T.StringType())]))
    fixed = normalise_code(F.col("x"))
    got = [(r[0], r[1]) for r in df.select(fixed, municipality(fixed)).collect()]
    assert got == [_repair_model(v) for v in values]


def test_column_builders_are_reused_per_context(spark):
    # pure builders return the same immutable Column for the same names ...
    assert rate("promovidos", "total") is rate("promovidos", "total")
    # ... build afresh for Column arguments (unhashable) ...
    assert rate(F.col("a"), "b") is not rate(F.col("a"), "b")
    # ... and a reused Column resolves correctly in different plans
    r = rate("n", "t")
    a = spark.createDataFrame([(1, 4)], "n int, t int").select(r.alias("x")).first().x
    b = spark.createDataFrame([(3, 8)], "n int, t int").select(r.alias("x")).first().x
    assert (a, b) == (25.0, 37.5)

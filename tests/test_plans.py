"""Plan-shape checks for the scale properties the operators rely on."""

import pytest

from pizarra.operators import decode as dec
from pizarra.operators import indicators as ind
from pizarra.plans.queries import REGISTRY
from pizarra.sources import files
from pizarra.sources.fixture import enrolments


def _plan(df, execute=False):
    if execute:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# These run a whole batch or stream and end in a scan of what it wrote; the
# plans of the operators behind them are among the others.
WRITTEN = {"context_outputs", "trial_subset", "scan_processed", "pipeline_summary", "pipeline_gaps", "pipeline_cube", "scan_indicators_json", "stream_ingest", "stream_cube"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - WRITTEN))
def test_no_cross_join_and_no_row_python(spark, sf_small, name):
    plan = _plan(REGISTRY[name].fn(spark, sf_small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def _below(plan: str, marker: str) -> str:
    """The operator directly under the first line containing ``marker``."""
    lines = [ln for ln in plan.splitlines() if ln.strip()]
    i = next(k for k, ln in enumerate(lines) if marker in ln)
    return lines[i + 1]


def test_grouping_sets_expand_aggregated_rows(spark, sf_small):
    decoded = dec.decode_all(enrolments(spark, sf_small))
    for df in (ind.gap_all(decoded), ind.shares_all(decoded)):
        plan = _plan(df, execute=True)
        assert "HashAggregate" in _below(plan, "Expand")


def test_dictionary_decode_is_broadcast_only(spark, sf_small):
    plan = _plan(dec.decode_join(dec.with_municipality(enrolments(spark, sf_small))))
    assert plan.count("BroadcastHashJoin") >= len(dec.DECODE_SPEC)
    lookups = [ln for ln in plan.splitlines() if "LeftOuter" in ln]
    assert lookups and all("BroadcastHashJoin" in ln for ln in lookups)


def test_one_scan_per_table_for_a_grouped_query(spark, sf_small):
    plan = _plan(REGISTRY["department_summary"].fn(spark, sf_small))
    assert plan.count("FileScan parquet") == 3  # lineitem, orders, customer once each


def test_single_file_sink_keeps_the_aggregate_parallel(spark, sf_small):
    # the cube is written as one file: only its bounded result may move to the
    # writer task, the final merge of the aggregate must stay on many tasks
    decoded = dec.decode_all(enrolments(spark, sf_small))
    plan = _plan(files.single_file(ind.outcome_cube(decoded)))
    assert "Coalesce" not in plan
    assert "HashAggregate" in _below(plan, "Exchange SinglePartition")

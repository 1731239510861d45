"""Every registered query against its SQL, and plan properties that must hold at scale."""

import pytest

import __spark_entry__ as entry_module
from incidentlens.operators import clustering as K
from incidentlens.operators.joins import request_evidence
from incidentlens.plans import catalog
from incidentlens.sources import driver_tables as E
from incidentlens.sources import logs as S
from compare import differences
from conftest import TESTDATA

SF = str(TESTDATA / "sf0.001")
SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()

needs_data = pytest.mark.skipif(not TESTDATA.exists(), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
    else:
        assert differences(df, SF, SQL[name]) == []


@needs_data
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_range_and_columns_reach_the_scan(spark):
    logs = E.raw_logs(spark, SF).select("project_id", "environment", "occurred_at", "arrival_seq")
    plan = _plan(request_evidence(E.requests(spark, SF), logs))
    assert "BroadcastHashJoin" in plan
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


@needs_data
def test_top_n_is_cut_before_the_shuffle(spark):
    logs = E.raw_logs(spark, SF).select("project_id", "environment", "occurred_at", "arrival_seq")
    plan = _plan(S.most_recent(request_evidence(E.requests(spark, SF), logs), 25))
    assert plan.count("WindowGroupLimit") == 2


@needs_data
def test_clustering_hashes_raw_rows(spark):
    """Raw rows are aggregated by hashing; only the reduced rows may be sorted."""
    requests, logs = E.requests(spark, SF), S.kept_level(E.log_events(spark, SF))
    rows = request_evidence(requests, K.cluster_parts(logs))
    plan = _plan(K.cluster_counts(rows))
    over_rows = [line for line in plan.splitlines()
                 if "Aggregate(" in line and "partial_min(arrival_seq" in line and "min_by" not in line]
    assert over_rows and all("HashAggregate" in line for line in over_rows)
    assert "SortMergeJoin" not in plan


@needs_data
@pytest.mark.parametrize("name", ["spikes", "diagnose_evidence", "redact_documents", "recent_logs", "pool_contention", "score_reports", "model_inputs"])
def test_no_python_and_no_products(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    for bad in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


@needs_data
def test_every_event_lies_in_a_request(spark):
    from incidentlens.operators.joins import wanted_evidence

    logs = E.raw_logs(spark, SF).select("project_id", "environment", "occurred_at", "arrival_seq")
    requests = E.requests(spark, SF)
    assert wanted_evidence(requests, logs).count() == logs.count()
    assert requests.where("to_ts - from_ts <= INTERVAL '24' HOUR").count() > 0
    assert requests.select("max_results").distinct().count() == 3


@needs_data
def test_limits_per_request_are_cut_before_the_shuffle(spark):
    plan = _plan(catalog.recent_logs(spark, SF))
    assert plan.count("WindowGroupLimit") == 2

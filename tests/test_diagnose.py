import json

import pytest
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens import schemas as S
from incidentlens.operators import evaluation as V
from incidentlens.operators import integrity as I
from incidentlens.operators import report as P
from incidentlens.operators.joins import request_evidence
from incidentlens.operators.timeline import order_timeline, timeline_entries
from incidentlens.plans.diagnose import Evidence, Settings, diagnose
from incidentlens.sources.logs import kept_level, most_recent
from fixtures import at, change, frame, log, metric, request, sql


@pytest.fixture(scope="module")
def run(spark):
    """Two golden scenarios and one request without evidence, in one diagnosis."""
    requests = frame(spark, S.REQUESTS, [
        request(request_id="deploy"), request(request_id="pool", environment="local"), request("quiet", request_id="quiet")])
    logs = [log(-1 - i, i) for i in range(8)] + [log(-40, 8)]
    logs += [log(-2 - i, 20 + i, environment="local", level="WARN", message="Slow order query detected", stack_trace=None, attributes={}) for i in range(3)]
    metrics = [metric(-30, "http_p95_seconds", 1, "metric-1", environment="local", description="p95 token=1"),
               metric(-28, "db_pool_pending_connections", 2, "metric-2", environment="local")]
    health = frame(spark, S.REQUEST_HEALTH, [dict(
        request_id="deploy", project_id="order-service", environment="staging", to_ts=at(0), evidence_id="dbhealth-1", snapshot_id="s",
        available=True, active_connections=7, idle_connections=13, waiting_connections=2, long_transactions=1, lock_waits=0)])
    status = spark.createDataFrame([("order-service", "staging", "log", "File", "timeout"), ("order-service", "staging", "metric", "M", "ok")], S.SOURCE_STATUS)
    return diagnose(requests, Evidence(
        logs=frame(spark, S.LOG_EVENTS, logs), metrics=frame(spark, S.METRIC_ANOMALIES, metrics),
        changes=frame(spark, S.CHANGE_EVENTS, [change(-20)]), slow_sql=frame(spark, S.SLOW_SQL, [sql(-35, environment="local")]),
        health=health, status=status))


def by_request(df):
    return {r["request_id"]: r for r in df.collect()}


def test_golden_scenarios(run):
    reports = by_request(run.reports())
    deploy, pool, quiet = reports["deploy"], reports["pool"], reports["quiet"]
    assert [(c["label"], c["evidence_ids"]) for c in deploy["root_cause_candidates"]] == [(C.DEPLOYMENT_REGRESSION, ["deploy-1", "log-1"])]
    assert [(c["label"], c["evidence_ids"]) for c in pool["root_cause_candidates"]] == [(C.POOL_CONTENTION, ["sql-1", "metric-2"])]
    assert quiet["root_cause_candidates"] == [] and quiet["recommended_actions"] == [C.WIDEN_ACTION]
    assert quiet["summary"] == "未发现明确根因。已聚合 0 类日志与 0 条时间线证据,建议人工进一步排查。"
    assert deploy["summary"] == "最可能的原因是发布后引入异常(证据强度 STRONG)。详见根因候选与时间线。"
    assert deploy["recommended_actions"] == C.ACTIONS[C.DEPLOYMENT_REGRESSION]
    assert deploy["root_cause_candidates"][0]["explanation"] == C.EXPLANATIONS[C.DEPLOYMENT_REGRESSION]
    assert deploy["unavailable_sources"] == ["log:File (timeout)"] and not deploy["rule_fallback"]
    assert deploy["disclaimer"] == C.DISCLAIMER


def test_every_reference_resolves(run):
    for report in run.reports().collect():
        ids = {e["evidence_id"] for e in report["evidence"]}
        assert {i for c in report["root_cause_candidates"] for i in c["evidence_ids"]} <= ids
        assert {t["evidence_id"] for t in report["timeline"]} <= ids


def test_evidence_and_timeline_texts(run):
    deploy = by_request(run.reports())["deploy"]
    assert [(e["type"], e["description"]) for e in deploy["evidence"]] == [
        ("LOG_CLUSTER", "突增 NullPointerException ×9"), ("CHANGE_EVENT", "DEPLOYMENT {version=v1.4.2}"),
        ("DB_HEALTH", "连接 active=7 idle=13 waiting=2; 长事务 1; 锁等待 0")]
    assert [(t["category"], t["at"]) for t in deploy["timeline"]] == [("LOG", at(-40)), ("CHANGE", at(-20)), ("DB_HEALTH", at(0))]
    assert deploy["timeline"][0]["description"] == "异常突增: NullPointerException ×9"
    pool = by_request(run.reports())["pool"]
    assert pool["timeline"][0]["description"] == "慢 SQL avg=2100ms: select * from orders where customer_id = ?"


def test_model_answers_and_fallback(spark, run):
    answer = {"summary": "told", "rootCauseCandidates": [
        {"label": C.DEPLOYMENT_REGRESSION, "explanation": " "}, {"label": C.DEPLOYMENT_REGRESSION, "explanation": "first"},
        {"label": C.DEPLOYMENT_REGRESSION, "explanation": "second"}, {"label": "invented", "explanation": "x"}],
        "recommendedActions": ["act"]}
    raw = spark.createDataFrame([("deploy", json.dumps(answer)), ("pool", "{ broken")], S.MODEL_OUTPUTS)
    reports = by_request(run.reports(P.parse_model_outputs(raw)))
    assert reports["deploy"]["summary"] == "told" and reports["deploy"]["recommended_actions"] == ["act"]
    assert [(c["label"], c["explanation"]) for c in reports["deploy"]["root_cause_candidates"]] == [(C.DEPLOYMENT_REGRESSION, "first")]
    assert reports["pool"]["rule_fallback"] and reports["pool"]["summary"] == C.FALLBACK_SUMMARY
    assert reports["pool"]["root_cause_candidates"][0]["explanation"] is None
    assert reports["pool"]["unavailable_sources"] == ["model:rules (error)"]
    assert reports["quiet"]["summary"] == C.FALLBACK_SUMMARY_EMPTY and reports["quiet"]["recommended_actions"] == [C.REVIEW_ACTION]


def test_silent_model_keeps_rule_candidates(spark, run):
    raw = spark.createDataFrame([("deploy", '{"summary":"nothing"}')], S.MODEL_OUTPUTS)
    report = by_request(run.reports(P.parse_model_outputs(raw)))["deploy"]
    assert [c["label"] for c in report["root_cause_candidates"]] == [C.DEPLOYMENT_REGRESSION] and not report["rule_fallback"]


def test_model_inputs_are_redacted(run):
    payload = json.loads(by_request(run.model_inputs())["pool"]["payload"])
    assert payload["question"] == "why? ***" and payload["metricAnomalies"][0]["description"] == "p95 ***"
    assert list(payload) == ["question", "from", "to", "logClusters", "metricAnomalies", "slowSqlSummaries", "changeEvents",
                             "databaseHealth", "timeline", "ruleCandidates", "unavailableSources"]


def test_cut_evidence_takes_its_candidate_with_it(spark):
    """The rules run before the budget; a candidate that cites a cut change is not replaced."""
    requests = frame(spark, S.REQUESTS, [request(request_id="r")])
    changes = [change(-100, 1, "old", type="CONFIG_CHANGE"), change(-20, 2, "near")]
    out = diagnose(requests, Evidence(
        logs=frame(spark, S.LOG_EVENTS, [log(-1 - i, i) for i in range(8)]), metrics=frame(spark, S.METRIC_ANOMALIES, []),
        changes=frame(spark, S.CHANGE_EVENTS, changes), slow_sql=frame(spark, S.SLOW_SQL, [])), Settings(caps=(20, 15, 20, 1)))
    assert out.candidates.count() == 0
    assert [r["evidence_id"] for r in out.timeline.orderBy("position").collect()] == ["old", "log-1"]
    assert out.budget.first()["change_events_truncated"] == 1


def test_row_limit_before_clustering(spark):
    """With capped logs the counts saturate; without a cap everything counts."""
    requests = frame(spark, S.REQUESTS, [request(request_id="r")])
    logs = frame(spark, S.LOG_EVENTS, [log(-1 - i / 10, i) for i in range(30)])
    empty = dict(metrics=frame(spark, S.METRIC_ANOMALIES, []), changes=frame(spark, S.CHANGE_EVENTS, []), slow_sql=frame(spark, S.SLOW_SQL, []))
    capped = most_recent(request_evidence(requests, kept_level(logs)), 12)
    assert diagnose(requests, Evidence(logs=logs, **empty)).clusters.first()["count"] == 30
    assert diagnose(requests, Evidence(logs=logs, capped_logs=capped, **empty)).clusters.first()["count"] == 12


def test_timeline_puts_unknown_times_last_and_keeps_unnamed_entries(spark):
    tied = lambda schema, rows: frame(spark, schema, rows).withColumn("request_id", F.lit("r"))
    clusters = spark.createDataFrame([], "request_id string, first_seen timestamp_ntz, evidence_id string, exception_class string, "
                                         "message_template string, level string, spike boolean, count long, cluster_seq long")
    entries = timeline_entries(
        tied(S.CHANGE_EVENTS, [change(-5, 2, "b"), change(-5, 1, "a"), change(0, 3, "none", occurred_at=None)]), clusters,
        tied(S.METRIC_ANOMALIES, [metric(-5, "m"), metric(-9, "first", 2, None)]), tied(S.SLOW_SQL, []))
    assert [r["evidence_id"] for r in order_timeline(entries).orderBy("position").collect()] == [None, "a", "b", "metric-1", "none"]
    survivors = spark.createDataFrame([("r", "a")], "request_id string, evidence_id string")
    assert sorted(str(r["evidence_id"]) for r in I.resolved_timeline(entries, survivors).collect()) == ["None", "a"]


@pytest.mark.parametrize("raw,valid", [
    ('{"summary":"ok","rootCauseCandidates":[{"label":" "},{"label":"a","evidenceIds":["x"]}]}', True), ("", False), ("{ broken", False),
    ('"string"', False), ("[1,2,3]", False), ('{"unrelated":true}', False), ('{"summary":5}', False), (None, False)])
def test_model_output_shapes(spark, raw, valid):
    row = P.parse_model_outputs(spark.createDataFrame([("r", raw)], S.MODEL_OUTPUTS)).first()
    assert row["valid"] == valid
    assert [c["label"] for c in row["model_candidates"]] == (["a"] if valid else [])


def test_report_ids_skip_stored_ones(spark):
    requests = spark.createDataFrame([(f"r{i}",) for i in range(4)], "request_id string")
    stored = spark.createDataFrame([("diag-20260601-001",), ("diag-20260601-003",), ("diag-20260531-002",), ("diag-20260601-x",)], "diagnosis_id string")
    got = P.assign_report_ids(requests, [F.col("request_id")], stored, "20260601").orderBy("request_id").collect()
    assert [r["diagnosis_id"][-3:] for r in got] == ["002", "004", "005", "006"]


def test_scoring(spark):
    scenarios = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["x"]), (3, "b", [])], "report_id long, expected_label string, required_ids array<string>")
    reports = spark.createDataFrame([(1, "s", False), (2, " ", True), (3, "s", False)], "report_id long, summary string, rule_fallback boolean")
    found = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["z"]), (3, "a", ["x"])], "report_id long, label string, evidence_ids array<string>")
    evidence = spark.createDataFrame([(1, "x"), (1, "y"), (3, "x")], "report_id long, evidence_id string")
    got = {r["report_id"]: r for r in V.score_reports(scenarios, reports, found, evidence).collect()}
    assert got[1]["passed"]
    assert (got[2]["root_cause_hit"], got[2]["evidence_cited"], got[2]["no_fabricated_ids"], got[2]["model_answered"], got[2]["summary_present"]) == (True, False, False, False, False)
    assert not got[3]["root_cause_hit"]
    assert V.score_summary(V.score_reports(scenarios, reports, found, evidence)).first().asDict() == {"passed": 1, "scenarios": 3}


def test_malformed_parts_of_an_answer(spark):
    """Each part is judged by itself: wrong elements drop, missing texts are empty, the last of a repeated key counts."""
    raw = (
        '{"summary":"first","summary":"s","rootCauseCandidates":[1,null,["x"],{"label":"a"},{"label":"b","title":{"x":1},"explanation":3,'
        '"evidenceIds":"none"},{"label":"c","evidenceIds":["log-1",2,{"x":1}]}],"recommendedActions":["do",{"x":1},4,null]}')
    row = P.parse_model_outputs(spark.createDataFrame([("r", raw)], S.MODEL_OUTPUTS)).first()
    assert row["valid"] and row["summary"] == "s"
    assert [tuple(c) for c in row["model_candidates"]] == [
        ("a", "", "", []), ("b", "", "3", []), ("c", "", "", ["log-1", "2", ""])]
    assert row["recommended_actions"] == ["do", "", "4", ""]


def test_stored_ids_keep_their_type(spark, tmp_path):
    from incidentlens.sources import store

    report = spark.sql("SELECT 'diag-1' diagnosis_id, '007' project_id, '1' environment, TIMESTAMP_NTZ'2026-06-01 00:00:00' created_at, 1L version, "
                       """'{"diagnosisId":"diag-1","projectId":"007","environment":"1","summary":"s","ruleFallback":false}' report_json""")
    store.append_reports(report, str(tmp_path / "reports"))
    page = store.report_history(store.read_reports(spark, str(tmp_path / "reports")), project_id="007").collect()
    assert [(r.project_id, r.environment) for r in page] == [("007", "1")]
    change = spark.sql("SELECT 'event-1' evidence_id, '007' project_id, '1' environment, 'DEPLOYMENT' type, TIMESTAMP_NTZ'2026-06-01 00:00:00' occurred_at, "
                       "map('a', 'b') attributes, 1L change_seq")
    store.append_changes(change, str(tmp_path / "changes"))
    assert [r.project_id for r in store.read_changes(spark, str(tmp_path / "changes")).collect()] == ["007"]

import datetime as dt

import pytest
from pyspark.sql import functions as F

from incidentlens import schemas as S
from incidentlens.operators import validation as A
from incidentlens.sources import database as D
from incidentlens.sources import evidence as G
from incidentlens.sources import logs as L
from incidentlens.sources import store as O
from incidentlens.streaming.ingest import start_ingest
from fixtures import ANCHOR, at, change, frame, log, request

PROJECTS = [dict(project_id="order-service", display_name="Orders", environments=["staging", "local"], max_query_hours=24,
                 max_results=500, logs_type=None, database_type="mysql"),
            dict(project_id="plain", display_name="Plain", environments=["staging"], max_query_hours=24, max_results=500,
                 logs_type="jdbc", database_type=" ")]


@pytest.fixture(scope="module")
def projects(spark):
    return frame(spark, S.PROJECTS, PROJECTS)


def test_table_names():
    assert L.checked_table_name("PUBLIC.view_1") == "PUBLIC.view_1"
    for bad in ("", "a.b.c", "v; DROP TABLE x", "1a", "a b", "a." , "x" * 65):
        with pytest.raises(ValueError):
            L.checked_table_name(bad)


def test_scan_log_table(spark):
    requests = frame(spark, S.REQUESTS, [request()])
    rows = [("ERROR", -5, "java.lang.NullPointerException: x"), ("warn", -30, None), ("INFO", -1, None), ("DEBUG", -2, None), ("ERROR", -500, None)]
    shanghai = dt.timedelta(hours=8)
    table = spark.createDataFrame(
        [("order-service", "staging", at(m) + shanghai, lv, f"t{i}", "m", st, i) for i, (lv, m, st) in enumerate(rows)]
        + [("order-service", "staging", None, "ERROR", "tn", "m", None, 9)],
        "project_id string, environment string, occurred_at timestamp_ntz, level string, trace_id string, message string, stack_trace string, arrival_seq long")
    got = L.scan_log_table(requests, table, "Asia/Shanghai").orderBy("rank_no").collect()
    assert [(r["level"], r["occurred_at"]) for r in got] == [("ERROR", at(-5)), ("warn", at(-30))]
    assert got[0]["attributes"] == {"exceptionClass": "NullPointerException"}
    assert L.scan_log_table(requests, table, "Asia/Shanghai", n=None).count() == 2


def test_log_routing(spark, projects):
    logs = frame(spark, S.LOG_EVENTS, [log(-1, 1), log(-2, 2, project="plain"), log(-3, 3, project="nobody")])
    got = L.route_logs(projects, {"mock": logs, "jdbc": logs, "local-file": logs}).collect()
    assert sorted((r["project_id"], r["source_type"]) for r in got) == [("order-service", "mock"), ("plain", "jdbc")]


def test_registry_degrades_a_failing_source(spark):
    registry = G.SourceRegistry()
    good = frame(spark, S.CHANGE_EVENTS, [change(-1)])
    registry.register("change-event", "Good", lambda s, r: good)
    registry.register("change-event", "Broken", lambda s, r: 1 / 0)
    registry.register("change-event", "Partial", lambda s, r: good.drop("type"))
    registry.register("change-event", "Again", lambda s, r: good)
    rows, failed = registry.collect(spark, frame(spark, S.REQUESTS, [request()]), "change-event")
    assert [r["source_ord"] for r in rows.orderBy("source_ord").collect()] == [0, 3]
    assert failed == ["change-event:Broken (error)", "change-event:Partial (error)"]


def mysql_status(spark):
    rows = [("s1", -30, n, v) for n, v in [("Threads_connected", "20"), ("Threads_running", "5"), ("version", "8.0")]]
    rows += [("s2", 30, "THREADS_RUNNING", "7"), ("s2", 30, "Threads_connected", "n/a")]
    return spark.createDataFrame(
        [("order-service", "staging", s, at(m), n, v) for s, m, n, v in rows],
        "project_id string, environment string, snapshot_id string, captured_at timestamp_ntz, name string, value string")


def test_mysql_health(spark):
    got = {r["snapshot_id"]: (r["active_connections"], r["idle_connections"]) for r in D.mysql_health(mysql_status(spark)).collect()}
    assert got == {"s1": (5, 15), "s2": (7, 0)}


def test_health_as_of_the_request(spark, projects):
    """The newest snapshot up to the request's end counts, within the given age; an unknown kind is an error."""
    waits = spark.createDataFrame([("s1", 1, 2)], "snapshot_id string, blocking_id int, requesting_id int")
    snapshots = D.with_findings(
        D.mysql_health(mysql_status(spark)), lock_waits=D.mysql_lock_waits(waits))
    requests = frame(spark, S.REQUESTS, [request()])
    row = D.health_status(requests, projects, snapshots).first()
    assert (row["snapshot_id"], row["available"], row["active_connections"], row["lock_waits"]) == ("s1", True, 5, 1)
    late = D.health_status(requests, projects, snapshots, max_age=60).first()
    assert not late["available"] and late["unavailable_reason"] == "MySQL unavailable"
    odd = projects.withColumn("database_type", F.lit("oracle"))
    assert D.health_status(requests, odd, snapshots.limit(0)).first()["unavailable_reason"] == "unsupported database oracle"


def test_health_sentinel_and_unavailable(spark, projects):
    requests = frame(spark, S.REQUESTS, [request(), request("plain", request_id="r2"), request("nobody", request_id="r3")])
    none = frame(spark, S.DB_HEALTH, [])
    got = D.health_status(requests, projects, none).collect()
    assert [(r["request_id"], r["available"], r["unavailable_reason"]) for r in got] == [("r1", False, "MySQL unavailable")]


def test_digests_start_at_the_range(spark):
    rows = [("order-service", "staging", f"q{i}", 10 * i, i * 10 ** 9 + 499_999_999, i * 10 ** 9 + 500_000_000) for i in (1, 3, 2)]
    rows.append(("order-service", "staging", None, 1, 10 ** 12, 10 ** 12))
    df = spark.createDataFrame(rows, "project_id string, environment string, digest_text string, count_star long, avg_timer_wait long, max_timer_wait long")
    got = D.mysql_digest(frame(spark, S.REQUESTS, [request()]), df, 2).orderBy("sql_seq").collect()
    assert [(r["evidence_id"], r["sql_template"], r["avg_duration_ms"], r["max_duration_ms"]) for r in got] == [("dbsql-1", "q3", 3, 4), ("dbsql-2", "q2", 2, 3)]
    assert got[0]["first_seen"] == request()["from_ts"]


def test_request_validation(spark, projects):
    rows = [request(request_id="ok"), request(request_id="48h", hours=48), request(request_id="24h", hours=24),
            request(request_id="24h1s", from_ts=at(-1440) - dt.timedelta(seconds=1)), request("nobody", request_id="who"),
            request(environment="moon", request_id="env"), request(request_id="same", from_ts=ANCHOR),
            request(request_id="blank", question=" "), request(request_id="none", to_ts=None)]
    got = {r["request_id"]: r["reject_reason"] for r in A.validate_requests(frame(spark, S.REQUESTS, rows), projects).collect()}
    assert got == {"ok": None, "48h": "span-too-long", "24h": None, "24h1s": "span-too-long", "who": "unknown-project",
                   "env": "unknown-environment", "same": "bad-range", "blank": "blank-question", "none": "missing-time"}


SUBMITTED = "received_seq long, project_id string, environment string, type string, occurred_at timestamp_ntz, attributes map<string,string>"


def test_change_store(spark, projects, tmp_path):
    path = str(tmp_path / "changes")
    rows = [(i, "order-service", "staging", "DEPLOYMENT", at(-i), {"password": "x", "key": "timeout"}) for i in (1, 2, 3)]
    rows.append((4, "order-service", "staging", "DEPLOYMENT", at(-1), {"a": None}))
    submitted = spark.createDataFrame(rows, SUBMITTED)
    O.append_changes(O.prepare_changes(submitted, projects), path)
    stored = O.read_changes(spark, path)
    assert stored.count() == 3 and stored.first()["attributes"] == {"password": "***", "key": "timeout"}
    O.append_changes(O.prepare_changes(submitted, projects, O.last_change_id(stored)), path)
    stored = O.read_changes(spark, path)
    assert sorted(r["change_seq"] for r in stored.collect()) == [1, 2, 3, 4, 5, 6]
    newest = G.recent_changes(frame(spark, S.REQUESTS, [request()]), stored, 2).orderBy("place").collect()
    assert [r["occurred_at"] for r in newest] == [at(-1), at(-1)]


def test_streaming_ingest_is_repeatable(spark, projects, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [(i, "order-service", "staging", "DEPLOYMENT", at(-i), {"token": "x"}) for i in range(5)]
    spark.createDataFrame(rows, SUBMITTED).write.parquet(source)
    stream = spark.readStream.schema(SUBMITTED).parquet(source)
    for _ in range(2):
        query = start_ingest(stream, projects, store, str(tmp_path / "progress"))
        query.awaitTermination(120)
    stored = O.read_changes(spark, store)
    assert sorted(r["change_seq"] for r in stored.collect()) == [1, 2, 3, 4, 5]
    assert stored.first()["attributes"] == {"token": "***"}


def test_reports(spark):
    body = '{{"diagnosisId":"{0}","projectId":"p","environment":"e","summary":"s{0}","ruleFallback":true}}'
    rows = [(f"d{i}", "p", "e" if i % 2 else "f", at(i), 1, body.format(f"d{i}")) for i in range(6)]
    rows += [("d5", "p", "e", at(5), 2, body.format("d5").replace("sd5", "second")), ("d9", "p", "e", at(9), 1, "{broken")]
    versions = spark.createDataFrame(rows, "diagnosis_id string, project_id string, environment string, created_at timestamp_ntz, version long, report_json string")
    assert [r["summary"] for r in O.report_history(versions, "p", "e", 3).collect()] == ["second", "sd3"]
    assert [r["diagnosis_id"] for r in O.report_history(versions, limit=0).collect()] == []
    assert O.find_report(versions, "d5").first()["version"] == 2
    assert O.find_report(versions, "nope").count() == 0

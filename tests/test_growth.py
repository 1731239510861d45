"""Work that a query does not need is not done, and evidence may be cleaned before requests repeat it."""

import random
import re

from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens import schemas as S
from incidentlens.functions import text as X
from incidentlens.operators.joins import request_evidence, wanted_evidence
from incidentlens.operators.sanitize import sanitize_metrics
from incidentlens.plans.diagnose import Evidence, diagnose
from incidentlens.session import request_scope
from incidentlens.sources import driver_tables as E
from incidentlens.sources.database import mysql_health
from incidentlens.sources.evidence import source_labels
from conftest import TESTDATA
from fixtures import at, change, frame, log, metric, request, sql


def _inputs(spark):
    requests = frame(spark, S.REQUESTS, [request(request_id="a"), request(request_id="b")])
    metrics = frame(spark, S.METRIC_ANOMALIES, [
        metric(-30 - n, "http_p95_seconds", n, f"metric-{n}", description=f"p95 token=abc{n} a@b.com") for n in range(40)])
    return requests, metrics


def test_wanted_rows_meet_the_same_requests_again(spark):
    requests, metrics = _inputs(spark)
    scope = request_scope(requests)
    once = sanitize_metrics(wanted_evidence(requests, metrics, "observed_at", scope))
    got = request_evidence(requests, once, "observed_at", scope).select("request_id", "evidence_id", "description")
    want = sanitize_metrics(request_evidence(requests, metrics, "observed_at", scope)).select(got.columns)
    assert once.count() == 40 and sorted(got.collect()) == sorted(want.collect()) and got.count() == 80


def test_a_diagnosis_computes_on_demand_and_cleans_what_it_keeps(spark):
    requests, metrics = _inputs(spark)
    made = []

    def health():
        made.append(1)
        return frame(spark, S.REQUEST_HEALTH, [])

    run = diagnose(requests, Evidence(
        logs=frame(spark, S.LOG_EVENTS, [log(-1, 0)]), metrics=metrics, changes=frame(spark, S.CHANGE_EVENTS, [change(-20)]),
        slow_sql=frame(spark, S.SLOW_SQL, [sql(-35)]), health=health))
    assert made == [1] and not {"evidence", "candidates", "timeline", "budget"} & set(vars(run))
    assert "description" not in run.spots["metrics"].columns
    told = {r.description for r in run.evidence.where("type = 'METRIC'").collect()}
    assert told == {f"p95 {C.MASK} {C.MASK}"}
    kept = {r.request_id: (r.metrics_kept, r.metrics_truncated) for r in run.budget.collect()}
    assert kept == {"a": (20, 20), "b": (20, 20)}


def test_addresses_are_masked_from_the_start_of_a_run_or_of_the_rest_of_one(spark):
    texts = ["a@b.comx-y@d.co", "x.y+z@q.r.st!", "foo@bar", "@a.bc", "a@b.c1d@e.fg", "w" * 20_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        X.redact(F.col("text")).alias("got"), F.regexp_replace("text", C.SECRET_PATTERNS[2], C.MASK).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_frames_are_found_without_repeating_a_class_of_no_break(spark):
    rng = random.Random(5)
    pieces = ["at ", "at", "\n", "\r\n", "\x0b", "\f", "\x85", "\u2028", "\u2029", " ", "\t", "\x00", "\x1f", "a.B(C.java:12)", ":3)", "x", "汉", "\U0001f600", "E: m", "  at "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)]
    breaks = X._LINE_BREAK_CHARS
    plain = F.regexp_extract("text", rf"(?:\A|[{breaks}])[\x00-\x20]*at ([\x00-\t\x0e-\x20]*[^\x00-\x20{breaks}][^{breaks}]*)", 1)
    want = F.nullif(X.trim_control(F.regexp_replace(X.trim_control(plain), r":\d+\)", ")")), F.lit(""))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(X.top_stack_frame(F.col("text")).alias("got"), want.alias("want"))
    found = rows.collect()
    assert [r.got for r in found] == [r.want for r in found] and sum(r.got is not None for r in found) > 300
    assert not re.search(r"\[\^[^\]]*\][*+]", rows.select("got")._jdf.queryExecution().optimizedPlan().toString())


def test_snapshots_without_numbers_are_none(spark):
    rows = [("p", "e", "s", at(0), "Threads_connected", "9"), ("p", "e", "s", at(0), "threads_running", "n/a"),
            ("p", "e", "t", at(1), "threads_running", "n/a"), ("p", "e", "u", at(2), "Version", "8")]
    found = mysql_health(spark.createDataFrame(rows, "project_id string, environment string, snapshot_id string, captured_at timestamp_ntz, name string, value string"))
    assert sorted((r.snapshot_id, r.active_connections, r.idle_connections) for r in found.collect()) == [("s", 0, 9), ("u", 0, 0)]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_secret_words_are_found_by_one_search(spark):
    words = ["password", "PassWd", "pwd", "TOKEN", "secret", "api_key", "API-KEY", "apikey", "authorization", "toKen", "pass", "apikeys"]
    texts = [f"{head}{word}{sign}x1 y" for head in ("", "my", "pa", "\u00e9") for word in words for sign in ("=", ' : "', "", ":\n")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(X.redact(F.col("text")).alias("got"), F.regexp_replace("text", C.SECRET_PATTERNS[1], C.MASK).alias("want"))
    assert all(r.got == r.want for r in got.collect())
    # once to look for bearer; every further word used to lower the text again
    assert _optimized(df.select(X.redact(F.col("text")).alias("got"))).count("lower(") == 1


def test_texts_with_nothing_to_mask_skip_array_functions(spark):
    rows = [("at a.B(C.java:1)", "E"), ("token=abc", None), (None, "x@y.com"), (None, None), ("bearer", "abc 13800138000")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(X.redact_each(F.col("a"), F.col("b")).alias("got"), F.array(X.redact(F.col("a")), X.redact(F.col("b"))).alias("want"))
    assert all(r.got == r.want for r in got.collect())
    assert "CASE WHEN" in _optimized(df.select(X.redact_each(F.col("a"), F.col("b")).alias("got"))).split("transform(")[0]


def test_health_findings_are_counted_for_the_projects_that_have_snapshots(spark):
    """Every scan of the orders keeps the rows of its projects before they are counted."""
    plan = _optimized(E.health_snapshots(spark, str(TESTDATA / "sf0.001")))
    below = [part.splitlines()[-2] for part in plan.split("Relation [")[:-1]]
    scans = [line for line in below if "o_custkey" in line]
    assert len(scans) == 4 and all("Filter" in line and "svc-" in line for line in scans)


def test_states_of_sources_read_the_properties_of_an_event_once(spark):
    plan = _optimized(source_labels(E.source_status(spark, str(TESTDATA / "sf0.001"))))
    (scan,) = [line for line in plan.splitlines() if "Filter" in line]
    assert scan.count("get_json_object") == 1

import random

import pytest
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens import schemas as S
from incidentlens.functions import rules as R
from incidentlens.operators import budget as B
from incidentlens.operators import clustering as K
from incidentlens.operators.joins import request_evidence
from incidentlens.operators import correlation as J
from incidentlens.operators.ranking import number_rows, top_n
from fixtures import at, change, frame, log, metric, request, sql


@pytest.fixture(scope="module")
def one_request(spark):
    return frame(spark, S.REQUESTS, [request()])


def clusters(spark, requests, rows, **options):
    return [r.asDict() for r in K.log_clusters(requests, frame(spark, S.LOG_EVENTS, rows), **options).orderBy("cluster_seq").collect()]


def test_spike_needs_five_in_the_window(spark, one_request):
    eight = [log(-1 - i, i) for i in range(8)] + [log(-40, 8)]
    four = [log(-1 - i, 20 + i, message="Other failure") for i in range(4)]
    got = clusters(spark, one_request, eight + four)
    assert [(c["evidence_id"], c["count"], c["baseline_count"], c["spike"]) for c in got] == [("log-1", 9, 1, True), ("log-2", 4, 0, False)]


def test_short_range_has_no_baseline(spark):
    short = frame(spark, S.REQUESTS, [request(from_ts=at(-10))])
    assert clusters(spark, short, [log(-i, i) for i in range(1, 6)])[0]["spike"]


def test_cluster_ids_follow_arrival_and_level_is_the_first_one(spark, one_request):
    rows = [log(-5, 3, message="late", level="WARN"), log(-50, 7, message="late", level="ERROR"), log(-1, 1, message="early")]
    got = clusters(spark, one_request, rows)
    assert [(c["evidence_id"], c["message_template"], c["level"]) for c in got] == [("log-1", "early", "ERROR"), ("log-2", "late", "WARN")]


def test_key_text_merges_null_and_the_word_null(spark, one_request):
    rows = [log(-5, 1, stack_trace=None, attributes={}), log(-4, 2, stack_trace=None, attributes={"exceptionClass": "null"})]
    got = clusters(spark, one_request, rows)
    assert [(c["count"], c["exception_class"]) for c in got] == [(2, None)]


def test_explicit_and_fallback_class_stay_two_clusters(spark, one_request):
    got = clusters(spark, one_request, [log(-5, 1), log(-4, 2, attributes={})])
    assert [c["exception_class"] for c in got] == ["NullPointerException", "java.lang.NullPointerException"]


def test_frame_beyond_the_kept_lines_is_null(spark, one_request):
    deep = "boom\n" + "\n".join(f"note {i}" for i in range(12)) + "\n\tat a.B.c(B.java:1)"
    assert clusters(spark, one_request, [log(-5, 1, stack_trace=deep)])[0]["top_stack_frame"] is None


def test_sample_is_the_sanitized_first_event(spark, one_request):
    logs = frame(spark, S.LOG_EVENTS, [log(-5, 2, message="x token=1"), log(-9, 5, message="x token=2")])
    full = K.attach_samples(K.log_clusters(one_request, logs), logs).first()
    assert full["sample"]["message"] == "x ***" and full["sample"]["trace_id"] == "trace-2"


def test_overlapping_requests_see_the_same_events(spark):
    requests = frame(spark, S.REQUESTS, [request(), request(request_id="r2", from_ts=at(-3000)), request(request_id="r3", to_ts=at(-30))])
    logs = frame(spark, S.LOG_EVENTS, [log(-5, 1), log(-60, 2), log(-2900, 3)])
    got = {r["request_id"]: r["count"] for r in K.log_clusters(requests, logs).collect()}
    assert got == {"r1": 2, "r2": 3, "r3": 1}


def candidates(spark, requests, logs=(), changes=(), metrics=(), slow_sql=()):
    def tied(schema, rows):
        return frame(spark, schema, list(rows)).withColumn("request_id", F.lit("r1"))

    found = K.log_clusters(requests, frame(spark, S.LOG_EVENTS, list(logs)))
    got = J.rule_candidates(tied(S.CHANGE_EVENTS, changes), found, tied(S.SLOW_SQL, slow_sql), tied(S.METRIC_ANOMALIES, metrics))
    return {r["label"]: (r["strength"], r["evidence_ids"]) for r in got.collect()}


SPIKE = [log(-1 - i, i) for i in range(8)]


@pytest.mark.parametrize("changes,expected", [
    ([change(-20)], {C.DEPLOYMENT_REGRESSION: ("STRONG", ["deploy-1", "log-1"])}),
    ([change(-180, 1, "old"), change(-20, 2, "near")], {C.DEPLOYMENT_REGRESSION: ("STRONG", ["near", "log-1"])}),
    ([change(5)], {C.DEPLOYMENT_REGRESSION: ("STRONG", ["deploy-1", "log-1"])}),
    ([change(-20, type="CONFIG_CHANGE")], {}),
    ([change(-180)], {}),
])
def test_deployment_rule(spark, one_request, changes, expected):
    assert candidates(spark, one_request, SPIKE, changes) == expected


@pytest.mark.parametrize("metrics,slow,expected", [
    ([metric(-28, "db_pool_pending")], [sql(-30)], {C.POOL_CONTENTION: ("STRONG", ["sql-1", "metric-1"])}),
    ([metric(-28, "cpu_usage")], [sql(-30)], {}),
    ([metric(-28, "http_P95")], [sql(-30)], {C.LATENCY_CORRELATION: ("MODERATE", ["sql-1", "metric-1"])}),
    ([metric(-28, "p95", 1, "m1"), metric(-28, "pool", 2, "m2")], [sql(-30)], {C.POOL_CONTENTION: ("STRONG", ["sql-1", "m2"])}),
    ([metric(60, "pool")], [sql(-30)], {}),
    ([metric(-20, "pool")], [sql(-30)], {C.POOL_CONTENTION: ("STRONG", ["sql-1", "metric-1"])}),
    ([metric(-28, "pool")], [sql(-100, 9000, 1, "slower"), sql(-30, 100, 2, "near")], {C.POOL_CONTENTION: ("STRONG", ["near", "metric-1"])}),
])
def test_slow_sql_rules(spark, one_request, metrics, slow, expected):
    assert candidates(spark, one_request, metrics=metrics, slow_sql=slow) == expected


@pytest.mark.parametrize("few", [True, False])
def test_first_match_equals_brute_force(spark, few):
    rng = random.Random(11)
    left = [(f"r{rng.randint(0, 5)}", f"c{i:03d}", at(rng.randint(-4000, 0) + rng.random()), i) for i in range(150)]
    right = [(f"r{rng.randint(0, 5)}", f"l{i:03d}", at(rng.randint(-4000, 0) + rng.random()), rng.randint(1, 4), i) for i in range(60)]
    changes = spark.createDataFrame(left, "request_id string, evidence_id string, occurred_at timestamp_ntz, change_seq long").withColumn("type", F.lit("DEPLOYMENT"))
    found = spark.createDataFrame(right, "request_id string, evidence_id string, last_seen timestamp_ntz, count long, cluster_seq long").withColumn("spike", F.lit(True))
    got = {r["request_id"]: r["evidence_ids"] for r in J.deployment_regression(changes, found, few_requests=few).collect()}
    expected = {}
    for req, cid, when, _ in sorted(left, key=lambda x: x[3]):
        inside = [x for x in right if x[0] == req and -600 <= (x[2] - when).total_seconds() <= 3600]
        if inside and req not in expected:
            expected[req] = [cid, min(inside, key=lambda x: (-x[3], x[4]))[1]]
    assert got == expected and expected


def test_strength(spark):
    df = spark.createDataFrame([(2, True, False), (2, False, True), (3, False, False), (1, True, True)], "s int, t boolean, h boolean")
    assert [r[0] for r in df.select(R.evidence_strength(F.col("s"), F.col("t"), F.col("h"))).collect()] == ["STRONG", "STRONG", "MODERATE", "WEAK"]


def test_budget_prefers_spikes_and_counts_cuts(spark, one_request):
    rows = [("r1", f"log-{i}", i, i == 2, i) for i in range(1, 11)]
    found = spark.createDataFrame(rows, "request_id string, evidence_id string, count long, spike boolean, cluster_seq long")
    assert [r["evidence_id"] for r in B.keep_clusters(found, 3).orderBy("rank_no").collect()] == ["log-2", "log-10", "log-9"]
    none = spark.createDataFrame([], "request_id string")
    report = B.budget_report(one_request, found, none, none, none, (3, 15, 20, 20)).first()
    assert (report["log_clusters_kept"], report["log_clusters_truncated"], report["any_truncated"]) == (3, 7, True)


@pytest.mark.parametrize("n", [7, 1500, "column"])
def test_top_n_with_a_hot_group(spark, n):
    """One group holds most rows; every way to limit it gives the same winners."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(0).alias("g"), (F.col("id") * 7919 % 6007).alias("v"))
    limit = F.lit(9) if n == "column" else n
    size = 9 if n == "column" else n
    got = {(r["g"], r["rank_no"]): r["v"] for r in top_n(df, ["g"], [F.desc("v")], limit).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append(r["v"])
    expected = {(g, i + 1): v for g, vs in groups.items() for i, v in enumerate(sorted(vs, reverse=True)[:size])}
    assert got == expected


@pytest.mark.parametrize("keys", [["g"], []])
def test_number_rows_with_a_hot_group(spark, keys):
    df = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(0).alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    rows = number_rows(df, keys, [F.col("v")], "n").collect()
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append((r["v"], r["n"]))
    assert len(rows) == 5000
    for members in groups.values():
        assert [n for _, n in sorted(members)] == list(range(1, len(members) + 1))


@pytest.mark.parametrize("broadcast", [True, False])
def test_shared_minutes_and_shuffle_joins_change_nothing(spark, monkeypatch, broadcast):
    """Counting per minute for all requests, and joining without a broadcast, give equal clusters."""
    rng = random.Random(5)
    logs = frame(spark, S.LOG_EVENTS, [
        log(-rng.random() * 300 if i % 3 else -10 - rng.random() / 30, i, message=f"kind {rng.choice('ab')}", level=rng.choice(["WARN", "ERROR"]))
        for i in range(400)])
    requests = frame(spark, S.REQUESTS, [
        request(request_id=f"r{i}", from_ts=at(-300 + 7.3 * i), to_ts=at(-10 * (i % 3) - i * 0.013)) for i in range(12)])
    columns = ["request_id", "evidence_id", "cluster_key", "level", "count", "baseline_count", "spike", "first_seen", "last_seen", "first_seq"]
    plain = {tuple(r) for r in K.log_clusters(requests, logs, capped=request_evidence(requests, logs)).select(columns).collect()}
    if not broadcast:
        monkeypatch.setattr("incidentlens.session.BROADCAST_ROWS", 0)
    shared = {tuple(r) for r in K.log_clusters(requests, logs).select(columns).collect()}
    assert shared == plain and len(plain) >= 24


@pytest.mark.parametrize("source,expected", [
    ("mock", ["log-1 b", "log-2 a"]), ("local-file", ["log-1 b", "log-2 c"]), ("jdbc", ["log-1 c", "log-2 b"])])
def test_row_limit_and_arrival_of_each_source(spark, source, expected):
    """Which rows stay under a limit, and which cluster is met first, depend on the source."""
    from incidentlens.sources.logs import capped_logs

    requests = frame(spark, S.REQUESTS, [request(max_results=2)])
    logs = frame(spark, S.LOG_EVENTS, [log(-20, 1, message="b"), log(-30, 2, message="a"), log(-10, 3, message="c")])
    capped = capped_logs(requests, logs, source)
    found = K.attach_samples(K.log_clusters(requests, logs, capped=capped), capped).orderBy("cluster_seq").collect()
    assert [f"{c['evidence_id']} {c['message_template']}" for c in found] == expected
    assert [c["sample"]["message"] for c in found] == [c["message_template"] for c in found]

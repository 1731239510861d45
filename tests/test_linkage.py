"""Nearest rows, links of evidence and question-led retention against plain loops."""

import datetime as dt
import random

from incidentlens import schemas as S
from incidentlens.operators import linkage as W
from incidentlens.operators import retention as Q
from fixtures import ANCHOR, at, frame

SIDE = ("evidence_id string, project_id string, environment string, occurred_at timestamp_ntz, trace_id string, request_uri string, "
        "sql_source string, module string, exception_class string")


def _rows(rng, prefix, count):
    """A third in one trace, module and address; nulls in every key and time; many rows at the same second."""
    rows = []
    for n in range(count):
        hot = n % 3 == 0
        second = rng.choice([0, 30, 31, 60]) if n % 4 == 0 else rng.randrange(0, 4000)
        rows.append((
            f"{prefix}{n}", "p" if hot or n % 5 else None, "e", None if n % 29 == 7 else ANCHOR + dt.timedelta(seconds=second),
            "hot" if n % 9 == 0 else rng.choice([None, None, f"t{n % 40}"]), rng.choice([None, f"/u{n % 6}"]), f"s{n % 2}",
            rng.choice([None, "m"]), rng.choice([None, f"E{n % 3}"])))
    return rows


def _brute(left, right, kinds):
    out = {}
    for row in left:
        best = None
        for n, tier in enumerate(kinds):
            columns = [1, 2, *[SIDE.replace(" string", "").replace(" timestamp_ntz", "").split(", ").index(k) for k in tier.keys]]
            fits = [
                (abs(row[3] - r[3]), r[3], r[0]) for r in right
                if row[3] and r[3] and all(row[c] is not None and row[c] == r[c] for c in columns)]
            if fits and (tier.seconds is None or min(fits)[0].total_seconds() <= tier.seconds):
                best = (tier.label, min(fits)[0] // dt.timedelta(microseconds=1), min(fits)[2])
                break
        out[row[0]] = best
    return out


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    left, right = _rows(rng, "a", 300), _rows(rng, "b", 250)
    kinds = W.tiers(2)
    got = W.link_evidence(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE), kinds).collect()
    want = _brute(left, right, kinds)
    assert {r.evidence_id: r.correlation_type and (r.correlation_type, r.gap_us, r.linked_id) for r in got} == want and len(got) == 300
    labels = {r.correlation_type for r in got}
    assert labels == {W.TRACE_ID, W.REQUEST_SCOPED, W.MODULE_SCOPED, W.TEMPORAL_ONLY, None}
    strengths = {(r.correlation_type, r.definite, r.strength) for r in got}
    assert strengths == {
        (W.TRACE_ID, True, "STRONG"), (W.REQUEST_SCOPED, True, "MODERATE"), (W.MODULE_SCOPED, True, "MODERATE"),
        (W.TEMPORAL_ONLY, False, "MODERATE"), (None, False, "WEAK")}


def test_links_of_empty_sides(spark):
    some, none = spark.createDataFrame(_rows(random.Random(1), "a", 5), SIDE), spark.createDataFrame([], SIDE)
    assert {(r.linked_id, r.strength) for r in W.link_evidence(some, none).collect()} == {(None, "WEAK")}
    assert W.link_evidence(none, some).count() == 0


def test_nearest_over_many_tasks(spark):
    """One key over all tasks: partners stand in earlier and later tasks."""
    left = spark.range(2000).selectExpr("'k' AS key", "id AS name", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id) AS at")
    right = spark.createDataFrame(
        [("k", 1, dt.datetime(2026, 1, 1)), ("k", 2, dt.datetime(2026, 1, 1, 0, 20)), ("k", 3, dt.datetime(2026, 1, 1, 0, 20))],
        "key string, pick long, seen timestamp_ntz")
    got = {r.name: (r.pick, r.gap_us) for r in W.nearest(left, right, ["key"], "name", "at", "seen", "pick").collect()}
    assert got == {n: (1, n * 10 ** 6) if n <= 600 else (2, abs(1200 - n) * 10 ** 6) for n in range(2000)}


def test_question_leads_then_severity_frequency_and_deployment(spark):
    asked = frame(spark, S.REQUESTS, [
        dict(request_id="r1", project_id="p", environment="e", question="Why does the payment fail? password=ERROR1", from_ts=at(-60), to_ts=at(0), max_results=5),
        dict(request_id="r2", project_id="p", environment="e", question=None, from_ts=at(-60), to_ts=at(0), max_results=5)])
    columns = "request_id string, evidence_id string, cluster_seq long, level string, count long, last_seen timestamp_ntz, exception_class string, message_template string, top_stack_frame string"
    rows = [
        (r, f"log-{n}", n, level, count, at(minutes), None, text, None)
        for r in ("r1", "r2") for n, (level, count, minutes, text) in enumerate([
            ("WARN", 900, -30, "disk is full"), ("ERROR", 7, -30, "repayment order"), ("ERROR", 7, -2, "error1 here"),
            ("warn", 1, -50, "Payment of <n> refused"), ("ERROR", 8, -50, None)], start=1)]
    clusters = spark.createDataFrame(rows, columns)
    changes = frame(spark, "request_id string, " + S.CHANGE_EVENTS, [
        dict(request_id=r, evidence_id="event-1", project_id="p", environment="e", type=kind, occurred_at=at(m), change_seq=1)
        for r, kind, m in (("r1", "ROLLBACK", -1), ("r2", "CONFIG_CHANGE", -1))])
    kept = Q.keep_asked_clusters(asked, clusters, changes, 4).orderBy("request_id", "rank_no").collect()
    # named first though rare; then errors, the more frequent one, then the one nearer to the rollback
    assert [r.evidence_id for r in kept if r.request_id == "r1"] == ["log-4", "log-5", "log-3", "log-2"]
    # without a question and a deployment: severity, frequency, order of appearance
    assert [r.evidence_id for r in kept if r.request_id == "r2"] == ["log-5", "log-2", "log-3", "log-1"]
    assert {r.deployment_gap_us for r in kept if r.request_id == "r2"} == {None}
    assert kept[0].question_hits == 1 and kept[0].deployment_gap_us == 49 * 60 * 10 ** 6

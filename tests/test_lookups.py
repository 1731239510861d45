"""Range look-ups, the newest row up to a time, audit digests and posted batches against plain counting."""

import datetime as dt
import random

from incidentlens import schemas as S
from incidentlens.operators import asof, audit, batches
from incidentlens.operators import clustering as K
from incidentlens.operators.joins import request_evidence
from incidentlens.session import request_scope
from incidentlens.sources import store as O
from incidentlens.streaming import batches as SB
from incidentlens.streaming import ingest as SI
from fixtures import ANCHOR, at

PARTS = "project_id string, environment string, occurred_at timestamp_ntz, arrival_seq long, level string, exception_class string, message_template string, top_stack_frame string"


def test_range_counts_equal_counting(spark):
    """Ranges that cut minutes anywhere, shorter than a minute or than the current window, over a hot cluster and sparse ones."""
    rng = random.Random(11)
    rows = []
    for n in range(1500):
        hot = n % 3 == 0
        second = rng.randrange(0, 7200) if hot else rng.choice([0, 60, 61, 119, 120, 3599, 3600, 5000, 7199])
        stamp = ANCHOR + dt.timedelta(seconds=second, microseconds=rng.choice([0, 0, 1, 999_999]))
        rows.append(("p", "e" if n % 5 else "f", stamp, rng.randrange(10 ** 6) * 2000 + n, "WARN", "E" if hot else None, "hot" if hot else f"m{n % 4}", None))
    parts = spark.createDataFrame(rows, PARTS)
    asked = []
    for n in range(60):
        low = rng.choice([0, 59, 60, 61, 600, rng.randrange(7000)])
        span = rng.choice([1, 30, 60, 119, 120, 600, 3600, rng.randrange(1, 7200)])
        begin = ANCHOR + dt.timedelta(seconds=low, microseconds=rng.choice([0, 1]))
        asked.append((f"r{n}", "p", rng.choice(["e", "f"]), "q", begin, begin + dt.timedelta(seconds=span), 10))
    requests = spark.createDataFrame(asked, S.REQUESTS)
    for current in (600.0, 90.5, 60.0):
        want = K.cluster_counts(request_evidence(requests, parts), current)
        got = K.shared_cluster_counts(requests, parts, request_scope(requests), current)
        columns = sorted(want.columns)
        assert want.select(columns).exceptAll(got.select(columns)).count() == 0 and got.count() == want.count() > 60
    assert K.minute_bounds(requests, 600).count() == 4 * len(asked)


def test_first_arrivals_cover_every_range(spark):
    rng = random.Random(2)
    seqs = [rng.randrange(10 ** 6) for _ in range(37)]
    minutes = spark.createDataFrame(
        [("p", "e", None, "m", None, "WARN", at(n), 1, at(n), at(n), s) for n, s in enumerate(seqs)],
        "project_id string, environment string, exception_class string, message_template string, top_stack_frame string, level string, "
        "_minute timestamp_ntz, _rows long, _first timestamp_ntz, _last timestamp_ntz, _seq long")
    least = {r["_place"]: r["_least"] for r in K.first_arrivals(minutes).collect()}
    for low in range(1, 38):
        for high in range(low, 38):
            level = (high - low + 1).bit_length() - 1
            assert min(least[low][level], least[high - (1 << level) + 1][level]) == min(seqs[low - 1: high])


def test_latest_before(spark):
    """Ties, rows at the same time, keys of one side only, rows without a time, one key with most rows."""
    rng = random.Random(4)
    left = [(n, "hot" if n % 3 else f"k{n % 7}", rng.randrange(50)) for n in range(400)]
    right = [("hot" if n % 2 else f"k{n % 5}", rng.randrange(50) if n % 11 else None, f"s{rng.randrange(9)}") for n in range(300)]
    got = asof.latest_before(
        spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, seen int, pick string"), ["k"], "id", "t", "seen", "pick")
    assert got.columns == ["id", "k", "seen", "pick"]
    want = set()
    for n, k, t in left:
        fits = [(seen, pick) for key, seen, pick in right if key == k and seen is not None and seen <= t]
        if fits:
            want.add((n, k, *max(fits)))
    assert {tuple(r) for r in got.collect()} == want


def test_audit_digest(spark):
    rows = [("r1", f"e{n}", "LOG", "text" if n % 2 else None) for n in range(50)] + [("r2", "e", "LOG", "")]
    schema = "request_id string, evidence_id string, type string, description string"

    def digest(rows, parts):
        df = audit.evidence_audit(spark.createDataFrame(rows, schema).repartition(parts), "evidence_id", "type", "description")
        return {r.request_id: (r.rows, r.characters, r.payload_digest) for r in df.collect()}

    base = digest(rows, 1)
    assert base == digest(rows[::-1], 7) and base["r1"][0] == 50
    changed = [
        rows[:-2] + rows[-1:], rows[:3] + rows[2:], [("r1", "e0", "LOG", "")] + rows[1:], [("r1", "e0L", "OG", None)] + rows[1:],
        [("r1", "e1", "LOG", None), ("r1", "e0", "LOG", "text")] + rows[2:]]
    assert len({digest(c, 3)["r1"][2] for c in changed} | {base["r1"][2]}) == len(changed) + 1
    assert all(digest(c, 2)["r2"] == base["r2"] for c in changed)


BATCH = (
    "received_seq long, request_id string, sent_at timestamp_ntz, received_at timestamp_ntz, token_project string, token_environments array<string>, "
    "project_id string, environment string, events array<struct<type:string,occurred_at:timestamp_ntz,attributes:map<string,string>,bytes:bigint>>")


def _batch(seq, name, minute=0, events=1, size=10, age=0, project="p", token="p", environment="e"):
    received = at(minute)
    return (seq, name, received - dt.timedelta(seconds=age), received, token, ["e", "f"], project, environment,
            [("DEPLOYMENT", received, {"n": str(n)}, size) for n in range(events)])


def test_batch_bounds_and_repeats(spark):
    rows = [
        _batch(1, "a"), _batch(2, "a", 1), _batch(3, "a", token="q"), _batch(4, " "), _batch(5, None), _batch(6, "b", environment="moon"), _batch(7, "c", age=300),
        _batch(8, "d", age=301), _batch(9, "e", age=-301), _batch(10, "f", events=4), _batch(11, "g", events=3, size=16385), _batch(12, "h", events=3, size=16384),
        _batch(13, "i", events=0), _batch(14, "j", age=999), _batch(15, "j"), _batch(16, "k", events=3, size=400_000), _batch(17, "a", token="q", project="q")]
    judged = batches.judge_batches(spark.createDataFrame(rows, BATCH), max_events=3)
    got = {r.received_seq: r.reject_reason for r in judged.collect()}
    assert got == {
        1: None, 2: "duplicate", 3: "project-mismatch", 4: "blank-request-id", 5: "blank-request-id", 6: "environment-not-allowed", 7: None, 8: "stale", 9: "stale",
        10: "too-many-events", 11: "event-too-large", 12: None, 13: "empty", 14: "stale", 15: None, 16: "batch-too-large", 17: None}
    assert batches.batch_events(judged).count() == 1 + 1 + 3 + 1 + 1
    counts = {(r.token_project, r.result): (r.batches, r.events) for r in batches.batch_audit(judged).collect()}
    assert counts["p", "accepted"] == (4, 6) and counts["p", "stale"] == (3, 3) and counts["q", "accepted"] == (1, 1)


def test_streamed_batches_once(spark, tmp_path):
    """A batch posted again, in the same or a later micro-batch, changes nothing; refused ones are kept aside."""
    source = str(tmp_path / "in")
    spark.createDataFrame([_batch(1, "a"), _batch(2, "b", 1, events=2), _batch(3, "a", 2), _batch(4, "c", age=400)], BATCH).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(BATCH).parquet(source)
    accepted, rejected = str(tmp_path / "accepted"), str(tmp_path / "rejected")

    def run():
        for query in SB.start_batch_ingest(stream, accepted, rejected, str(tmp_path / "progress"), max_events=3):
            query.awaitTermination(120)
        return spark.read.parquet(accepted).count(), spark.read.parquet(rejected).select("reject_reason").collect()

    assert run() == (3, [("stale",)])
    spark.createDataFrame([_batch(5, "a", 3), _batch(6, "d", 4)], BATCH).coalesce(1).write.mode("append").parquet(source)
    assert run() == (4, [("stale",)]) and run() == (4, [("stale",)])


def test_ids_come_from_the_table_of_ids(spark, tmp_path, monkeypatch):
    """Each batch continues after the highest id of the batches before it, read from one row a batch and not from stored events."""
    store, looked = str(tmp_path / "store"), []
    stored = SI._stored
    monkeypatch.setattr(SI, "_stored", lambda s, path: looked.append(path) or stored(s, path))
    assert SI.last_id_before(spark, store, 0) == 0 and looked == [f"{store}/_ids", store]
    SI.note_last_id(spark, store, 0, 7)
    SI.note_last_id(spark, store, 1, 12)
    SI.note_last_id(spark, store, 1, 12)
    looked.clear()
    assert [SI.last_id_before(spark, store, n) for n in (0, 1, 2, 9)] == [0, 7, 12, 12] and looked == [f"{store}/_ids"] * 4
    assert spark.read.parquet(f"{store}/_ids").count() == 2


def test_heads_of_all_reports(spark):
    rows = [("d1", "p", "e", at(0), 1, '{"diagnosisId":"d1","projectId":"p","environment":"e","summary":"s"}'), ("d2", "p", "e", at(1), 1, "{broken")]
    heads = O.report_heads(spark.createDataFrame(rows, S.STORED_REPORTS)).collect()
    assert [(r.diagnosis_id, r.summary, r.rule_fallback) for r in heads] == [("d1", "s", False)]

"""Registered queries on numbers and texts that the given tables do not hold."""

import datetime as dt
import random
from functools import reduce

from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions import text as X
from incidentlens.operators import clustering as K
from incidentlens.plans import catalog, oracle
from incidentlens.sources import textlog as M
from compare import differences
from conftest import TESTDATA


def test_report_ids_beyond_three_digits(spark, tmp_path):
    """Stored numbers from 1000 on are taken as they are, and turns without a role come last."""
    for given in (TESTDATA / "sf0.001").glob("*.parquet"):
        if given.stem != "conversations":
            (tmp_path / given.name).symlink_to(given)
    numbers = [1, 2, *range(994, 1012), 12346]
    turns = [(n, t, None if t == 3 else "user", "hi") for n in numbers for t in range(60)]
    made = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").toPandas()
    made.to_parquet(tmp_path / "conversations.parquet")
    sf_dir = str(tmp_path)
    assert differences(catalog.assign_report_ids(spark, sf_dir), sf_dir, oracle.all_sql()["assign_report_ids"]) == []


LOGS = "project_id string, environment string, occurred_at timestamp, arrival_seq long, level string, message string, stack_trace string, attributes map<string,string>"


def _plain(text, rules):
    """Every pattern as it is written, in order, on every text."""
    return reduce(lambda column, rule: F.regexp_replace(column, *rule), rules, text)


def test_parts_equal_plain_patterns_with_few_searches(spark):
    rng = random.Random(3)
    pieces = [
        "Bearer", "authorization", "AUTHORIZATION: bearer", "password", "Passwd", "pwd", "tOKen", "api-key", "api_Key", "apikey", "secret", "=", ":", " ", " ", "\"", ",", "@",
        "a@b.com", "x.y-z", ".", "-", "13912345678", "12345678901", "123456789012345678", "12345678901234567X", "7", "10.0.3.7", "deadbeefdeadbeef", "0123456789abcdef",
        "2024-01-02 03:04:05.678", "2024-01-02T03:04:05Z", "123e4567-e89b-12d3-a456-426614174000", "é", "汉", "_", "k\u212aey", "\n", "abc", "1200", "",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(700)]
    texts += ["w " * 595 + t for t in texts[:200]] + [None, ""]
    rows = [("p", "e", dt.datetime(2024, 1, 1), n, "WARN", t, t and f"a.BException: {t}\n\tat c.D(E.java:{n})", {"exceptionClass": t} if n % 3 else None)
            for n, t in enumerate(texts)]
    logs = spark.createDataFrame(rows, LOGS)
    parts = K.cluster_parts(logs)
    masks = [(p, C.MASK) for p in C.SECRET_PATTERNS]
    masked = _plain(F.col("message"), masks)
    stack = X.limit_stack_lines(_plain(F.col("stack_trace"), masks))
    again = F.when(F.length(masked) > C.MAX_SAMPLE_CHARS, _plain(X.truncate(masked), masks)).otherwise(masked)
    want = logs.select(
        "arrival_seq", X.cluster_exception(_plain(F.col("attributes")["exceptionClass"], masks), stack).alias("exception_class"),
        X.trim_control(_plain(again, C.TEMPLATE_PATTERNS)).alias("message_template"), X.top_stack_frame(stack).alias("top_stack_frame"))
    assert {r.arrival_seq: tuple(r[c] for c in K.PARTS) for r in parts.collect()} == {
        r.arrival_seq: tuple(r[c] for c in K.PARTS) for r in want.collect()}
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 30


def test_text_events_are_parsed_once(spark, tmp_path, monkeypatch):
    """What is numbered by a range shuffle, which reads its input twice, is already computed."""
    (tmp_path / "a.log").write_text("2024-01-01 00:00:00.000 WARN [w] a.B - one\n\tat x\n2024-01-01 00:00:01.000 ERROR [w] a.B - two\n")
    plans, numbered = [], M.number_rows
    monkeypatch.setattr(M, "number_rows", lambda rows, *rest: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or numbered(rows, *rest))
    logs, state = M.read_log_files(spark, [str(tmp_path / "a.log")], project_id="p", environment="e")
    assert state == "ok" and [r.message for r in logs.orderBy("arrival_seq").collect()] == ["one", "two"]
    assert len(plans) == 1 and "LogicalRDD" in plans[0] and "Window" not in plans[0]

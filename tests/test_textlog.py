import datetime as dt

import pytest
from pyspark.sql import functions as F

from incidentlens.functions import logline as L
from incidentlens.operators.joins import request_evidence
from incidentlens.sources import textlog as M
from incidentlens.sources.logs import most_recent
from fixtures import frame, request
from incidentlens import schemas


def read(spark, *paths, **options):
    rows, state = M.read_log_files(spark, [str(p) for p in paths], project_id="p", environment="e", **options)
    return rows, state


def events(spark, tmp_path, text, name="app.log", encoding="utf-8", **options):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    rows, _ = read(spark, path, **options)
    return [r.asDict() for r in rows.orderBy("arrival_seq").collect()]


def test_multi_line_event(spark, tmp_path):
    got = events(spark, tmp_path, (
        "preamble\n2026-06-01 10:12:31.123 ERROR [http-1] com.example.Foo - Create failed\n"
        "java.lang.NullPointerException: x\n\tat a.B.c(B.java:1)\n\tat d.E.f(E.java:2)\n"
        "2026-06-01 10:12:32.000 INFO [http-1] com.example.Foo - fine\nits tail\n"))
    assert len(got) == 1
    assert got[0]["attributes"] == {"exceptionClass": "NullPointerException"}
    assert got[0]["stack_trace"].count("\tat ") == 2
    assert got[0]["message"] == "Create failed"


def test_levels_zone_and_prose(spark, tmp_path):
    lines = [f"2026-06-01 10:00:0{i}.000 {level} [t] a.B - msg TimeoutException" for i, level in
             enumerate(["DEBUG", "INFO", "WARN", "ERROR"])]
    got = events(spark, tmp_path, "\n".join(lines), zone="Asia/Shanghai")
    assert [g["level"] for g in got] == ["WARN", "ERROR"]
    assert got[0]["occurred_at"] == dt.datetime(2026, 6, 1, 2, 0, 2)
    assert got[0]["attributes"] == {}


def test_iso_and_offset_stamps(spark, tmp_path):
    got = events(spark, tmp_path, (
        "2026-06-01T10:00:00.500 ERROR [t] a.B - one\n2026-06-01T10:00:00.500+08:00 ERROR 12 --- [t] a.B : two\n"
        "2026-02-30 10:00:00.500 ERROR [t] a.B - unreadable day\n"))
    assert [(g["message"], g["occurred_at"].hour) for g in got] == [("two", 2), ("one", 10)]  # by time


def test_deep_stack_is_bounded(spark, tmp_path):
    head = "2026-06-01 10:00:00.500 ERROR [t] a.B - deep\n"
    got = events(spark, tmp_path, head + "\n".join(f"\tat f{i}" for i in range(5001)))
    stack = got[0]["stack_trace"].split("\n")
    assert len(stack) == 101 and stack[-1] == "…"


def test_stack_characters_are_bounded(spark, tmp_path):
    head = "2026-06-01 10:00:00.500 ERROR [t] a.B - deep\n\n\n"
    got = events(spark, tmp_path, head + "\n".join(["x" * 8192, "y" * 8191, "z", "cut"]))
    assert got[0]["stack_trace"] == "\n".join(["x" * 8192, "y" * 8191, "…"])


def test_missing_files(spark, tmp_path):
    rows, state = read(spark, tmp_path / "nope.log")
    assert rows is None and state == "error"
    good = tmp_path / "good.log"
    good.write_text("2026-06-01 10:00:00.500 ERROR [t] a.B - one\n")
    rows, state = read(spark, tmp_path / "nope.log", good)
    assert rows.count() == 1 and state == "ok"


def test_charset_and_char_limit(spark, tmp_path):
    line = "2026-06-01 10:00:00.500 ERROR [t] a.B - 订单失败\n"
    assert events(spark, tmp_path, line, encoding="gbk", charset="GBK")[0]["message"] == "订单失败"
    two = "2026-06-01 10:00:00.500 ERROR [t] a.B - one\n2026-06-01 10:00:00.500 ERROR [t] a.B - two\n"
    assert len(events(spark, tmp_path, two, name="two.log", max_chars_per_file=50)) == 1


def test_custom_pattern_and_colours(spark, tmp_path):
    pattern = r"(?<ts>\S+ \S+)\|(?<level>\w+)\|(?<logger>[^|]+)\|(?<msg>.*)"
    got = events(spark, tmp_path, "2026-06-01 10:00:00.5|ERROR|a.B|\x1b[31mred\x1b[0m text\n", pattern=pattern)
    assert got[0]["message"] == "red text" and got[0]["logger"] == "a.B"
    with pytest.raises(ValueError):
        L.check_pattern(r"(?<ts>\S+) (.*)")


def test_one_big_file_over_many_blocks(spark, tmp_path):
    """Events keep their lines when a file is read in many blocks by different tasks."""
    lines = []
    for i in range(3000):
        level = "ERROR" if i % 3 == 0 else "INFO"
        lines.append(f"2026-06-01 10:{i // 60 % 60:02d}:{i % 60:02d}.000 {level} [t] a.B - event {i}")
        lines += [f"line {i}.{j}" for j in range(i % 5)]
    path = tmp_path / "big.log"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "9000")
    try:
        raw = M.read_lines(spark, [str(path)])
        assert raw.select("block").distinct().count() > 5
        rows, _ = read(spark, path)
        got = {r["message"]: r["stack_trace"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    expected = {f"event {i}": "\n".join(f"line {i}.{j}" for j in range(i % 5)) or None for i in range(0, 3000, 3)}
    assert got == expected


def test_newest_n(spark, tmp_path):
    path = tmp_path / "ten.log"
    path.write_text("".join(f"2026-06-01 02:00:0{i}.000 ERROR [t] a.B - e{i}\n" for i in range(10)))
    rows, _ = read(spark, path)
    requests = frame(spark, schemas.REQUESTS, [request("p", "e")])
    newest = most_recent(request_evidence(requests, rows), 3)
    assert sorted(r["message"] for r in newest.collect()) == ["e7", "e8", "e9"]


@pytest.mark.parametrize("line,expected", [
    ("2026-06-01 10:12:31.123 ERROR [http-1] com.example.Foo - message", ("http-1", "com.example.Foo", "message")),
    ("2026-06-01 10:12:31,123 WARN com.example.Foo - no thread", (None, "com.example.Foo", "no thread")),
    ("2026-06-01T10:12:31.123+08:00 ERROR 1234 --- [main] com.example.Foo : boot", ("main", "com.example.Foo", "boot")),
    ("\tat com.example.Foo.bar(Foo.java:1)", None),
])
def test_head_layouts(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string")
    row = df.select(L.is_head(F.col("line")), *[L.head_field(F.col("line"), n) for n in ("thread", "logger", "msg")]).first()
    assert row[0] == (expected is not None)
    if expected:
        assert tuple(row[1:]) == expected


def test_documents_split_equals_line_scan(spark):
    texts = ["pre\nHead one\ntail\n\nHead two", "Only", "none here\nnope", "A\nB\nc\n", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r["doc_id"], r["event_no"]): (r["head"], r["continuation"]) for r in M.split_document_events(df).collect()}
    expected = {}
    for doc, text in enumerate(texts):
        number = 0
        for line in text.split("\n"):
            if line[:1].isupper():
                number += 1
                expected[doc, number] = (line, [])
            elif number:
                expected[doc, number][1].append(line)
    assert got == expected


def test_size_bound_counts_the_file_as_it_is(spark, tmp_path):
    """Colour codes count: with them only two of three events fit."""
    line = "2026-06-01 02:00:0{}.000 \x1b[31mERROR\x1b[0m [t] a.B - e\n"
    path = tmp_path / "colour.log"
    path.write_text("".join(line.format(i) for i in range(3)))
    rows, _ = read(spark, path, max_chars_per_file=2 * len(line.format(0)) + 50)
    assert rows.count() == 2


def test_rows_without_arrival_number_are_refused(spark, tmp_path):
    from incidentlens.operators.clustering import log_clusters

    logs = frame(spark, schemas.LOG_EVENTS, []).unionByName(spark.sql(
        "SELECT 'p' project_id, 'e' environment, TIMESTAMP_NTZ'2026-06-01 02:00:00' occurred_at, 'ERROR' level, 'l' logger, "
        "'t' trace_id, 'm' message, CAST(NULL AS STRING) stack_trace, CAST(NULL AS MAP<STRING, STRING>) attributes, CAST(NULL AS BIGINT) arrival_seq"))
    requests = frame(spark, schemas.REQUESTS, [request("p", "e")])
    with pytest.raises(Exception, match="arrival_seq"):
        log_clusters(requests, logs).collect()

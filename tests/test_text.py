import random

import regex
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions import text as X


def run(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_redact(spark):
    cases = {
        "login password=hunter2 ok": "login *** ok",
        'body token: "abc.def" end': "body *** end",
        "Authorization: Bearer abc.def.ghi tail": "*** tail",
        "bearer xyz, next": "***, next",
        "mail a.b@example.com now": "mail *** now",
        "call 13800138000!": "call ***!",
        "long 138001380001 digits": "long 138001380001 digits",
        "id 11010119900307123X.": "id ***.",
        "apiKey: 123; api_key=4": "***; ***",
    }
    assert run(spark, list(cases), X.redact) == list(cases.values())
    assert run(spark, [None], X.redact) == [None]


def _random_texts(n=400):
    rng = random.Random(7)
    bits = ["password", "token", "bearer", "authorization", "=", ":", " ", '"', ",", ";", ")", "abc", "x@y.com",
            "13800138000", "110101199003071234", "X", "é", "\n", "\t", "1.2.3.4", "deadbeefdeadbeef", "12", "***",
            "2024-01-02T03:04:05Z", "_", "at ", "…", "123e4567-e89b-12d3-a456-426614174000"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def _python_redact(text):
    for pattern in C.SECRET_PATTERNS:
        text = regex.sub(pattern, C.MASK, text, flags=regex.ASCII)
    return text


def test_redact_equals_brute_force_and_is_idempotent(spark):
    texts = _random_texts()
    once = run(spark, texts, X.redact)
    assert once == [_python_redact(t) for t in texts]
    assert run(spark, once, X.redact) == once


def test_normalize_equals_brute_force(spark):
    def slow(text):
        text = _python_redact(text)
        for pattern, by in C.TEMPLATE_PATTERNS:
            text = regex.sub(pattern.replace(r"\d", "[0-9]"), by, text)
        return text.strip("".join(map(chr, range(33))))

    texts = _random_texts()
    assert run(spark, texts, X.normalize_message) == [slow(t) for t in texts]


def test_normalize_order(spark):
    assert run(spark, [
        "order 123e4567-e89b-12d3-a456-426614174000 at 2024-01-02 03:04:05.678 from 10.0.0.1 hash 0123456789abcdef no 42 a1",
        "é12 stays, 12 goes",
    ], X.normalize_message) == ["order {uuid} at {ts} from {ip} hash {hex} no {n} a1", "é12 stays, {n} goes"]


def test_cut_text_is_redacted_again(spark):
    """A cut can leave ``token=…`` behind, which counts as a secret again."""
    text = "x" * 1194 + "token=,secret"
    cut = run(spark, [text], lambda c: X.truncate(X.redact(c)))[0]
    assert cut.endswith("token=…")
    assert run(spark, [cut], lambda c: X.normalize_message(c, F.lit(False)))[0].endswith("x***")


def test_truncate_and_stack_lines(spark):
    assert run(spark, ["a" * 1200, "a" * 1201], X.truncate) == ["a" * 1200, "a" * 1200 + "…"]
    lines = [f"l{i}" for i in range(20)]
    assert run(spark, ["\n".join(lines), "\n".join(lines[:12]), "\n".join(lines[:12]) + "\n\n\n", "a\r\nb"], X.limit_stack_lines) == [
        "\n".join(lines[:12]) + "\n…", "\n".join(lines[:12]), "\n".join(lines[:12]) + "\n\n\n", "a\r\nb"]


def test_top_frame(spark):
    assert run(spark, [
        "java.lang.X: boom\n\tat com.A.b(A.java:12)\n\tat c", "no frames", None, "  ", "at  \n at com.B.c(B.java:7) x ",
        "at first(F.java:1)",
    ], X.top_stack_frame) == ["com.A.b(A.java)", None, None, None, "com.B.c(B.java) x", "first(F.java)"]


def test_exception_class(spark):
    assert run(spark, ["java.lang.NullPointerException: x", "Caused by: a.b.MyError", "plain", None], X.exception_class) == [
        "NullPointerException", "MyError", None, None]


def test_cluster_exception_fallback(spark):
    df = spark.createDataFrame([
        ("NPE", "java.lang.X: y"), (" ", "java.lang.X: y\n at z"), (None, "oops without colon\nmore"), (None, ": odd"),
        (None, " \n"), (None, None)], "a string, s string")
    got = [r[0] for r in df.select(X.cluster_exception(F.col("a"), F.col("s"))).collect()]
    assert got == ["NPE", "java.lang.X", "oops without colon", ": odd", None, None]


def test_redact_map_and_cluster_key(spark):
    df = spark.createDataFrame([({"password": "p", "Access-Key": "k", "note": "a@b.co x", "key": "timeout"},)], "m map<string,string>")
    assert df.select(X.redact_map(F.col("m"))).first()[0] == {"password": "***", "Access-Key": "***", "note": "*** x", "key": "timeout"}
    assert df.select(X.cluster_key(F.lit("p"), F.lit("e"), F.lit(None).cast("string"), F.lit("t"))).first()[0] == "p|e|null|t"
    nothing = spark.createDataFrame([(None,)], "m map<string,string>")
    assert nothing.select(X.redact_map(F.col("m"))).first()[0] == {}


def test_trim_control_and_blank(spark):
    assert run(spark, ["\x01\t a b \n\x1f", "　x　"], X.trim_control) == ["a b", "　x　"]
    assert run(spark, ["　 \t", " ", "", None, "a"], X.not_blank) == [False, True, False, False, True]

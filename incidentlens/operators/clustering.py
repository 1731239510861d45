"""Log clustering with current and baseline counts, spikes and cluster ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions.text import (
    cluster_exception, cluster_key, limit_stack_lines, normalize_message, redact, redact_each, top_stack_frame, truncate,
)
from incidentlens.operators.joins import request_evidence, wanted_evidence
from incidentlens.operators.ranking import number_rows
from incidentlens.operators.sanitize import sanitize_logs
from incidentlens.session import RequestScope, broadcast_if_small, instant, interval, materialize, request_scope

PARTS = ["exception_class", "message_template", "top_stack_frame"]


def is_spike(current: Column, baseline: Column, has_baseline: Column,
             absolute: int = C.SPIKE_ABSOLUTE, ratio: float = C.SPIKE_RATIO) -> Column:
    return (current >= absolute) & (~has_baseline | (current >= baseline * F.lit(float(ratio))))


def cluster_parts(logs: DataFrame, *carried: str) -> DataFrame:
    """Raw log rows narrowed to what a cluster is made of, computed on the sanitized text."""
    same = [*carried, "project_id", "environment", "occurred_at", "arrival_seq", "level"]
    masked = logs.select(
        *same, redact(F.col("message")).alias("_message"),
        redact_each(F.col("stack_trace"), F.col("attributes")["exceptionClass"]).alias("_others"))
    message, stack, explicit = F.col("_message"), F.get("_others", F.lit(0)), F.get("_others", F.lit(1))
    # a cut may leave half of what was masked, so cut messages are masked again
    again = F.get(redact_each(truncate(message)), F.lit(0))
    cut = masked.select(
        *same, explicit.alias("_explicit"), limit_stack_lines(stack).alias("_stack"),
        F.when(F.length(message) > C.MAX_SAMPLE_CHARS, again).otherwise(message).alias("_message"),
    )
    return cut.select(
        *same,
        cluster_exception(F.col("_explicit"), F.col("_stack")).alias("exception_class"),
        normalize_message(F.col("_message"), already_redacted=F.lit(True)).alias("message_template"),
        top_stack_frame(F.col("_stack")).alias("top_stack_frame"),
    )


SHAPE = ["project_id", "environment", *PARTS, "level"]
RANGE = ["request_id", "from_ts", "to_ts"]


def cluster_counts(rows: DataFrame, current_seconds: float = C.CURRENT_WINDOW_SECONDS) -> DataFrame:
    """Group request log rows into clusters."""
    current = F.col("occurred_at") >= F.col("to_ts") - interval(current_seconds)
    # Only fixed-width state, so this hashes and combines inside the map tasks.
    fine = rows.groupBy(*RANGE, *SHAPE).agg(
        F.count_if(current).alias("_current"), F.count_if(~current).alias("_baseline"),
        F.min("occurred_at").alias("_first"), F.max("occurred_at").alias("_last"),
        F.min("arrival_seq").alias("_seq"),
    )
    return merge_counts(fine)


def shared_cluster_counts(requests: DataFrame, parts: DataFrame, scope: RequestScope,
                          current_seconds: float = C.CURRENT_WINDOW_SECONDS) -> DataFrame:
    """The same counts when many requests overlap, without repeating every event per request.

    Events are first counted per minute, once for all requests. A request takes whole minutes
    from these counts (:func:`range_counts`). Only the minutes its own bounds cut (range start,
    range end and start of the current window) are counted from their events.
    """
    starts = F.col("to_ts") - interval(current_seconds)
    opens, closes = F.col("_minute"), F.col("_minute") + interval(60)
    whole = (
        (opens >= F.col("from_ts")) & (closes <= F.col("to_ts")) & ((opens >= starts) | (closes <= starts)))
    bounds = F.array(*[_minute(c) for c in ("from_ts", "to_ts", "_starts")])
    cut = (
        requests.select("project_id", "environment", *RANGE).withColumn("_starts", starts)
        .withColumn("_minute", F.explode(F.array_distinct(bounds))).drop("_starts")
    )
    place = ["project_id", "environment", "_minute"]
    cut_minutes = cut.select(*place).distinct().withColumn("_cut", F.lit(True))
    dated = parts.withColumn("_minute", _minute("occurred_at")).join(F.broadcast(cut_minutes) if scope.small else cut_minutes, place, "left")
    # one pass over the events: by minute, and in cut minutes by instant
    fine = materialize(dated.groupBy("_minute", F.when(F.col("_cut"), F.col("occurred_at")).alias("_exact"), *SHAPE).agg(
        F.count("*").alias("_rows"), F.min("occurred_at").alias("_first"), F.max("occurred_at").alias("_last"), F.min("arrival_seq").alias("_seq")))
    minutes = materialize(fine.groupBy("_minute", *SHAPE).agg(
        F.sum("_rows").alias("_rows"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.min("_seq").alias("_seq")))
    taken = range_counts(requests, minutes, scope, current_seconds)
    edge = fine.where(F.col("_exact").isNotNull()).join(F.broadcast(cut) if scope.small else cut, place).where(
        F.col("_exact").between(F.col("from_ts"), F.col("to_ts")) & ~whole)
    at_current = F.col("_exact") >= starts
    edges = edge.groupBy(*RANGE, *SHAPE).agg(
        F.sum(F.when(at_current, F.col("_rows")).otherwise(0)).alias("_current"),
        F.sum(F.when(at_current, 0).otherwise(F.col("_rows"))).alias("_baseline"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.min("_seq").alias("_seq"),
    )
    return merge_counts(taken.unionByName(edges))


def minute_bounds(requests: DataFrame, current_seconds: float) -> DataFrame:
    """Four bounds in whole minutes for every request: start of its range, end of its baseline, start of its current window, end of its range."""
    given = requests.select("project_id", "environment", *RANGE, (F.col("to_ts") - interval(current_seconds)).alias("_starts"))

    def down(name: str) -> Column:
        return _minute(name)

    def up(name: str) -> Column:
        return F.when(F.col(name) == down(name), F.col(name)).otherwise(down(name) + interval(60))

    low = up("from_ts")
    high = F.greatest(low, down("to_ts"))
    cuts = [F.least(F.greatest(cut, low), high) for cut in (down("_starts"), up("_starts"))]
    return given.select("project_id", "environment", *RANGE, F.posexplode(F.array(low, *cuts, high)).alias("_bound", "_at"))


def range_counts(requests: DataFrame, minutes: DataFrame, scope: RequestScope, current_seconds: float) -> DataFrame:
    """Counts and extremes of every request and cluster over whole minutes, by look-ups.

    A cluster's minutes and the requests' bounds stand in one line in time order; the running count at a bound is what came
    before it, so a count is the difference of two, whatever the length of the range. The first arrival in a range comes from
    a table of minima over 1, 2, 4, ... minutes, of which two cover any range.
    """
    bounds = minute_bounds(requests, current_seconds)
    asked = minutes.select(*SHAPE).distinct().join(F.broadcast(bounds) if scope.small else bounds, ["project_id", "environment"])
    line = minutes.select(*SHAPE, F.col("_minute").alias("_at"), F.lit(1).alias("_is_minute"), "_rows", "_last").unionByName(
        asked.withColumns({"_is_minute": F.lit(0), "_rows": F.lit(0).cast("long")}), allowMissingColumns=True)
    along = Window.partitionBy(*SHAPE).orderBy("_at", "_is_minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_bounds = line.withColumns({
        "_before": F.sum("_rows").over(along), "_place": F.sum("_is_minute").over(along),
        "_seen": F.last("_last", ignorenulls=True).over(along),
    }).where("_is_minute = 0")

    def at(bound: int, name: str) -> Column:
        return F.max(F.when(F.col("_bound") == bound, F.col(name)))

    counts = at_bounds.groupBy(*RANGE, *SHAPE).agg(
        (at(3, "_before") - at(2, "_before")).alias("_current"), (at(1, "_before") - at(0, "_before")).alias("_baseline"),
        at(0, "_place").alias("_low"), at(3, "_place").alias("_high"), at(3, "_seen").alias("_last"),
    ).where("_high > _low")
    asks = counts.withColumn("_level", F.length(F.bin(F.col("_high") - F.col("_low"))) - 1).withColumn(
        "_place", F.explode(F.array(F.col("_low") + 1, F.col("_high") - F.expr("shiftleft(1L, _level)") + 1)))
    table = first_arrivals(minutes)
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}")) for c in SHAPE], F.col("a._place") == F.col("t._place"))
    found = asks.alias("a").join(table.alias("t"), same)
    return found.groupBy(*RANGE, *[f"a.{c}" for c in SHAPE]).agg(
        F.max("_current").alias("_current"), F.max("_baseline").alias("_baseline"), F.min("_first").alias("_first"),
        F.max("_last").alias("_last"), F.min(F.element_at("_least", F.col("_level") + 1)).alias("_seq"))


def first_arrivals(minutes: DataFrame) -> DataFrame:
    """Every minute of a cluster with its place and the smallest arrival number of it and the following 1, 2, 4, ... minutes that have rows."""
    longest = minutes.groupBy(*SHAPE).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    in_time = Window.partitionBy(*SHAPE).orderBy("_minute")
    table = minutes.select(*SHAPE, "_minute", "_first", F.row_number().over(in_time).alias("_place"), F.col("_seq").alias("_least0"))
    for level in range(1, longest.bit_length()):
        half = f"_least{level - 1}"
        table = table.withColumn(f"_least{level}", F.least(half, F.lead(half, 1 << (level - 1)).over(in_time)))
    return table.select(*SHAPE, "_place", "_first", F.array(*[f"_least{n}" for n in range(longest.bit_length())]).alias("_least"))


def _minute(ts: str) -> Column:
    return F.expr(f"{ts} - make_dt_interval(0, 0, 0, extract(SECOND FROM {ts}))")


def merge_counts(fine: DataFrame) -> DataFrame:
    """Counts per parts and level merged by key text; parts and level come from the first event."""
    keyed = fine.withColumn(
        "cluster_key", cluster_key(F.col("project_id"), F.col("environment"), *[F.col(p) for p in PARTS])
    )
    return keyed.groupBy("request_id", "cluster_key", "project_id", "environment", "from_ts", "to_ts").agg(
        F.min_by(F.struct(*PARTS, "level"), "_seq").alias("_head"),
        F.sum("_current").alias("current_count"), F.sum("_baseline").alias("baseline_count"),
        F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"),
        F.min("_seq").alias("first_seq"),
    )


def log_clusters(requests: DataFrame, logs: DataFrame, *, current_seconds: float = C.CURRENT_WINDOW_SECONDS,
                 absolute: int = C.SPIKE_ABSOLUTE, ratio: float = C.SPIKE_RATIO,
                 capped: DataFrame | None = None, scope: RequestScope | None = None) -> DataFrame:
    """Clusters of every request with their ``log-N`` ids in first-encounter order.

    Log text is sanitized and normalized once per event, before requests that overlap multiply
    it. ``capped`` replaces the join with rows already limited per request (parity with a source
    that stops at its row limit); otherwise events are counted per minute once for all requests.
    """
    if capped is not None:
        counted = cluster_counts(cluster_parts(_in_order(capped), *RANGE), current_seconds)
    else:
        scope = scope or request_scope(requests)
        parts = cluster_parts(wanted_evidence(requests, _in_order(logs), scope=scope))
        counted = shared_cluster_counts(requests, parts, scope, current_seconds)
    has_baseline = F.col("to_ts") - F.col("from_ts") > interval(current_seconds)
    flagged = counted.select(
        "request_id", "project_id", "environment", "cluster_key", "_head.*",
        (F.col("current_count") + F.col("baseline_count")).alias("count"),
        "current_count", "baseline_count", "first_seen", "last_seen", "first_seq",
        is_spike(F.col("current_count"), F.col("baseline_count"), has_baseline, absolute, ratio).alias("spike"),
    )
    numbered = number_rows(flagged, ["request_id"], [F.col("first_seq")], "cluster_seq")
    return numbered.withColumn("evidence_id", F.concat(F.lit("log-"), F.col("cluster_seq").cast("string")))


def _in_order(logs: DataFrame) -> DataFrame:
    """Rows without an arrival number cannot be put in first-encounter order: they are an error."""
    missing = F.raise_error(F.lit("log rows need an arrival_seq; see log_view_events and read_log_files")).cast("long")
    return logs.withColumn("arrival_seq", F.coalesce(F.col("arrival_seq").cast("long"), missing))


def attach_samples(clusters: DataFrame, logs: DataFrame) -> DataFrame:
    """Add the sanitized first event of every cluster, read back by its arrival number.

    Logs that were limited per request carry their ``request_id`` and are looked up with it. The
    clusters' outer times, from one small aggregate, bound the scan of the logs.
    """
    outer = clusters.agg(
        F.min("first_seen").cast("string").alias("low"), F.max("last_seen").cast("string").alias("high")).first()
    if outer["low"] is not None:
        logs = logs.where(F.col("occurred_at").between(instant(outer["low"]), instant(outer["high"])))
    key = ["project_id", "environment", "arrival_seq", *(["request_id"] if "request_id" in logs.columns else [])]
    firsts = clusters.select(
        "request_id", "project_id", "environment", "cluster_key", F.col("first_seq").alias("arrival_seq")
    )
    rows = logs.join(broadcast_if_small(firsts.select(key).distinct()), key, "left_semi")
    samples = sanitize_logs(rows).select(
        *key, F.struct("occurred_at", "level", "logger", "trace_id", "message", "stack_trace", "attributes").alias("sample"),
    )
    found = firsts.join(samples, key).select("request_id", "cluster_key", "sample")
    return clusters.join(found, ["request_id", "cluster_key"], "left")

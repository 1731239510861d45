"""Text log files: multi-line events out of lines, for files of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions import logline as L
from incidentlens.functions.text import exception_attributes
from incidentlens.operators.ranking import number_rows, top_n
from incidentlens.schemas import LOG_EVENTS, conform
from incidentlens.session import materialize
from incidentlens.sources.logs import named


def bound_stack(lines: Column) -> Column:
    """Continuation lines joined and cut: at most 100 lines, and none that starts at or beyond
    16 Ki characters. Leading empty lines leave no trace; a cut is marked with an ellipsis.

    Struct of ``stack_trace`` (null when empty) and ``truncated``.
    """
    text = F.regexp_replace(F.array_join(F.slice(lines, 1, C.MAX_EVENT_LINES), "\n"), r"\A\n+", "")
    stop = F.locate("\n", text, C.MAX_EVENT_CHARS + 1)
    kept = F.when(stop > 0, F.substring(text, F.lit(1), stop - 1)).otherwise(text)
    cut = (F.size(lines) > C.MAX_EVENT_LINES) | (stop > 0)
    marked = F.when(cut, F.concat(kept, F.lit("\n" + C.ELLIPSIS))).otherwise(kept)
    return F.struct(F.when(kept != "", marked).alias("stack_trace"), F.coalesce(cut, F.lit(False)).alias("truncated"))


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The configured paths that match a file; a missing one is skipped, not an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = []
    for path in paths:
        where = hadoop.Path(path)
        matches = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        if matches is not None and len(matches) > 0:
            found.append(path)
    return found


def read_lines(spark: SparkSession, paths: list[str], charset: str = "UTF-8") -> DataFrame:
    """Lines with their place: file, start of the block read by one task, order inside it."""
    raw = spark.read.text(paths)
    text = F.col("value") if charset.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), text.alias("line"),
    )


def assemble_events(lines: DataFrame, pattern: str = C.DEFAULT_LINE_PATTERN, levels: list[str] | None = C.KEPT_LEVELS,
                    max_chars_per_file: int | None = None) -> DataFrame:
    """One row per kept event: its file, ordinal, head line and bounded continuation text.

    Lines are numbered in two levels, so that one huge file is spread over its blocks: a running
    count inside each block plus the heads in earlier blocks of the file. An event that crosses a
    block boundary gets the same ordinal on both sides. Lines of events whose level is not kept
    are dropped before they are shuffled again, and no more than 102 lines of an event ever meet.
    """
    L.check_pattern(pattern)
    # the size bound counts a line as it stands in the file
    clean = lines.withColumn("chars", F.length("line") + 1).withColumn("line", L.strip_ansi(F.col("line")))
    head = L.is_head(F.col("line"), pattern)
    flagged = clean.withColumn("head", head)
    wanted = F.lit(True) if levels is None else F.coalesce(
        L.head_field(F.col("line"), "level", pattern).isin(levels), F.lit(False))
    flagged = flagged.withColumn("kept", F.when(F.col("head"), wanted))
    blocks = flagged.groupBy("file", "block").agg(
        F.count_if("head").alias("heads"),
        F.max(F.when(F.col("head"), F.col("line_no") * 2 + F.col("kept").cast("long"))).alias("last"),
        F.sum("chars").alias("chars"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "file", "block", F.coalesce(F.sum("heads").over(earlier), F.lit(0)).alias("heads_before"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"),
        (F.last("last", ignorenulls=True).over(earlier) % 2 == 1).alias("kept_before"),
    )
    within = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    running = flagged.withColumns({
        "heads_here": F.sum(F.col("head").cast("long")).over(within),
        "kept_here": F.last("kept", ignorenulls=True).over(within),
        "chars_here": F.sum("chars").over(within),
    })
    placed = running.join(offsets, ["file", "block"]).withColumns({
        "ordinal": F.col("heads_here") + F.col("heads_before"),
        "kept": F.coalesce("kept_here", "kept_before"),
    }).where((F.col("ordinal") > 0) & F.col("kept"))
    if max_chars_per_file is not None:
        placed = placed.where(F.col("chars_here") + F.col("chars_before") <= max_chars_per_file)
    order = [F.col("block"), F.col("line_no")]
    few = top_n(placed.select("file", "ordinal", "block", "line_no", "line"), ["file", "ordinal"], order,
                C.MAX_EVENT_LINES + 2, "place")
    events = few.groupBy("file", "ordinal").agg(
        F.array_sort(F.collect_list(F.struct("place", "line"))).alias("parts"))
    texts = F.transform("parts", lambda p: p["line"])
    return events.select(
        "file", "ordinal", F.get(texts, F.lit(0)).alias("head"),
        bound_stack(F.slice(texts, 2, C.MAX_EVENT_LINES + 1)).alias("body"),
    ).select("file", "ordinal", "head", "body.*")


def read_log_files(spark: SparkSession, paths: list[str], *, project_id: str | Column, environment: str | Column,
                   pattern: str | None = None, charset: str = "UTF-8", zone: str = "UTC",
                   max_chars_per_file: int | None = None) -> tuple[DataFrame | None, str]:
    """Log rows (``LOG_EVENTS``) of text files and the state of the source.

    Files of one project have its names given; where many projects keep theirs in folders, the names are expressions over
    the column ``file``. Missing files are skipped; when none of the configured ones exists there are no rows and the
    state is ``error``. Heads with an unreadable time are dropped. Rows arrive by rising time; of
    equal times by file and place in it.
    """
    found = existing_paths(spark, paths)
    if paths and not found:
        return None, "error"
    layout = pattern if pattern and pattern.strip() else C.DEFAULT_LINE_PATTERN
    events = assemble_events(read_lines(spark, found, charset), layout, max_chars_per_file=max_chars_per_file)
    rows = parse_events(events, layout, zone).select(
        named(project_id).alias("project_id"), named(environment).alias("environment"), "*")
    # a range shuffle reads its input twice, once for the bounds: events are assembled and parsed before it
    arrived = number_rows(materialize(rows), [], [F.col("occurred_at"), F.col("file"), F.col("ordinal")], "arrival_seq")
    return conform(arrived, LOG_EVENTS), "ok"


def parse_events(events: DataFrame, pattern: str = C.DEFAULT_LINE_PATTERN, zone: str = "UTC") -> DataFrame:
    """Assembled events as log rows; rows whose time cannot be read are dropped."""
    head = F.col("head")
    return events.select(
        "file", "ordinal",
        L.parse_timestamp(L.head_field(head, "ts", pattern), zone).alias("occurred_at"),
        *[L.head_field(head, name, pattern).alias(alias)
          for name, alias in (("level", "level"), ("logger", "logger"), ("msg", "message"))],
        F.lit(None).cast("string").alias("trace_id"), "stack_trace",
        exception_attributes(F.col("stack_trace")).alias("attributes"),
    ).where(F.col("occurred_at").isNotNull())


def split_document_events(documents: DataFrame, head_regex: str = "[A-Z]") -> DataFrame:
    """Multi-line events inside a text column: a line that starts with ``head_regex`` opens one.

    The text is split in place, without any shuffle; lines before the first head are ignored.
    """
    chunks = F.split("text", rf"\n(?={head_regex})")
    is_event = F.col("chunk").rlike(rf"\A{head_regex}")
    exploded = documents.select("doc_id", F.posexplode(chunks).alias("pos", "chunk"),
                                F.col("text").rlike(rf"\A{head_regex}").alias("_starts"))
    lines = F.split("chunk", "\n")
    return exploded.where(is_event).select(
        "doc_id", (F.col("pos") + F.when(F.col("_starts"), 1).otherwise(0)).cast("long").alias("event_no"),
        F.get(lines, F.lit(0)).alias("head"), F.size(lines).cast("long").alias("n_lines"),
        F.slice(lines, 2, F.greatest(F.size(lines), F.lit(2))).alias("continuation"),
    )

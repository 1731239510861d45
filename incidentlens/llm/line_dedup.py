"""Substring dedup by line or paragraph hashing.

A text's units are its lines, or its paragraphs (what stands between empty lines). A unit is normalised (A-Z lower-cased, white space
made one space, trimmed) and hashed; digests are counted over all documents, and the occurrence in the smallest id (then
row, then place) is kept. All later occurrences, in other documents or the same one, are removed, however short they are, together with
the line end and the empty lines behind them. Offsets of removed units are code points of the original text.

A line that a third of all documents share costs each task one row: minima and counts combine before the shuffle, and its rows
take the result by broadcast (at most a thousand lines can be that frequent).

Defined results: a null text is empty and stays empty; units without words (ASCII white space only) are no copies of each
other; null ids come after all others; of rows that are equal in id and text one comes first and the others lose
everything they repeat; an empty table gives an empty result; a very long text is worked on by itself. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import in_batches, join_hot, materialize, read_table

#: What stands between two units.
BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[\x20\x09\x0B-\x0D]*\n)+")}


def unit_spans(text: str, unit: str) -> list[tuple[int, int]]:
    """Start and end of every unit."""
    out, at = [], 0
    for found in BREAKS[unit].finditer(text):
        out.append((at, found.start()))
        at = found.end()
    return [*out, (at, len(text))]


def _units(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    """One row for each unit: row, id, text hash, place, start, end (code points), words, digest in two numbers."""
    for batch in batches:
        of, place, start, end, words, digests = [], [], [], [], [], []
        for number, value in enumerate(batch.column("_text")):
            text = value.as_py() or ""
            for n, (at, to) in enumerate(unit_spans(text, unit)):
                parts = text[at:to].encode("utf-8", "surrogatepass").lower().split()
                of.append(number)
                place.append(n)
                start.append(at)
                end.append(to)
                words.append(len(parts))
                digests.append(hashlib.blake2b(b" ".join(parts), digest_size=16).digest())
        halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        index = pa.array(of, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(index) for c in ("_row", "_id", "_hash")]
            + [pa.array(x, pa.int32()) for x in (place, start, end, words)] + [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
            names=["_row", "_id", "_hash", "place", "start", "end", "words", "d1", "d2"],
        )


def without_units(text: str, gone: set[int], unit: str) -> str:
    """The text without some of its units and the empty ones behind them; each unit left keeps the break before it."""
    out, end, dropped = [], 0, False
    for n, (at, to) in enumerate(unit_spans(text, unit)):
        if n in gone:
            dropped = True
        elif text[at:to].encode("utf-8", "surrogatepass").split():
            dropped = False
        if not dropped:
            out.append(text[end if out else at: to])
        end = to
    return "".join(out)


def _cut(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for value, gone in zip(batch.column("_text"), batch.column("gone").to_pylist()):
            text = value.as_py() or ""
            texts.append(without_units(text, set(gone), unit) if gone else text)
        keep = [batch.column(n) for n in ("_id", "n_chars_before", "n_units", "spans", "kept_doc_ids")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())],
            names=["_id", "n_chars_before", "n_units", "spans", "kept_doc_ids", "n_chars", "text"])


def repeated_units(units: DataFrame) -> DataFrame:
    """The units to remove, each with the id of the document that keeps its first occurrence."""
    rank = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("place").alias("place"))
    told = units.where("words > 0")
    first = materialize(told.groupBy("d1", "d2").agg(F.count("*").alias("_copies"), F.min(rank).alias("_first")).where("_copies > 1"))
    return join_hot(told, first, ["d1", "d2"], "_copies", units.count()).where(
        (F.col("_row") != F.col("_first.row")) | (F.col("place") != F.col("_first.place"))
    ).select("_row", "place", "start", "end", F.col("_first.id").alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line") -> DataFrame:
    """Every row: key, ``n_chars`` of the remaining ``text``, ``n_chars_before``, ``n_units``, removed ``spans`` (start, end) and
    ``kept_doc_ids`` (one for each span)."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"))
    units = materialize(in_batches(
        given.withColumn("_row", F.monotonically_increasing_id()), lambda batches: _units(batches, unit),
        f"_row long, _id {kind}, _hash long, place int, start int, end int, words int, d1 long, d2 long"))
    gone = repeated_units(units).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("place", "start", "end", "kept"))).alias("_gone"))
    rows = units.groupBy("_row", "_id", "_hash").agg(F.count("*").alias("n_units"))
    same = Window.partitionBy("_id", "_hash")
    named = rows.join(gone, "_row", "left").select(
        F.col("_id").alias("_key"), F.col("_hash").alias("_digest"), "n_units", "_gone", F.row_number().over(same.orderBy("_row")).alias("_number"))
    # rows equal in id and text are interchangeable, so their numbers pair them with the decisions
    numbered = given.withColumn("_copy", F.row_number().over(same.orderBy("_hash")))
    joined = numbered.join(
        named, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_digest")) & (F.col("_copy") == F.col("_number")))
    none = F.array().cast(f"array<struct<place:int,start:int,end:int,kept:{kind}>>")
    found = joined.withColumn("_gone", F.coalesce("_gone", none)).select(
        "_id", F.length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_chars_before"), "n_units", "_text",
        F.transform("_gone", lambda g: F.struct(g["start"].cast("long").alias("start"), g["end"].cast("long").alias("end"))).alias("spans"),
        F.transform("_gone", lambda g: g["kept"]).alias("kept_doc_ids"), F.transform("_gone", lambda g: g["place"]).alias("gone"),
    )
    return in_batches(
        found, lambda batches: _cut(batches, unit),
        f"_id {kind}, n_chars_before long, n_units long, spans array<struct<start:bigint,end:bigint>>, kept_doc_ids array<{kind}>, "
        f"n_chars long, text string",
    ).withColumnRenamed("_id", key)


#: The same in SQL; the normalised line stands for its digest.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
units AS (
  SELECT doc_id, place, line, n, n <> '' AS told, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY place))::BIGINT - length(line) - 1 AS start
  FROM (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g')) AS n FROM lines)),
ranked AS (SELECT *, told AND row_number() OVER (PARTITION BY n ORDER BY doc_id, place) > 1 AS later FROM units),
cut AS (
  SELECT *, later OR (NOT told AND coalesce(last_value(CASE WHEN told THEN later END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place), false)) AS gone
  FROM ranked)
SELECT doc_id, length(text)::BIGINT AS n_chars, n_chars_before, n_units, n_removed, removed, text FROM (
  SELECT doc_id, (sum(length(line) + 1) - 1)::BIGINT AS n_chars_before, count(*)::BIGINT AS n_units, count(*) FILTER (later)::BIGINT AS n_removed,
    coalesce(string_agg(start || ':' || (start + length(line)), ',' ORDER BY place) FILTER (later), '') AS removed,
    coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM cut GROUP BY doc_id)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "n_chars_before", "n_units", F.size("spans").cast("long").alias("n_removed"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("removed"), "text",
    )

"""MinHash near-duplicates: circulant MinHash, banding, and exact Jaccard verification.

One permutation of the 32-bit numbers scrambles a text's shingles. A second one, shifted circularly by 1, 2, ...,
gives every coordinate of the signature: coordinate k is the smallest ``second(first(x) + k)`` over the set. Both are
bijective integer mixers. Signatures are cut into bands; texts that agree in a band share a bucket.

* Texts of one shingle set are one class from the start, so copies never meet.
* In each bucket every class is compared with the bucket's first class only (a star), on the full sets.
* What the stars have linked needs no more pairs. A bucket with classes outside the first one's component gets a second star, around
  its most central class: the one with the fewest shingles that no other class of the open buckets has (edits make such).
* Classes still outside are compared with the rest of their bucket, each pair in the smallest of its common buckets, unless a bound rules
  the link out. Shingles that no other class has can be in no intersection; and two classes share at most what both
  share with the central class, and what both have beside it.

So no link inside any bucket is lost, and a bucket full of near copies costs one comparison for each. With 32 bands of
four coordinates two sets of similarity 0.75 share no bucket with probability 0.000005.

Defined results: a null text is empty; a text without words has an empty set and is its own component; a null id
belongs to its group, is never kept, and the group takes its smallest id from the others (null if there is none); repeated rows
are all returned with the same result; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm.common import in_batches, join_hot, materialize, read_table
from incidentlens.llm.graph import components
from incidentlens.llm.shingles import mix64, set_digest, shingle_sets

BANDS, ROWS = 32, 4
#: Links have 100 * intersection >= 75 * union.
SIMILARITY_PERCENT = 75


def _mix32(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signature(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row for each set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    scrambled = _mix32(np.concatenate(sets).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((coordinates, len(sets)), dtype=np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_mix32(scrambled + np.uint32(k + 1), 0x85EBCA6B, 0xC2B2AE35), starts)
    return out.T


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band: equal where all coordinates of the band are."""
    keys = np.empty((len(signatures), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(signatures), band + 1, dtype=np.uint64)
        for row in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, band * rows + row])
        keys[:, band] = key
    return keys.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, offsets, keys = [], [], [0], []
        for sets in shingle_sets(batch.column("_text").to_pylist()):
            held = [s for s in sets if len(s)]
            if held:
                keys.append(band_keys(signature(held, bands * rows), bands, rows).ravel())
            for s in sets:
                sizes.append(len(s))
                digests.append(set_digest(s))
                offsets.append(offsets[-1] + (bands if len(s) else 0))
        flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
            names=["_id", "_hash", "n", "digest", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for part in shingle_sets(batch.column("_text").to_pylist()) for s in part]
        offsets = np.cumsum([0] + [len(s) for s in sets])
        flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["node", "members"])


def _id_type(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The exact intersection and union size of every pair (columns ``a``, ``b``)."""
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("_one"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("_two"))
    counted = pairs.join(one, "a").join(two, "b").select(
        "a", "b", F.size("_one").alias("_na"), F.size("_two").alias("_nb"), F.size(F.array_intersect("_one", "_two")).alias("common"))
    return counted.select("a", "b", "common", (F.col("_na") + F.col("_nb") - F.col("common")).alias("together"))


def is_link(percent: int) -> Column:
    return F.col("common") * 100 >= F.col("together") * percent


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, percent: int = SIMILARITY_PERCENT,
) -> DataFrame:
    """Every row's key, ``_hash`` of its text, ``n_shingles`` and ``component_id`` (smallest key it can reach)."""
    given = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"))
    signed = materialize(in_batches(
        given.select("_id", "_hash", "_text"), lambda batches: _sign(batches, bands, rows),
        f"_id {_id_type(docs, key)}, _hash long, n long, digest string, bands array<long>",
    ).withColumn("_row", F.monotonically_increasing_id()))
    classes = materialize(signed.where("n > 0").groupBy("digest").agg(
        F.min("_row").alias("node"), F.min("_id").alias("_first"), F.count("*").alias("_rows")))
    first = signed.join(classes.select(F.col("node").alias("_row")), "_row").withColumnRenamed("_row", "node")
    spread = first.select("node", "n", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("_classes"), F.min("node").alias("lead")).where("_classes > 1").drop("_classes")
    members = materialize(spread.join(shared, "band"))

    wanted = members.select("node").distinct()
    source = materialize(first.join(wanted, "node").select("node", F.col("_id").alias("_key"), F.col("_hash").alias("_digest")))
    texts = given.join(source, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_digest"))).select("node", "_text")
    sets = materialize(in_batches(texts, _sets, "node long, members array<long>").dropDuplicates(["node"]))

    star_pairs = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(verified(star_pairs, sets))
    links = stars.where(is_link(percent)).select("a", "b")
    label = components(links)

    second = central_links(members, label, sets, percent)
    if second is not None:
        label = components(links.union(second))

    named = classes.join(label, "node", "left").select("digest", "_first", "_rows", F.coalesce("component", "node").alias("_group"))
    named = materialize(named)
    smallest = materialize(named.groupBy("_group").agg(F.min("_first").alias("component_id"), F.count("*").alias("_classes")))
    of_class = materialize(join_hot(named, smallest, ["_group"], "_classes", named.count()).select("digest", "_rows", "component_id"))
    told = signed.where("n > 0").select("_id", "_hash", "n", "digest")
    empty = signed.where("n = 0").select("_id", "_hash", "n", F.col("_id").alias("component_id"))
    found = join_hot(told, of_class, ["digest"], "_rows", signed.count()).select("_id", "_hash", "n", "component_id").unionByName(empty)
    return found.select(F.col("_id").alias(key), "_hash", F.col("n").alias("n_shingles"), "component_id")


def central_links(members: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between the components that the first stars have left apart in some bucket; None if they left nothing."""
    of_lead = label.select(F.col("node").alias("lead"), F.col("component").alias("_of_lead"))
    placed = (
        members.join(label, "node", "left").join(of_lead, "lead", "left")
        .select("band", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("_of_lead", "lead").alias("_of_lead"))
    )
    placed = materialize(placed)
    apart = placed.where("component <> _of_lead").select("band").distinct()
    still = materialize(placed.join(apart, "band").drop("_of_lead"))
    if still.isEmpty():
        return None
    shingle = still.select("node").distinct().join(sets, "node").select("node", F.explode("members").alias("shingle"))
    alone = (
        shingle.groupBy("shingle").agg(F.count("*").alias("_holders"), F.min("node").alias("node")).where("_holders = 1")
        .groupBy("node").agg(F.count("*").alias("_alone"))
    )
    # what a class shares with any other one is at most ``common``
    still = materialize(
        still.join(alone, "node", "left").withColumn("common", F.col("n") - F.coalesce("_alone", F.lit(0))).drop("_alone")
        .where(F.col("common") * 100 >= F.col("n") * percent)
    )
    centre = still.groupBy("band").agg(F.min_by("node", F.struct(F.col("n") - F.col("common"), "node")).alias("centre"))
    around = materialize(still.join(centre, "band"))
    pairs = around.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(verified(pairs, sets))
    links = stars.where(is_link(percent)).select("a", "b")
    # labels of labels: what the new links join
    of = around.select("node", "component").distinct()
    joined = links.join(of.withColumnsRenamed({"node": "a", "component": "_one"}), "a").join(
        of.withColumnsRenamed({"node": "b", "component": "_two"}), "b").where("_one <> _two").select(F.col("_one").alias("a"), F.col("_two").alias("b"))
    merged = components(joined.distinct()).select(F.col("node").alias("component"), F.col("component").alias("_merged"))
    core = stars.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.col("common").alias("core"))
    known = (
        around.join(merged, "component", "left").join(core, ["centre", "node"], "left")
        .withColumn("component", F.coalesce("_merged", "component")).drop("_merged")
        # the part of a class that another one can share: inside its centre, and beside it
        .withColumn("core", F.when(F.col("node") == F.col("centre"), F.col("common")).otherwise(F.coalesce("core", "common")))
        .withColumn("beside", F.col("common") - F.least("core", "common"))
    )
    known = materialize(known)
    centres = known.where("node = centre").select("band", F.col("component").alias("_main"))
    known = known.join(centres, "band").withColumn("outside", F.col("component") != F.col("_main"))
    known = materialize(known.join(known.groupBy("node").agg(F.array_sort(F.collect_list("band")).alias("bands")), "node"))
    x, y = known.where("outside").alias("x"), known.alias("y")
    shared = F.least(F.least("x.common", "y.common"), F.least("x.core", "y.core") + F.least("x.beside", "y.beside"))
    rest = x.join(y, "band").where(
        (F.col("x.component") != F.col("y.component"))
        & (~F.col("y.outside") | (F.col("x.node") < F.col("y.node")))
        & (shared * 100 >= (F.col("x.n") + F.col("y.n") - shared) * percent)
        & (F.col("band") == F.array_min(F.array_intersect("x.bands", "y.bands")))
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    found = materialize(verified(rest, sets)).where(is_link(percent)).select("a", "b")
    return links.union(found)


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns.

    A group keeps the rows of its smallest id; a group whose ids are all null keeps its rows.
    """
    found = near_duplicates(docs, key, text).where(F.col(key).eqNullSafe(F.col("component_id")))
    kept = found.select(F.col(key).alias("_key"), F.col("_hash").alias("_digest")).distinct()
    same = F.col(f"d.{key}").eqNullSafe(F.col("k._key")) & (
        F.xxhash64(F.coalesce(F.col(f"d.{text}"), F.lit(""))) == F.col("k._digest"))
    return docs.alias("d").join(kept.alias("k"), same, "left_semi")


#: Exact components by a self-join of all shingles; for small tables only, so the query gives it as its SQL.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
    AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 75
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 75),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a WHERE r.c < l.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))

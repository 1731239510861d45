"""Prefix trie of conversations from padded turn-id matrices.

Every conversation is a row of turn ids (MD5 of role and text, 16 bytes each). Spark deals the rows by range of (ids, conversation)
and sorts them, so that a task holds a contiguous part of the sorted list, the copies of one conversation over several tasks if there
are many. A task cuts its part into blocks of at most ``BLOCK_CELLS`` matrix cells. A block's padded matrix is put in order by
``numpy.lexsort``; where a row differs from the one before it, accumulated by OR over the columns, a node starts; ``reduceat`` then
sums up every depth: members, children, leaves, saved words.

A node that holds a block's first or last row may go on in the next block. Such nodes leave the block as partial rows and are
summed by their path's digest. Every sum counts what starts at a row, so rows need their predecessor only: a block has it from the
block before, and the first block of a task is set right by a small table of the tasks' first and last rows. Conversation
ids that end in a node spanning blocks travel as joined chunks and are hashed in order as a stream, without holding them.

Defined results: a null role or text is empty; turns are in order of ``turn`` (null first), ties by role, then by id; rows
without a conversation id belong to no conversation; repeated rows are further turns; an empty table has no nodes, not even the
root; ``%`` keeps the sign of a negative id. A conversation's ids and word counts (20 bytes a turn, not its texts) are
one row, which Spark bounds at 2 GB. Only the four columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize, read_table

BLOCK_CELLS = 1 << 18
CHUNK_IDS = 1024
ID_BYTES = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of one run of ``FAMILY`` ids share the first turns of the run's first one, up to ``SHARED - 1`` of them.
FAMILY, SHARED = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()

CLOSED, PARTIAL, ENDS, FIRST, LAST = range(5)
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_SCHEMA = (
    "kind int, key binary, parent_key binary, task int, block long, chunk int, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, seq binary, words array<int>"
)
_ARROW = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("task", pa.int32()), ("block", pa.int64()), ("chunk", pa.int32()),
    ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("seq", pa.binary()), ("words", pa.list_(pa.int32())),
])


# --- conversations as rows of turn ids ----------------------------------------------------------

def turn_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``seq`` (16 bytes for each turn in order) and ``words`` of the turns.

    Rows are dealt by the run of ids they belong to, which the rebuilt conversations need; the texts stay behind.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    turns = conversations.where(F.col(conv).isNotNull()).select(
        (F.col(conv) - F.col(conv) % FAMILY).cast("long").alias("family"), F.col(conv).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), by.alias("role"),
            F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary")).alias("id"),
            F.regexp_count(said, F.lit(WORD)).cast("int").alias("words"),
        ).alias("t"),
    )
    whole = turns.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        "family", "conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["id"]), "")).alias("seq"),
        F.transform("t", lambda t: t["words"]).alias("words"))


def rebuild(rows: DataFrame) -> DataFrame:
    """Every conversation with its first ``crc32(id) % SHARED`` turns replaced by those of the first one of its run."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    most = SHARED - 1
    head = F.when(F.col("conv_id") == F.col("family"), F.struct(
        F.substring("seq", 1, most * ID_BYTES).alias("seq"), F.slice("words", 1, most).alias("words")))
    lent = rows.withColumns({"h": taken, "head": F.first(head, ignorenulls=True).over(Window.partitionBy("family"))})
    return lent.select(
        "conv_id",
        F.concat(
            F.coalesce(F.expr(f"substring(head.seq, 1, h * {ID_BYTES})"), F.lit(b"")), F.expr(f"substring(seq, h * {ID_BYTES} + 1)")).alias("seq"),
        F.concat(F.coalesce(F.slice("head.words", F.lit(1), F.col("h")), F.array().cast("array<int>")),
                 F.slice("words", F.col("h") + 1, F.greatest(F.size("words"), F.lit(1)))).alias("words"),
    )


# --- blocks -------------------------------------------------------------------------------------

def path_keys(seq: bytes) -> list[bytes]:
    """The digest of every prefix, from the empty one on."""
    running, keys = hashlib.blake2b(digest_size=16), []
    keys.append(running.digest())
    for at in range(0, len(seq), ID_BYTES):
        running.update(seq[at: at + ID_BYTES])
        keys.append(running.digest())
    return keys


def common_turns(a: bytes, b: bytes) -> int:
    shared = 0
    while shared * ID_BYTES < min(len(a), len(b)) and a[shared * ID_BYTES: (shared + 1) * ID_BYTES] == b[shared * ID_BYTES: (shared + 1) * ID_BYTES]:
        shared += 1
    return shared


def pad(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of different sizes as one matrix, filled up with zeros."""
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width, *flat.shape[1:]), dtype=flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Block:
    """The sorted rows of one block and what they have in common with the row before them."""

    def __init__(self, conv: np.ndarray, sizes: np.ndarray, ids: np.ndarray, words: np.ndarray, before: bytes | None):
        matrix = pad(ids, sizes)
        columns = [matrix[:, w, half] for w in reversed(range(matrix.shape[1])) for half in (1, 0)]
        order = np.lexsort([conv, *columns])
        self.conv, self.sizes, matrix = conv[order], sizes[order], matrix[order]
        self.words = np.zeros((len(conv), matrix.shape[1] + 1), dtype=np.int64)
        np.cumsum(pad(words, sizes)[order], axis=1, out=self.words[:, 1:])
        rows, width = matrix.shape[:2]
        self.first = matrix[0, : self.sizes[0]].astype(">u8").tobytes()
        self.last = matrix[-1, : self.sizes[-1]].astype(">u8").tobytes()
        differ = np.ones((rows, width), dtype=bool)
        both = np.minimum(self.sizes[1:], self.sizes[:-1])
        differ[1:] = (matrix[1:] != matrix[:-1]).any(axis=2) | (np.arange(width) >= both[:, None])
        starts = np.logical_or.accumulate(differ, axis=1)
        # turns shared with the row before; -1: no row before, so that the root starts too
        self.shared = (~starts).sum(axis=1)
        self.shared[0] = -1 if before is None else common_turns(before, self.first)
        self.known = before is not None
        self.extends = before is not None and self.shared[0] * ID_BYTES == len(before)
        # the last row of a leaf: the next one does not go on from it
        self.leaf = np.ones(rows, dtype=np.int64)
        self.leaf[:-1] = self.shared[1:] < self.sizes[:-1]

    def nodes(self) -> Iterator[dict]:
        """For each depth: arrays over its nodes, in order."""
        above = None
        for depth in range(int(self.sizes.max()) + 1):
            rows = np.flatnonzero(self.sizes >= depth)
            shared = self.shared[rows]
            at = np.flatnonzero(shared < depth)
            if not len(at) or at[0]:
                at = np.concatenate(([0], at))
            level = {
                "depth": depth, "start": rows[at], "rows": rows, "at": at, "n_convs": np.diff(np.append(at, len(rows))),
                "conv_id": np.minimum.reduceat(self.conv[rows], at),
                "ends": np.add.reduceat((self.sizes[rows] == depth).astype(np.int64), at),
                "n_children": np.add.reduceat(((self.sizes[rows] > depth) & (shared <= depth)).astype(np.int64), at),
                "n_leaves": np.add.reduceat(self.leaf[rows], at),
                "saved_tokens": np.add.reduceat(
                    np.where(shared >= depth, self.words[rows, np.maximum(shared, 0)] - self.words[rows, max(depth - 1, 0)], 0), at),
                "open": np.zeros(len(at), dtype=bool),
            }
            if rows[0] == 0 and (not self.known or depth <= self.shared[0]):
                level["open"][0] = True
                if self.extends:  # the row before was taken for the end of a leaf
                    level["n_leaves"][0] -= 1
            if rows[-1] == len(self.conv) - 1:
                level["open"][-1] = True
            if above is not None:
                level["above"] = np.searchsorted(above["start"], level["start"], side="right") - 1
                level["parent"], level["parent_open"] = above["conv_id"][level["above"]], above["open"][level["above"]]
            yield level
            above = level


def _rows_of(block: Block, task: int, number: int, chunk_ids: int) -> pa.RecordBatch:
    out: dict[str, list] = {name: [] for name in _ARROW.names}
    first, last = path_keys(block.first), path_keys(block.last)
    names = block.conv.astype(str).tolist()

    def key(depth: int, place: int) -> bytes:
        return first[depth] if place == 0 and depth < len(first) else last[depth]

    def add(kind: int, **values) -> None:
        for name in out:
            out[name].append({"kind": kind, "task": task, "block": number}.get(name, values.get(name)))

    for level in block.nodes():
        depth, rows = level["depth"], level["rows"]
        for n in range(len(level["at"])):
            start, opened = level["start"][n], level["open"][n]
            ends = [names[r] for r in rows[level["at"][n]: level["at"][n] + level["ends"][n]]]
            parent_key = parent = None
            if depth:
                if level["parent_open"][n]:
                    parent_key = key(depth - 1, 0 if level["above"][n] == 0 and rows_start(block, depth - 1) else -1)
                else:
                    parent = int(level["parent"][n])
            values = {x: int(level[x][n]) for x in ("conv_id", *_SUMS)}
            if not opened:
                add(CLOSED, depth=depth, parent_key=parent_key, parent_conv_id=parent, ends=hashlib.sha256(",".join(ends).encode()).hexdigest(), **values)
                continue
            own = key(depth, 0 if start == 0 else -1)
            add(PARTIAL, key=own, parent_key=parent_key, depth=depth, **values)
            for chunk, at in enumerate(range(0, len(ends), chunk_ids)):
                add(ENDS, key=own, chunk=chunk, ends=",".join(ends[at: at + chunk_ids]))
    return pa.RecordBatch.from_pydict(out, schema=_ARROW)


def rows_start(block: Block, depth: int) -> bool:
    """Whether the first node of a depth holds the block's first row."""
    return bool(block.sizes[0] >= depth)


def _edge(kind: int, task: int, seq: bytes, words: list[int]) -> pa.RecordBatch:
    row = dict.fromkeys(_ARROW.names) | {"kind": kind, "task": task, "seq": seq, "words": words}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _build(batches: Iterator[pa.RecordBatch], cells: int, chunk_ids: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted rows: finished nodes, parts of nodes, and the task's first and last row."""
    before, number, task, last_words = None, 0, 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task")[0].as_py()
        conv = batch.column("conv_id").to_numpy()
        seqs, counts = batch.column("seq"), batch.column("words")
        flat = np.frombuffer(b"".join(seqs.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        words = counts.flatten().to_numpy().astype(np.int64)
        sizes = np.diff(np.asarray(counts.offsets)).astype(np.int64)
        stops = np.concatenate(([0], np.cumsum(sizes)))
        at = 0
        while at < len(conv):
            widest = np.maximum.accumulate(sizes[at:])
            fit = np.searchsorted(widest * np.arange(1, len(widest) + 1), cells, side="right")
            to = at + max(int(fit), 1)
            block = Block(conv[at:to], sizes[at:to], flat[stops[at]: stops[to]], words[stops[at]: stops[to]], before)
            if before is None:
                yield _edge(FIRST, task, block.first, np.diff(block.words[0])[: block.sizes[0]].tolist())
            yield _rows_of(block, task, number, chunk_ids)
            before, number, at = block.last, number + 1, to
            last_words = np.diff(block.words[-1])[: block.sizes[-1]].tolist()
    if before is not None:
        yield _edge(LAST, task, before, last_words)


# --- nodes over several blocks ------------------------------------------------------------------

_FIX = "key binary, depth long, n_children long, n_leaves long, saved_tokens long"


def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the first block of a task counted as started although the task before holds it already."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("key", "depth", "n_children", "n_leaves", "saved_tokens")}
        for row in batch.to_pylist():
            shared = common_turns(row["before"], row["seq"])
            words = np.concatenate(([0], np.cumsum(row["words"], dtype=np.int64)))
            ended = shared * ID_BYTES == len(row["before"])
            for depth, key in enumerate(path_keys(row["seq"][: shared * ID_BYTES])):
                out["key"].append(key)
                out["depth"].append(depth)
                out["n_children"].append(-1 if depth < shared else 0)
                out["n_leaves"].append(-1 if ended else 0)
                out["saved_tokens"].append(int(words[shared] - words[max(depth - 1, 0)]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.binary()), *[(n, pa.int64()) for n in list(out)[1:]]]))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every key's chunks in order; a task's rows are sorted by key, so one hash is open at a time."""
    schema = pa.schema([("key", pa.binary()), ("ends", pa.string())])
    open_key, running = None, None
    for batch in batches:
        keys, done = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key != open_key:
                if running is not None:
                    keys.append(open_key)
                    done.append(running.hexdigest())
                open_key, running = key, hashlib.sha256(text.encode())
            else:
                running.update(b",")
                running.update(text.encode())
        yield pa.RecordBatch.from_pydict({"key": keys, "ends": done}, schema=schema)
    if running is not None:
        yield pa.RecordBatch.from_pydict({"key": [open_key], "ends": [running.hexdigest()]}, schema=schema)


def prefix_trie(rows: DataFrame, cells: int = BLOCK_CELLS, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """All nodes of the trie of ``rows`` (``conv_id``, ``seq``, ``words``)."""
    shards = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    built = materialize(shards.select(F.spark_partition_id().alias("task"), "conv_id", "seq", "words").mapInArrow(
        lambda batches: _build(batches, cells, chunk_ids), _SCHEMA))
    parts = built.where(F.col("kind") == PARTIAL)
    firsts = built.where(F.col("kind") == FIRST).select("task", "seq", "words")
    lasts = built.where(F.col("kind") == LAST).select("task", F.col("seq").alias("end"))
    # as many rows as the job has tasks
    seam = firsts.join(lasts, "task").withColumn("before", F.lag("end").over(Window.orderBy("task")))
    fixes = seam.where(F.col("before").isNotNull()).select("before", "seq", "words").mapInArrow(_fix, _FIX)
    sums = ["key", "parent_key", "depth", "conv_id", *_SUMS]
    whole = parts.select(*sums).unionByName(fixes, allowMissingColumns=True).groupBy("key").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in _SUMS])
    hashed = (
        built.where(F.col("kind") == ENDS).select("key", "task", "block", "chunk", "ends").repartition("key")
        .sortWithinPartitions("key", "task", "block", "chunk").select("key", "ends").mapInArrow(_hash_ends, "key binary, ends string"))
    opened = materialize(whole.join(hashed, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))))
    name = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    # a node of many children is looked up once for each task that has some
    named = parts.select(F.col("key").alias("parent_key"), "task").distinct().join(name, "parent_key")
    closed = built.where(F.col("kind") == CLOSED)
    columns = ["conv_id", "depth", "parent_conv_id", *_SUMS, F.col("ends").alias("ends_sha256")]
    return (
        closed.where(F.col("parent_key").isNull()).select(*columns)
        .unionByName(closed.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(named, ["parent_key", "task"]).select(*columns))
        .unionByName(opened.join(name, "parent_key", "left").select(*columns))
    )


def conversation_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shared: bool = False,
    cells: int = BLOCK_CELLS, chunk_ids: int = CHUNK_IDS,
) -> DataFrame:
    """The trie of the given conversations; with ``shared`` of the rebuilt ones (:func:`rebuild`)."""
    rows = turn_rows(conversations, conv, turn, role, text)
    return prefix_trie(rebuild(rows) if shared else rows.drop("family"), cells, chunk_ids)


#: The same in SQL; the path of MD5 texts stands for a node, the checksum is worked out bit by bit.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS family,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, y: CASE WHEN y >= 0 THEN xor(s, y) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, n, id, w FROM c JOIN t ON t.conv_id = c.family AND n <= h
  UNION ALL SELECT c.conv_id, 1, n, id, w FROM c JOIN t ON t.conv_id = c.conv_id AND n > h),
p AS (
  SELECT conv_id, row_number() OVER o AS depth, string_agg(id, '') OVER o AS path, w
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS w FROM c UNION ALL SELECT conv_id, depth, path, w FROM p),
e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own FROM m GROUP BY path, depth),
kids AS (SELECT substr(path, 1, 32 * (depth::INT - 1)) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
sub AS (
  SELECT substr(path, 1, 32 * d::INT) AS path, sum(own)::BIGINT AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT node.path, own, kids.n IS NULL AS leaf, unnest(range(0, depth + 1)) AS d FROM node LEFT JOIN kids ON kids.path = node.path) GROUP BY 1),
ended AS (SELECT m.path, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids FROM m JOIN e ON e.conv_id = m.conv_id AND e.depth = m.depth GROUP BY m.path)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, sub.leaves AS n_leaves,
  sub.saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sub ON sub.path = node.path LEFT JOIN kids ON kids.path = node.path LEFT JOIN ended ON ended.path = node.path
LEFT JOIN node up ON node.depth > 0 AND up.path = substr(node.path, 1, 32 * (node.depth::INT - 1))
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"), shared=True)

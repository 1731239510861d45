"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage with block-max WAND.

The items are the indexed documents, a passage's distinct words are the query. An item's BM25 weights are divided by its
full score, so a passage's score is the share (0 to 1) of the item's BM25 weight that it holds, and one threshold
serves short and long items. All items at or above the threshold are retrieved: posting lists are cut into blocks with
their largest weights, and blocks whose sum cannot reach the threshold are skipped unread. The most frequent words, as many as
give no item more than half of the threshold, open no lists: what they can add to any item is subtracted from the threshold of the other
lists, and they are counted for the items that these reach. A passage is skipped as a whole when in no block of neighbouring items
the largest weights of its words together reach that. Retrieved items are verified: the passage must hold enough
of the question's and of the answer's words in their order (longest common subsequence). The question is an item's text up to its last sentence, which is
the answer; an item of one sentence is split before its last quarter.

Items are indexed by length class, a power of two of words (``LEAST_CLASS`` at least). Passages are windows of twice the class,
moved by the class, so any copy of an item lies in one whole. A retrieved item is verified in spans of twice its own length, moved
by half of it, which hold its score, its question and its answer together; so an item's matches depend on no other item's length.
Items are indexed in shards of bounded text size, one after the other, each searched by all passages; statistics are taken over all items.

Defined results: null and empty texts hold nothing; null, empty or wordless items match nothing; a null id is an
ordinary value; repeated documents count once for each (document, item), repeated items (id and text) are one; an empty table of either kind gives an empty result. Only
ids and texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from incidentlens.llm.common import in_batches, materialize, read_table
from incidentlens.session import scratch_path

K1, B = 1.2, 0.75
#: Share of an item's BM25 weight from which it is retrieved, and what verification asks of question and answer.
THRESHOLD, QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.75, 0.5
BLOCK_ITEMS = 8
#: Items of one index hold at most about so many characters; more items make more shards.
SHARD_CHARS = 8_000_000
#: Items of up to so many words are searched together.
LEAST_CLASS = 64

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def common_in_order(part: list[str], passage: list[str]) -> int:
    """Length of the longest common subsequence of words, one bit for each word of ``part``."""
    places: dict[str, int] = {}
    for n, word in enumerate(part):
        places[word] = places.get(word, 0) | 1 << n
    full = (1 << len(part)) - 1
    row = full
    for word in passage:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(part) - row.bit_count()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    sentences = [w for s in _SENTENCE.split(text.strip()) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = words_of(text)
    cut = max(1, len(words) - max(1, len(words) // 4))
    return words[:cut], words[cut:]


def length_class(words: int) -> int:
    """The smallest power of two that is not below a number of words, ``LEAST_CLASS`` at least."""
    return max(LEAST_CLASS, 1 << (words - 1).bit_length())


@dataclass
class Statistics:
    """Over all items: how many there are, their mean length, and in how many each word stands."""

    items: int
    mean_words: float
    frequency: dict[str, int]


class Index:
    """Posting lists by word: item numbers ascending, their weights, and the largest weight of every block."""

    def __init__(self, items: list[tuple], statistics: Statistics, lowest: float = THRESHOLD):
        self.ids, self.parts, self.lengths, lists = [], [], [], {}
        self.lowest = lowest
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            number, counts = len(self.ids), Counter(words)
            scale = K1 * (1 - B + B * len(words) / statistics.mean_words)
            weight = {
                w: math.log(1 + (statistics.items - statistics.frequency[w] + 0.5) / (statistics.frequency[w] + 0.5)) * n * (K1 + 1) / (n + scale)
                for w, n in counts.items()
            }
            full = sum(weight.values())
            for w, x in weight.items():
                lists.setdefault(w, []).append((number, x / full))
            self.ids.append(item_id)
            self.parts.append(question_and_answer(text))
            self.lengths.append(len(words))
        self.width = length_class(max(self.lengths, default=1))
        self.term = {w: n for n, w in enumerate(lists)}
        self.numbers = [[n for n, _ in x] for x in lists.values()]
        self.weights = [[w for _, w in x] for x in lists.values()]
        self.blocks = [[max(x[i:i + BLOCK_ITEMS]) for i in range(0, len(x), BLOCK_ITEMS)] for x in self.weights]
        self.largest = [max(x) for x in self.weights]
        self.item_weights: list[dict[int, float]] = [{} for _ in self.ids]
        for t, (numbers, weights) in enumerate(zip(self.numbers, self.weights)):
            for n, w in zip(numbers, weights):
                self.item_weights[n][t] = w
        # frequent words that open no list, and the most that they give any item
        self.frequent: set[int] = set()
        self.frequent_most, sums = 0.0, [0.0] * len(self.ids)
        for t in sorted(range(len(self.numbers)), key=lambda t: -len(self.numbers[t])):
            most = max(sums[n] + w for n, w in zip(self.numbers[t], self.weights[t]))
            if most > lowest / 2:
                break
            for n, w in zip(self.numbers[t], self.weights[t]):
                sums[n] += w
            self.frequent.add(t)
            self.frequent_most = max(self.frequent_most, most)
        #: What each term adds to the bound of a passage; the last entry stands for all other words.
        self.bound = np.array([*(0.0 if t in self.frequent else x for t, x in enumerate(self.largest)), 0.0])

        # of each term: the blocks of neighbouring items that hold it, and its largest weight in each
        self.item_blocks, self.item_block_most = [], []
        for t, (numbers, weights) in enumerate(zip(self.numbers, self.weights)):
            most: dict[int, float] = {}
            for n, w in zip(numbers, weights):
                most[n // BLOCK_ITEMS] = max(most.get(n // BLOCK_ITEMS, 0.0), w)
            self.item_blocks.append(np.fromiter(most.keys(), dtype=np.int64))
            self.item_block_most.append(np.fromiter(most.values(), dtype=np.float64))

    def may_hold(self, terms: list[int], least: float) -> bool:
        """Whether some block of items has a sum of largest weights of at least ``least``."""
        if not terms:
            return False
        blocks = np.concatenate([self.item_blocks[t] for t in terms])
        most = np.concatenate([self.item_block_most[t] for t in terms])
        return np.bincount(blocks, weights=most).max() >= least

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all (item number, score) with a score of at least ``threshold``."""
        if threshold < self.lowest:
            raise ValueError(f"the index serves thresholds from {self.lowest}")
        cursors = [[self.numbers[t][0], 0, t] for t in terms if t not in self.frequent]
        found, slack = [], threshold - self.frequent_most - 1e-9
        while cursors:
            cursors.sort()
            reach, pivot = 0.0, -1
            for n, (_, _, t) in enumerate(cursors):
                reach += self.largest[t]
                if reach >= slack:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks in which the pivot item would stand, and the first item behind any of them
            reach, behind = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for _, at, t in cursors[: pivot + 1]:
                numbers, block = self.numbers[t], at // BLOCK_ITEMS
                while (block + 1) * BLOCK_ITEMS <= len(numbers) - 1 and numbers[(block + 1) * BLOCK_ITEMS] <= item:
                    block += 1
                reach += self.blocks[t][block]
                stop = (block + 1) * BLOCK_ITEMS
                behind = min(behind, numbers[stop] if stop < len(numbers) else 1 << 60)
            target = item
            if reach < slack:
                target = max(behind, item + 1)
            elif cursors[0][0] == item:
                held = self.item_weights[item]
                score = sum(held.get(t, 0.0) for t in terms)
                if score >= threshold - 1e-9:
                    found.append((item, score))
                target = item + 1
            kept = []
            for cursor in cursors[: pivot + 1]:
                _, at, t = cursor
                numbers = self.numbers[t]
                while at < len(numbers) and numbers[at] < target:
                    at += 1
                if at < len(numbers):
                    kept.append([numbers[at], at, t])
            cursors[: pivot + 1] = kept
        return found

    def overlap(self, number: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's and of the answer's words that a passage holds in order."""
        return tuple(common_in_order(p, passage) / len(p) if p else 1.0 for p in self.parts[number])

    def verified(
        self, number: int, words: list[str], terms: np.ndarray, start: int, end: int, threshold: float, question: float, answer: float,
    ) -> tuple[float, float, float, int]:
        """The best span of twice the item's length in or across a passage that holds the item: score, question and answer
        share, and its first word negated; empty if there is none."""
        length, held = self.lengths[number], self.item_weights[number]
        step, best = max(1, length // 2), (0.0,)
        first = max(0, (start - length) // step * step)
        for at in range(first, min(end, max(1, len(words) - length + step)), step):
            score = sum(held.get(t, 0.0) for t in set(terms[at:at + 2 * length].tolist()))
            if score >= threshold - 1e-9:
                q, a = self.overlap(number, words[at:at + 2 * length])
                if q >= question - 1e-9 and a >= answer - 1e-9:
                    best = max(best, (score, q, a, -at))
        return best

    def matches(self, words: list[str], threshold: float, question: float, answer: float) -> dict[int, tuple[float, float, float, int]]:
        """Best verified span of every item: score, question and answer share, and its first word negated."""
        if not words or not self.ids:
            return {}
        other = len(self.term)
        get = self.term.get
        terms = np.fromiter((get(w, other) for w in words), dtype=np.int64, count=len(words))
        total = np.concatenate(([0.0], np.cumsum(self.bound[terms])))
        least = threshold - self.frequent_most - 1e-6
        starts = np.arange(0, max(1, len(words) - self.width), self.width)
        ends = np.minimum(starts + 2 * self.width, len(words))
        best: dict[int, tuple[float, float, float, int]] = {}
        for start, end in zip(starts.tolist(), ends.tolist()):
            if total[end] - total[start] < least:
                continue
            query = np.unique(terms[start:end])
            query = query[query != other].tolist()
            if not self.may_hold([t for t in query if t not in self.frequent], least):
                continue
            for number, _ in self.search(query, threshold):
                found = self.verified(number, words, terms, start, end, threshold, question, answer)
                if len(found) > 1:
                    best[number] = max(best.get(number, (0.0,)), found)
        return best


class Shards:
    """All items with words in shards of bounded size, with an index for each length class; statistics over all items.

    Items are written once, by shard; the words' frequencies are counted by Spark. One shard at a time, with the frequencies of its
    own words only, comes to the driver, so that neither holds more than about twice ``shard_chars`` characters (or one longer item).
    """

    def __init__(self, items: DataFrame, key: str, text: str, shard_chars: int = SHARD_CHARS):
        given = items.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
        count = given.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
        self.shards, self.id_type = max(1, -(-(count.chars or 0) // shard_chars)), to_arrow_type(given.schema["id"].dataType)
        while 1 < self.shards < 8 * count.rows and self._largest(given) > 2 * shard_chars:
            self.shards *= 2
        path = scratch_path(items.sparkSession, "items")
        _with_words(given.withColumn("shard", self._shard())).write.partitionBy("shard").parquet(path)
        kind = given.schema["id"].dataType.simpleString()
        self.rows = items.sparkSession.read.schema(f"id {kind}, text string, words array<string>, n_words long, shard int").parquet(path)
        self.frequency = materialize(self.rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
        held = self.rows.agg(F.count("*").alias("rows"), F.sum("n_words").alias("words")).first()
        self.items, self.mean_words = held.rows, (held.words or 0) / max(held.rows, 1)

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("id", "text"), F.lit(self.shards)).cast("int")

    def _largest(self, given: DataFrame) -> int:
        """Characters of the largest shard that a finer division can make smaller."""
        sizes = given.groupBy(self._shard().alias("shard")).agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
        return sizes.where("rows > 1").agg(F.max("chars").alias("most")).first().most or 0

    def __len__(self) -> int:
        return self.shards

    def __iter__(self) -> Iterator[list[Index]]:
        for n in range(self.shards):
            rows = self.rows.where(F.col("shard") == n)
            words = rows.select(F.explode("words").alias("word")).distinct()
            counts = {r.word: r.n for r in self.frequency.join(words, "word").collect()}
            statistics = Statistics(self.items, self.mean_words, counts)
            classes: dict[int, list[tuple]] = {}
            for r in sorted(rows.select("id", "text", "n_words").collect(), key=lambda r: (r.id is None, r.id or 0, r.text)):
                classes.setdefault(length_class(r.n_words), []).append((r.id, r.text))
            yield [Index(classes[size], statistics) for size in sorted(classes)]


def _with_words(items: DataFrame) -> DataFrame:
    """Items with their distinct words and the number of all; those without words drop."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())),
                 pa.array([len(w) for w in words], pa.int64()), batch.column("shard")],
                names=["id", "text", "words", "n_words", "shard"])

    kind = items.schema["id"].dataType.simpleString()
    return in_batches(items, cut, f"id {kind}, text string, words array<string>, n_words long, shard int").where("n_words > 0")


def build_shards(items: DataFrame, key: str, text: str, shard_chars: int = SHARD_CHARS) -> Shards:
    return Shards(items, key, text, shard_chars)


def _finder(shard: list[Index], id_type: pa.DataType, threshold: float, question: float, answer: float) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, items, rows = [], [], []
            for n, text in enumerate(batch.column("_text").to_pylist()):
                words = words_of(text)
                for index in shard:
                    for number, (score, q, a, start) in index.matches(words, threshold, question, answer).items():
                        of.append(n)
                        items.append(index.ids[number])
                        rows.append((score, q, a, -start))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(of, pa.int32())), pa.array(items, id_type)]
                + [pa.array(c, pa.float64()) for c in columns[:3]] + [pa.array(columns[3], pa.int64())],
                names=["_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
            )
    return find


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP, shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """One row for each document and item it holds: best score, both overlaps, and the passage's first word.

    With several shards each one's finds are written before the next one is indexed.
    """
    kind, item_kind = (t.schema[k].dataType.simpleString() for t, k in ((docs, key), (items, item_key)))
    given = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, first_word long"
    shards = build_shards(items, item_key, item_text, shard_chars)
    parts = [
        part if len(shards) == 1 else materialize(part)
        for part in (in_batches(given, _finder(shard, shards.id_type, threshold, question, answer), schema) for shard in shards)
    ]
    found = reduce(DataFrame.union, parts)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("first_word")).alias("at"))).alias("best")
    return found.groupBy("_id", "item_id").agg(best).select(
        F.col("_id").alias(key), "item_id", "best.score", "best.question_overlap", "best.answer_overlap", (-F.col("best.at")).alias("first_word"))


def _holds_any(shard: list[Index], text: str | None) -> bool:
    words = words_of(text)
    return any(index.matches(words, THRESHOLD, QUESTION_OVERLAP, ANSWER_OVERLAP) for index in shard)


def without_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """The documents that hold no item, with all their columns.

    With one shard each is judged in the task that reads it; with several, the digests of the texts that hold an item of a shard
    are written before the next shard is indexed, and documents with such a digest go.
    """
    at, shards = docs.columns.index(text), build_shards(items, item_key, item_text, shard_chars)

    def keeper(shard: list[Index]) -> Callable:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not _holds_any(shard, t) for t in batch.column(at).to_pylist()], pa.bool_()))
        return keep

    def marker(shard: list[Index]) -> Callable:
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                holds = pa.array([_holds_any(shard, t) for t in batch.column(0).to_pylist()], pa.bool_())
                yield batch.filter(holds).select([1])
        return mark

    if len(shards) == 1:
        return in_batches(docs, keeper(next(iter(shards))), docs.schema)
    digest = F.sha2(text, 256)
    texts = docs.select(F.col(text).alias("_text"), digest.alias("_digest"))
    parts = [materialize(in_batches(texts, marker(shard), "_digest string").distinct()) for shard in shards]
    # the whole row rides in one column, so that no name of the table can clash with the digest's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest.alias("_digest"))
    return rows.join(reduce(DataFrame.union, parts).distinct(), "_digest", "left_anti").select("_row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

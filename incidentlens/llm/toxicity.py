"""Toxicity: a support vector machine over the gap-weighted subsequence string kernel, with Nyström landmarks.

Units of a text are its words (at white space, lower-cased, outer punctuation removed) and runs of single characters
with spaces between them, joined. The kernel of two units sums, over all common subsequences of five letters, the decay to the power of the
lengths they span in both; it is normalised to 1 for equal units. Inserted characters and gaps only lower it, so
broken-up insults stay near their plain form. A unit is described by its kernel to the landmarks (Nyström's
approximation; it is cut to 0 for units that lack too many of a landmark's letters, which spares most pairs), the machine is linear in that, and a text's score is a logistic function of its two best units' values.

Training takes a bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN`` rows, those of the smallest id hash): the labelled
sentences of a toxic text are known to hold an insult somewhere, those of a clean text to hold none. Landmarks are the
letter sequences that cover the toxic texts and few clean ones, as many as it takes, some usual words, and clean words that look alike. Each toxic text
then gives its best unit, each clean one its worst units, and the machine is fitted to these again until they settle.

Training does not depend on the order of rows or on Python's hash seed. Every text is scored whole, however long, in batches bounded in
bytes. Units are scored once for each task and kept in a cache of bounded size. Defined results: null and
empty texts, and texts without a unit of three letters, get the score of no evidence; without any usable label
every score is 0; a null id is not held out and never a training row; repeated rows get equal scores and train once, of different texts under one id
the smallest trains; an empty
table gives an empty result. Only id and text are read from the documents, id and label from the labels.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm.common import in_batches, read_table

#: Letters of a subsequence, its decay for each letter spanned, and the longest unit taken as one.
LETTERS, DECAY, WINDOW = 5, 0.6, 24
#: Marks at the begin and the end of a word; they count as letters.
START, END = "\x02", "\x03"
#: Bounds of the training sample, of the clean landmarks and of a task's cache of scored units.
MAX_TOXIC, MAX_CLEAN, USUAL, CACHE = 1000, 2000, 8, 300_000
#: Share of a landmark's letters that a unit must have in order for the kernel to count; below it is 0.
COMMON = 0.7
#: Texts and units worked on at a time.
TEXTS, UNITS = 1024, 16384
#: Pairs worked on at a time: enough to outweigh the calls, few enough for some 25 MB of tables.
PAIRS = 6144
#: Entries of the table that counts letter sequences by hash.
TALLY = 1 << 24
#: Longest letter sequence that becomes a landmark.
LONGEST = 12
#: A text is toxic from this probability.
CUT = 0.3

_SPACED = re.compile(r"(?<!\S)(?:\S\s){3,}\S(?!\S)")
_OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def units_of(text: str) -> list[str]:
    """Distinct raw units of a text, sorted: the model must not depend on the order of a set."""
    low = text.lower()
    found = set(low.split())
    if _SPACED.search(low):
        found.update("".join(run.split()) for run in _SPACED.findall(low))
    return sorted(found)


def parts_of(unit: str) -> list[str]:
    """What is compared with the landmarks: the unit between marks, without outer punctuation and without any; long ones in overlapping windows."""
    core = unit.strip(_OUTER)
    cores = [core] if core.isalpha() else [core, "".join(filter(str.isalpha, core))]
    return [
        part for c in (f"{START}{c}{END}" for c in cores)
        for part in ([c] if len(c) <= WINDOW else [c[i:i + WINDOW] for i in range(0, len(c) - WINDOW // 2, WINDOW // 2)])
    ]


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def common_letters(left: np.ndarray, right: list[str]) -> np.ndarray:
    """Longest common subsequence lengths of coded units with every landmark, by bit-parallel rows."""
    full = np.array([(1 << len(t)) - 1 for t in right], dtype=np.uint32)
    alphabet = sorted({ord(c) for t in right for c in t})
    masks = np.zeros((len(alphabet) + 1, len(right)), dtype=np.uint32)
    for n, text in enumerate(right):
        for at, c in enumerate(text):
            masks[alphabet.index(ord(c)), n] |= np.uint32(1 << at)
    place = np.searchsorted(alphabet, left)
    place = np.where(np.append(alphabet, 0xFFFFFFFF)[place] == left, place, len(alphabet))
    row = np.broadcast_to(full, (len(left), len(right))).copy()
    for at in range(left.shape[1]):
        hit = row & masks[place[:, at]]
        row = (row + hit) | (row - hit)
    return np.bitwise_count(~row & full)


def subsequence_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Kernel of aligned pairs of coded units (rows); fills must never agree."""
    n, long = left.shape
    short = right.shape[1]
    prime = np.ones((long + 1, short + 1, n), dtype=np.float32)
    same = left.T[:, None, :] == right.T[None, :, :]
    square = np.float32(DECAY * DECAY)
    for _ in range(LETTERS - 1):
        following = np.zeros_like(prime)
        for i in range(1, long + 1):
            run = np.zeros(n, dtype=np.float32)
            for j in range(1, short + 1):
                run = np.float32(DECAY) * run + same[i - 1, j - 1] * (square * prime[i - 1, j - 1])
                following[i, j] = np.float32(DECAY) * following[i - 1, j] + run
        prime = following
    return square * (same * prime[:long, :short]).sum(axis=(0, 1), dtype=np.float64)


@dataclass
class Landmarks:
    """Landmarks with their own kernels; gives normalised kernels of units to all of them."""

    texts: list[str]

    def __post_init__(self):
        self.width = max(map(len, self.texts))
        self.least = np.array([max(LETTERS, ceil(COMMON * len(t))) for t in self.texts])
        self.codes = _codes(self.texts, self.width, 0xFFFFFFFE)
        self.own = subsequence_kernel(_codes(self.texts, self.width, 0xFFFFFFFD), self.codes)

    def kernels(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(self.texts)), dtype=np.float32)
        order = sorted(range(len(units)), key=lambda n: len(units[n]))
        for low in range(0, len(order), UNITS):
            part = [n for n in order[low:low + UNITS] if len(units[n]) >= LETTERS]
            if not part:
                continue
            chosen = [units[n] for n in part]
            codes = _codes(chosen, len(chosen[-1]), 0xFFFFFFFD)
            row, column = np.nonzero(common_letters(codes, self.texts) >= self.least)
            if not len(row):
                continue
            touched = np.unique(row)
            own = np.zeros(len(part))
            for at in range(0, len(touched), PAIRS):
                some = codes[touched[at:at + PAIRS]]
                own[touched[at:at + PAIRS]] = subsequence_kernel(some, np.where(some == 0xFFFFFFFD, 0xFFFFFFFE, some))
            value = np.concatenate([
                subsequence_kernel(codes[row[i:i + PAIRS]], self.codes[column[i:i + PAIRS]]) for i in range(0, len(row), PAIRS)])
            out[np.array(part)[row], column] = value / np.sqrt(own[row] * self.own[column])
        return out


@dataclass
class Model:
    """Landmarks, their weights in the machine's decision, and the line from a text's two best decisions to log-odds."""

    landmarks: Landmarks | None
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def decisions(self, units: list[str]) -> np.ndarray:
        """The machine's value of every raw unit: that of its best part."""
        parts: dict[str, int] = {}
        owner, part = [], []
        for n, unit in enumerate(units):
            for p in parts_of(unit):
                owner.append(n)
                part.append(parts.setdefault(p, len(parts)))
        values = self.landmarks.kernels(list(parts)) @ self.weights + self.bias
        out = np.full(len(units), -np.inf)
        np.maximum.at(out, owner, values[part])
        return out

    def probability(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(decisions @ self.slopes + self.offset)))

    def score_texts(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        if self.landmarks is None:
            return np.zeros(len(texts))
        return self.probability(self.best_decisions(texts, cache))

    def best_decisions(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        """The values of each text's two best units."""
        best = np.full((len(texts), 2), self.bias)
        for low in range(0, len(texts), TEXTS):
            units = [units_of(t) if t else [] for t in texts[low:low + TEXTS]]
            if len(cache) > CACHE:
                cache.clear()
            fresh = list(dict.fromkeys(u for own in units for u in own if u not in cache))
            cache.update(zip(fresh, self.decisions(fresh).tolist()) if fresh else ())
            for n, own in enumerate(units, low):
                values = np.fromiter(map(cache.__getitem__, own), dtype=np.float64, count=len(own))
                top = np.partition(values, -2)[-2:] if len(own) > 2 else values
                best[n, :len(top)] = np.sort(top)[::-1]
        return np.maximum(best, self.bias)


def choose_landmarks(toxic: list[list[str]], clean: list[list[str]]) -> list[str]:
    """Letter sequences in turn by the toxic texts that hold them in units not covered yet, against the clean texts that hold them.

    A text counts less the more landmarks it holds already; the choice ends when no sequence is worth ``1 / 150`` of the toxic texts.
    """
    def sequences(unit: str) -> set[str]:
        return {
            part[i:i + size] for part in parts_of(unit)
            for size in range(LETTERS, min(len(part), LONGEST) + 1) for i in range(len(part) - size + 1)
        }

    ratio = len(toxic) / max(len(clean), 1)
    least = max(3, len(toxic) // 150)
    in_clean, in_toxic = Counter(u for units in clean for u in units), defaultdict(list)
    for n, units in enumerate(toxic):
        for unit in units:
            in_toxic[unit].append(n)
    rare = {unit: texts for unit, texts in in_toxic.items() if in_clean[unit] * ratio < 0.1 * len(texts)}
    # most sequences are rare: a table of counts by hash, which can only count too much, spares holding them
    tally = np.zeros(TALLY, dtype=np.int32)

    def slots(found: list[str]) -> np.ndarray:
        return np.fromiter((hash(s) % TALLY for s in found), dtype=np.int64, count=len(found))

    for unit, texts in rare.items():
        tally[slots(list(sequences(unit)))] += len(texts)
    held = defaultdict(set)
    for unit, texts in rare.items():
        found = list(sequences(unit))
        for n in np.flatnonzero(tally[slots(found)] >= least):
            held[found[n]].update(texts)
    held = {s: x for s, x in held.items() if len(x) >= least}
    against = Counter()
    for unit, texts in in_clean.items():
        for s in sequences(unit) & held.keys():
            against[s] += texts
    held = {s: x for s, x in held.items() if against[s] * ratio < 0.1 * len(x)}
    if not held:
        return []
    # one entry for each sequence, unit that holds it and text that holds the unit
    names = sorted(held, key=lambda s: (4 * against[s] * ratio - len(held[s]), -len(s), s))
    place = {s: n for n, s in enumerate(names)}
    entries = [
        (place[s], n, text) for n, (unit, texts) in enumerate(rare.items()) for s in sequences(unit) if s in place for text in texts]
    which, unit, text = np.array(entries, dtype=np.int64).T
    cost = np.array([4 * against[s] * ratio for s in names])
    times, chosen = np.zeros(len(toxic)), []
    while len(which):
        pairs = np.unique(which * len(toxic) + text)
        gain = np.bincount(pairs // len(toxic), 1 / (1 + times[pairs % len(toxic)]), len(names)) - cost
        best = int(np.argmax(gain))
        if gain[best] < least:
            break
        chosen.append(names[best])
        hit = which == best
        times[np.unique(text[hit])] += 1
        open_units = ~np.isin(unit, unit[hit])
        which, unit, text = which[open_units], unit[open_units], text[open_units]
    return chosen


def most_common(counts: Counter) -> list[str]:
    """By falling count, ties by text."""
    return sorted(counts, key=lambda unit: (-counts[unit], unit))


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine of squared hinge loss by Newton steps; both classes weigh the same."""
    z = np.hstack([x, np.ones((len(x), 1))])
    each = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost * len(y) / 2
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        a, c = z[inside], each[inside][:, None]
        step = np.linalg.solve(ridge + 2 * a.T @ (c * a), 2 * (a * c).T @ y[inside])
        if np.allclose(step, w, atol=1e-9):
            break
        w = step
    return w[:-1], float(w[-1])


def fit_line(decisions: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic line from decisions to log-odds, a little ridged."""
    z = np.column_stack([decisions, np.ones(len(decisions))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - toxic) + 1e-2 * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(toxic_texts: list[str], clean_texts: list[str]) -> Model:
    """Landmarks, machine and line from texts; the second fit adds the clean words that the first one takes for insults."""
    untrained = Model(None, np.zeros(0), 0.0, np.zeros(2), 0.0)
    toxic, clean = [units_of(t) for t in toxic_texts], [units_of(t) for t in clean_texts]
    insults = choose_landmarks(toxic, clean)
    if not insults or not clean:
        return untrained
    usual = Counter(p for units in clean for u in units for p in parts_of(u) if LETTERS <= len(p) <= LONGEST)
    place: dict[str, int] = {}
    bags = [np.array(sorted({place.setdefault(p, len(place)) for u in own for p in parts_of(u)}), dtype=np.int64) for own in toxic + clean]
    parts = list(place)
    names = list(dict.fromkeys(insults + most_common(usual)[:USUAL]))
    kernels = Landmarks(names).kernels(parts)
    evidence = kernels[:, :len(insults)].max(axis=1)
    for again in (True, False):
        size, vectors = np.linalg.eigh(Landmarks(names).kernels(names))
        spread = (vectors / np.sqrt(np.maximum(size, 1e-3))).astype(np.float32)
        features = kernels @ spread
        value = evidence
        for _ in range(6):
            witness, against = [], []
            for n, bag in enumerate(bags):
                order = bag[np.argsort(-value[bag], kind="stable")]
                if n >= len(toxic):
                    against += list(order[:5])
                elif len(order) and evidence[order[0]] >= 0.5:
                    witness.append(order[0])  # a toxic text without any such unit teaches nothing
            if not witness or not against:
                return untrained
            chosen = np.array(witness + against)
            w, bias = fit_machine(features[chosen], np.array([1.0] * len(witness) + [-1.0] * len(against)))
            value = features @ w + bias
        if again:
            wrong = Counter(parts[n] for bag in bags[len(toxic):] for n in bag[value[bag] > -0.5])
            more = [p for p in most_common(wrong) if LETTERS <= len(p) <= WINDOW and p not in names][:2 * USUAL]
            if not more:
                break
            names = names + more
            kernels = np.hstack([kernels, Landmarks(more).kernels(parts)])
    model = Model(Landmarks(names), spread @ w, bias, np.zeros(2), 0.0)
    best = model.best_decisions(toxic_texts + clean_texts, {})
    model.slopes, model.offset = fit_line(best, np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return model


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    usable = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(
        F.col("_key").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_key"))).distinct()
    order = [F.xxhash64("_key"), F.col("_key")]
    sample = usable.where("_label = 1").orderBy(*order).limit(MAX_TOXIC).union(usable.where("_label = 0").orderBy(*order).limit(MAX_CLEAN))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key").where("_text IS NOT NULL")
    rows = rows.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    texts: dict[int, list[str]] = {0: [], 1: []}
    for row in sorted(rows.collect(), key=lambda r: (r["_key"], r["_text"])):
        texts[row["_label"]].append(row["_text"])
    return train(texts[1], texts[0])


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            scores = model.score_texts(batch.column("_text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores, pa.float64())], names=["_id", "score"])

    given = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return in_batches(given, score, f"_id {kind}, score double").withColumnRenamed("_id", key)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows that score below ``cut``, with all their columns; each is judged in the task that reads it."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            yield batch.filter(pa.array(model.score_texts(batch.column(at).to_pylist(), cache) < cut))

    return in_batches(docs, keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_on(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

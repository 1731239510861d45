"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

A text's segmentations form a lattice: an edge for every piece of the vocabulary that matches somewhere. Forward
filtering sums the probabilities of all paths up to each position; backward sampling then draws a path from the end,
each edge by its share of the sum. Random numbers come from a counter-based hash of (seed, row key, place), so a row's
segmentation is the same in any order, partitioning or retry.

The given vocabulary ranks its pieces and holds no probabilities; a piece of rank r gets a probability in proportion to
``(r + 1) ** -exponent`` (Zipf's law), ``alpha`` sharpens (over 1) or flattens (under 1) the distribution of paths. A character
that is no piece is spelled in byte pieces, at a price below every piece.

Text is taken as it is: a space is the mark U+2581, one mark stands before the text, and a mark that is in the text itself
is spelled in bytes. Decoding reverses this exactly. No piece crosses from other characters into a mark, so
the lattice falls into independent segments there; equal segments of a batch share one lattice.

Defined results: null and empty texts have the one piece (or the pieces) of the leading mark and decode to the empty
text; a null key is one more key; equal keys and texts get equal segmentations; an empty table gives an empty result. Only
key and text are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm.common import in_batches, read_table
from incidentlens.llm.shingles import mix64

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK, TEXT_MARK = 0x2581, 0x110000
#: Code points handled at a time; a longer text is handled by itself.
CHUNK_CHARS = 1 << 20
SEED, ALPHA, EXPONENT = 1, 1.0, 1.0
BYTE_PRICE = 6.0

_BASE = np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _hash_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which ``_span_hash`` takes the hash of any span."""
    powers = np.full(len(codes) + 1, _BASE)
    inverses = np.full(len(codes) + 1, _INVERSE)
    powers[0] = inverses[0] = 1
    powers, inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return sums, inverses


def _span_hash(sums: np.ndarray, inverses: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))


class Vocabulary:
    """Pieces by the hash of their characters, with log probabilities, and their bytes for decoding."""

    def __init__(self, path: str, exponent: float, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, dtype=np.int32)
        texts, ids, scores = [], [], []
        for n in range(size):
            piece = model.id_to_piece(n)
            if model.is_byte(n):
                self.byte_id[int(piece[3:5], 16)] = n
                self.bytes[n] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n)):
                inner = piece.lstrip("▁")
                if "▁" in inner:
                    continue
                self.bytes[n] = piece.replace("▁", " ").encode()
                texts.append(piece)
                ids.append(n)
                scores.append(model.get_score(n))
        order = np.argsort(-np.array(scores), kind="stable")
        rank = np.empty(len(order))
        rank[order] = np.arange(len(order))
        log = -exponent * np.log(rank + 1)
        log -= np.log(np.exp(log).sum())
        self.longest = max(map(len, texts))
        self.lengths = sorted({len(t) for t in texts})
        hashes = np.empty(len(texts), dtype=np.uint64)
        for length in self.lengths:
            at = [n for n, t in enumerate(texts) if len(t) == length]
            codes = np.frombuffer("".join(texts[n] for n in at).encode("utf-32-le"), dtype=np.uint32)
            sums, inverses = _hash_sums(codes)
            start = np.arange(len(at)) * length
            hashes[at] = _span_hash(sums, inverses, start, start + length)
        by = np.argsort(hashes)
        self.hashes, self.ids, self.log = hashes[by], np.array(ids, dtype=np.int32)[by], alpha * log[by]
        self.byte_log = alpha * (log.min() - BYTE_PRICE)
        # first slot of each leading 16 bits of a hash
        self.slots = np.searchsorted(self.hashes, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, -1 where it is none."""
        at = self.slots[(hashes >> np.uint64(48)).astype(np.int64)]
        found = np.full(len(hashes), -1, dtype=np.int64)
        todo = np.arange(len(hashes))
        last = len(self.hashes)
        while len(todo):
            here = at[todo]
            inside = here < last
            todo, here = todo[inside], here[inside]
            value, wanted = self.hashes[here], hashes[todo]
            found[todo[value == wanted]] = here[value == wanted]
            todo = todo[value < wanted]
            at[todo] += 1
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str, exponent: float, alpha: float) -> Vocabulary:
    return Vocabulary(path, exponent, alpha)


class Lattice:
    """The lattices of distinct segments, laid end to end; a node is a place behind a character."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, pieces: Vocabulary):
        stops = np.cumsum(lengths)
        begins = stops - lengths
        self.begin = np.repeat(begins, lengths)
        left = np.repeat(stops, lengths) - np.arange(len(codes))
        sums, inverses = _hash_sums(codes)
        starts, ends, ids, logs = [], [], [], []
        single = np.zeros(len(codes), dtype=bool)
        places = np.arange(len(codes))
        for length in pieces.lengths:
            places = places[left[places] >= length]
            if not len(places):
                break
            at = pieces.find(_span_hash(sums, inverses, places, places + length))
            hit = at >= 0
            starts.append(places[hit])
            ends.append(places[hit] + length)
            ids.append(pieces.ids[at[hit]])
            logs.append(pieces.log[at[hit]])
            if length == 1:
                single[places[hit]] = True
        spelled = np.flatnonzero(~single)
        code = codes[spelled]
        size = 1 + (code > 0x7F) + (code > 0x7FF) + ((code > 0xFFFF) & (code != TEXT_MARK))
        starts.append(spelled)
        ends.append(spelled + 1)
        ids.append(-1 - code.astype(np.int64))
        logs.append(pieces.byte_log * size)
        start, end = np.concatenate(starts), np.concatenate(ends)
        piece, log = np.concatenate(ids), np.concatenate(logs)
        depth = end - self.begin[start]
        order = np.lexsort((start, end, depth))
        start, end, depth = start[order], end[order], depth[order]
        self.piece, self.start, log = piece[order], start, log[order]
        # edges into one node stand together; first[node] is the first of them
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        self.first = np.zeros(len(codes) + 1, dtype=np.int64)
        self.first[end[heads]] = heads
        counts = np.diff(heads, append=len(end))
        self.last = np.zeros(len(codes) + 1, dtype=np.int64)
        self.last[end[heads]] = heads + counts - 1
        total = np.zeros(len(codes) + 1)  # log sum of all paths to a node; the node of a segment's begin is read as 0
        self.share = np.empty(len(end))
        bounds = np.searchsorted(depth[heads], np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        for low, high in zip(bounds[:-1], bounds[1:]):
            if low == high:
                continue
            a, b = heads[low], heads[high] if high < len(heads) else len(end)
            inner = heads[low:high] - a
            s = start[a:b]
            value = log[a:b] + np.where(s == self.begin[s], 0.0, total[s])
            top = np.maximum.reduceat(value, inner)
            each = np.exp(value - np.repeat(top, counts[low:high]))
            summed = np.add.reduceat(each, inner)
            total[end[heads[low:high]]] = top + np.log(summed)
            running = np.cumsum(each)
            before = np.repeat(np.concatenate(([0.0], running[inner[1:] - 1])), counts[low:high])
            self.share[a:b] = (running - before) / np.repeat(summed, counts[low:high])

    def sample(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path backward from each node. Pieces of all paths in text order, and their number for each path."""
        count = np.zeros(len(node), dtype=np.int64)
        active, here, taken, step = np.arange(len(node)), node, [], 0
        while len(active):
            draw = mix64(key[active] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
            u = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge, last = self.first[here], self.last[here]
            more = np.flatnonzero((u >= self.share[edge]) & (edge < last))
            while len(more):
                edge[more] += 1
                more = more[(u[more] >= self.share[edge[more]]) & (edge[more] < last[more])]
            taken.append((active, self.piece[edge]))
            count[active] += 1
            start = self.start[edge]
            go = start != self.begin[start]
            active, here = active[go], start[go]
            step += 1
        stop = np.cumsum(count)
        out = np.empty(stop[-1] if len(stop) else 0, dtype=np.int64)
        for step, (paths, piece) in enumerate(taken):
            out[stop[paths] - 1 - step] = piece
        return out, count


def _spell(ids: np.ndarray, pieces: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters that are no piece by byte pieces; also how many pieces each entry became."""
    odd = np.flatnonzero(ids < 0)
    sizes = np.ones(len(ids), dtype=np.int64)
    if not len(odd):
        return ids.astype(np.int32), sizes
    spelled = []
    for code in -1 - ids[odd]:
        spelled.append(pieces.byte_id[list(chr(MARK if code == TEXT_MARK else code).encode("utf-8", "surrogatepass"))])
    sizes[odd] = [len(s) for s in spelled]
    out = np.repeat(ids, sizes).astype(np.int32)
    begins = np.cumsum(sizes) - sizes
    for at, values in zip(begins[odd], spelled):
        out[at: at + len(values)] = values
    return out, sizes


def encode_texts(texts: list[str], keys: np.ndarray, pieces: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts, one after another, and the number of pieces of each text."""
    all_ids, all_counts = [], []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < CHUNK_CHARS):
            size += len(texts[stop]) + 1
            stop += 1
        lengths = np.array([len(t) + 1 for t in texts[at:stop]])
        codes = np.frombuffer(("▁" + "▁".join(texts[at:stop])).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        ends = np.cumsum(lengths)
        begins = ends - lengths
        codes[codes == MARK] = TEXT_MARK
        codes[codes == 32] = MARK
        codes[begins] = MARK
        marks = codes == MARK
        new = marks.copy()
        new[1:] &= ~marks[:-1]
        new[begins] = True
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(codes))
        sums, inverses = _hash_sums(codes)
        _, first, which = np.unique(_span_hash(sums, inverses, starts, stops), return_index=True, return_inverse=True)
        span = stops[first] - starts[first]
        node_end = np.cumsum(span)
        taken = np.repeat(starts[first] - (node_end - span), span) + np.arange(node_end[-1])
        lattice = Lattice(codes[taken], span, pieces)
        row = np.searchsorted(begins, starts, side="right") - 1
        place = (np.arange(len(starts)) - np.searchsorted(starts, begins)[row]).astype(np.uint64)
        key = mix64(keys[at:stop][row] + place * np.uint64(0xD1B54A32D192ED03))
        # a node's number is the place behind its last character, which is the next segment's first one
        ids, count = lattice.sample(node_end[which], key)
        ids, sizes = _spell(ids, pieces)
        all_ids.append(ids)
        per_text = np.add.reduceat(np.concatenate((np.add.reduceat(sizes, np.cumsum(count) - count), [0])), np.searchsorted(starts, begins))
        all_counts.append(per_text)
        at = stop
    if not all_ids:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
    return np.concatenate(all_ids), np.concatenate(all_counts)


def decode_ids(ids: list[int], pieces: Vocabulary) -> str:
    table = pieces.bytes
    return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def _encoder(path: str, exponent: float, alpha: float, check: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path, exponent, alpha)
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            ids, counts = encode_texts(texts, batch.column("_seed").to_numpy(zero_copy_only=False).view(np.uint64), pieces)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            columns = [batch.column("_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
            names = ["_id", "pieces"]
            if check:
                same = [decode_ids(ids[a:b].tolist(), pieces) == t for t, a, b in zip(texts, offsets[:-1], offsets[1:])]
                columns.append(pa.array(same, pa.bool_()))
                names.append("lossless")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return encode


def encode_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = SEED,
    alpha: float = ALPHA, exponent: float = EXPONENT, check: bool = False,
) -> DataFrame:
    """Key and sampled ``pieces`` of every row; with ``check`` also whether decoding them gives the text back."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.lit(seed), F.col(key)).alias("_seed"))
    schema = f"_id {kind}, pieces array<int>" + (", lossless boolean" if check else "")
    return in_batches(given, _encoder(model, exponent, alpha, check), schema).withColumnRenamed("_id", key)


def decode_documents(encoded: DataFrame, key: str = "doc_id", pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """Key and text of every row of piece ids."""
    kind = encoded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(model, EXPONENT, ALPHA)
        for batch in batches:
            texts = [decode_ids(ids or [], table) for ids in batch.column("_pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

    given = encoded.select(F.col(key).alias("_id"), F.col(pieces).alias("_pieces"))
    return in_batches(given, decode, f"_id {kind}, text string").withColumnRenamed("_id", key)


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(read_table(spark, sf_dir, "documents"), check=True)
    return found.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless")

"""Token ids of documents in a compact binary form: Simple-8b words, escapes, and per-block offsets.

Documents are dealt by range of their id and sorted; each task encodes its part and packs the stream of ids, every document closed by
an end id, into blocks of ``BLOCK_IDS`` ids. A block is one binary value: a header (format mark, number of ids, words
and escapes, little-endian 32-bit), 64-bit words, then escapes. A word's top four bits select how many ids of which width fill the
other sixty. Ids beyond the widest slot are an escape mark there, their values follow behind the words. The blocks of a task are a
shard, and the files are Parquet, so that Spark's committer makes them safe against lost tasks. Beside its block stand the index of its
first id in the shard and, for each document that has ids in it, where they begin: a block is decoded alone, and a reader
that wants one document reads its blocks only. Packing and unpacking are numpy operations over whole blocks.

A document may go over many blocks, and a block may hold many. The checksum of a document is put together from those of
its pieces, shifted by the bytes that follow, with an exclusive or; so no piece has to be moved to another.

Defined results: a null or empty text is its end id alone; null keys come last; rows with equal keys are in order of their texts'
hash; an empty table writes no block; a text is encoded in chunks between single spaces, and one without any in parts cut after
line ends between word characters: no token of this kind of vocabulary crosses either. Only key and text are read. Strings of special
tokens inside a text are taken as the library takes them by default; ``plain_special`` makes them ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import read_table
from incidentlens.session import scratch_path

END_ID = 0
BLOCK_IDS = 1 << 16
#: Characters encoded in one call; a longer text is cut into parts of about this size.
CALL_CHARS, PART_CHARS = 1 << 22, 1 << 18
PART_END = re.compile(r"(?<=\w)\n(?=\w)")
#: White space, and characters that some libraries take for it; a space between two others.
WHITE = frozenset(c for c in map(chr, [*range(0x3100)]) if c.isspace()) | {"\u180e", "\u200b", "\ufeff"}
BETWEEN = re.compile("(?<=[^\\s\u180e\u200b\ufeff]) (?=[^\\s\u180e\u200b\ufeff])")
_CLASS = "".join(rf"\x{{{ord(c):X}}}" for c in sorted(WHITE - {"\n"}))
EDGE = rf"^\n?[{_CLASS}]|^\n\n|[{_CLASS}\n]$"
#: Encoded words that a worker keeps.
KNOWN = 1_000_000
#: Latin letters, then ASCII punctuation other than an apostrophe.
WORD = r"^(?P<word>\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<mark>[!-&(-/:-@\[-`{-~]*)$"
#: The byte-level form of a text: bytes that cannot be shown stand as the characters from U+0100 on.
SPACE, LINE_END, SHOWN = "\u0120", "\u010a", {byte: 256 + n for n, byte in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

#: Fixed values of Simple-8b: ids in a word and bits of each, by selector. The two widest forms are not used: escapes stand for them.
FORMS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20)]
ESCAPE = (1 << FORMS[-1][1]) - 1
MARK = 0x31423853
_COUNTS = np.array([count for count, _ in FORMS])


# --- Simple-8b ----------------------------------------------------------------------------------

def pack(ids: np.ndarray) -> bytes:
    """One block. Each word takes as many ids as fit; the last one may be filled in part."""
    ids = np.asarray(ids, dtype=np.uint32)
    n = len(ids)
    escaped = ids >= ESCAPE
    values = np.where(escaped, np.uint32(ESCAPE), ids)
    most = int(_COUNTS.max())
    # bits of each id, then the most bits of 1, 2, ... ids from each place on; places behind the end need none
    bits_of = np.zeros(n + most, dtype=np.uint8)
    bits_of[:n] = np.frexp(values.astype(np.float32))[1]
    widest, have = bits_of, 1
    chosen = np.full(n, len(FORMS) - 1, dtype=np.uint8)
    for selector in range(len(FORMS) - 1, -1, -1):
        count, bits = FORMS[selector]
        while have < count:
            step = min(have, count - have)
            widest = np.maximum(widest[:-step], widest[step:])
            have += step
        chosen[widest[:n] <= bits] = selector
    steps, starts, at = _COUNTS[chosen].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, dtype=np.int64)
    selectors = chosen[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((values.astype(np.uint64), np.zeros(most, dtype=np.uint64)))
    for selector in np.unique(selectors):
        count, bits = FORMS[selector]
        if bits:
            mine = selectors == selector
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[mine] |= np.bitwise_or.reduce(padded[starts[mine][:, None] + np.arange(count)] << shifts, axis=1)
    header = np.array([MARK, n, len(words), escaped.sum()], dtype="<u4")
    return header.tobytes() + words.astype("<u8").tobytes() + ids[escaped].astype("<u4").tobytes()


def unpack(block: bytes) -> np.ndarray:
    """The ids of one block."""
    mark, n, n_words, n_escapes = np.frombuffer(block, dtype="<u4", count=4).tolist()
    if mark != MARK or len(block) != 16 + 8 * n_words + 4 * n_escapes:
        raise ValueError("not a block of packed ids")
    words = np.frombuffer(block, dtype="<u8", count=n_words, offset=16)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    offsets = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint32)
    for selector in np.unique(selectors):
        count, bits = FORMS[selector]
        if bits:
            mine = selectors == selector
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[offsets[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    out = out[:n]
    if n_escapes:
        out[out == ESCAPE] = np.frombuffer(block, dtype="<u4", offset=16 + 8 * n_words)
    return out


# --- checksums of pieces ------------------------------------------------------------------------

def _times(columns: list[int], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= columns[low.bit_length() - 1]
        value ^= low
    return out


@lru_cache(maxsize=64)
def _zero_bytes(power: int) -> tuple[int, ...]:
    """The effect of ``2 ** power`` zero bytes on a checksum, as the images of single bits."""
    if power == 0:
        bit = [0xEDB88320] + [1 << k for k in range(31)]
        columns = [1 << k for k in range(32)]
        for _ in range(8):
            columns = [_times(bit, c) for c in columns]
        return tuple(columns)
    half = list(_zero_bytes(power - 1))
    return tuple(_times(half, c) for c in half)


def shifted_crc(crc: int, following: int) -> int:
    """What a piece's CRC-32 adds, by exclusive or, to that of the whole with ``following`` more bytes."""
    power = 0
    while following:
        if following & 1:
            crc = _times(list(_zero_bytes(power)), crc)
        following >>= 1
        power += 1
    return crc


# --- encoding -----------------------------------------------------------------------------------

def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(model: str, plain_special: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(model)
    found.encode_special_tokens = plain_special
    return found


@lru_cache(maxsize=2)
def cuts_at_spaces(model: str) -> bool:
    """Whether the vocabulary splits texts as the byte-level ones do: never inside a word, a space going with the word behind it."""
    with open(model, encoding="utf-8") as file:
        told = json.load(file)
    split = told.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return plain and told.get("normalizer") is None and not any(
        t["lstrip"] or t["rstrip"] or t["normalized"] or not re.fullmatch(r"\S*[^\W_]\S*", t["content"]) for t in told.get("added_tokens", []))


def parts(text: str) -> list[str]:
    """The text, or parts of about ``PART_CHARS`` that are encoded alike."""
    if len(text) <= 4 * PART_CHARS:
        return [text]
    out, at = [], 0
    while (cut := PART_END.search(text, at + PART_CHARS)) is not None:
        out.append(text[at: cut.end()])
        at = cut.end()
    return [*out, text[at:]]


class Recent(dict):
    """Known ids: a full table becomes the old one, from which what is asked for again comes back. Both hold at most ``most``."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = most // 2, {}

    def missing(self, keys: list[str]) -> list[str]:
        """Keys that neither table has; after it, the others are in this one."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()
        absent = [key for key in keys if key not in self]
        self.update((key, self.old[key]) for key in absent if key in self.old)
        return [key for key in absent if key not in self]


class Encoder:
    """Encodes texts chunk by chunk. Chunks are what stands between single spaces or line ends; the library encodes each once, then it is known.

    A space between two characters that are no white space always begins a token, and a line end is one, so the ids of the chunks are those
    of the text. A chunk of Latin letters and punctuation behind them is two words by the vocabulary's rule, which the library merges; it
    encodes all others whole. About ``KNOWN`` words are kept. A vocabulary of another kind gets whole texts.
    """

    def __init__(self, model: str, plain_special: bool):
        self.library, self.by_chunk = tokenizer(model, plain_special), cuts_at_spaces(model)
        self.behind_space = Recent(KNOWN)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Every text's ids as 32-bit numbers, by the library."""
        cut = [parts(t) for t in texts] if self.by_chunk else [[t] for t in texts]
        found = iter(self.library.encode_batch_fast([p for own in cut for p in own], add_special_tokens=False))
        return [b"".join([array("I", next(found).ids).tobytes() for _ in own]) for own in cut]

    def learn(self, words: list[str]) -> None:
        """Encode new words, each with the space or line end before it: Latin ones go straight to the library's merges."""
        merge, hard = self.library.model.tokenize, []
        for word in words:
            line, letters = word.startswith("\n"), word.removeprefix("\n")
            if not letters.isalpha():
                hard.append(word)
                continue
            shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(SHOWN)
            found = [*merge(LINE_END), *merge(shown)] if line else merge(SPACE + shown)
            self.behind_space[word] = array("I", [t.id for t in found]).tobytes()
        self.behind_space.update(zip(hard, self.whole([word if word.startswith("\n") else f" {word}" for word in hard])))

    def chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks behind a space: each is a word and the marks behind it."""
        found = pc.extract_regex(chunks, WORD)
        plain = found.is_valid()
        words = pc.if_else(plain, found.field("word"), chunks).dictionary_encode()
        marks = pc.if_else(plain, found.field("mark"), "").dictionary_encode()
        keys = words.dictionary.to_pylist()
        if new := self.behind_space.missing(keys):
            self.learn(new)
        of_word = pa.array([self.behind_space[key] for key in keys], pa.large_binary()).take(words.indices)
        of_mark = pa.array(self.whole(marks.dictionary.to_pylist()), pa.large_binary()).take(marks.indices)
        return pc.binary_join_element_wise(of_word, of_mark, pa.scalar(b"", pa.large_binary()))

    def of_chunks(self, coded: pa.DictionaryArray, sizes: np.ndarray) -> list[np.ndarray]:
        """The ids of texts given as their chunks in a row."""
        index, starts = coded.indices.to_numpy().copy(), np.concatenate(([0], np.cumsum(sizes[:-1])))
        used, place = np.unique(index[starts], return_inverse=True)
        index[starts] = len(coded.dictionary) + place  # no space before a text's first chunk
        firsts = pa.array(self.whole(coded.dictionary.take(pa.array(used)).to_pylist()), pa.large_binary())
        joined = pa.concat_arrays([self.chunk_ids(coded.dictionary), firsts]).take(pa.array(index))
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64, count=len(joined) + 1) // 4
        data = joined.buffers()[2]
        ids = np.frombuffer(data, dtype=np.uint32, count=offsets[-1]) if offsets[-1] else np.zeros(0, dtype=np.uint32)
        return np.split(ids, offsets[starts[1:]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.frombuffer(ids, dtype=np.uint32) for ids in self.whole(texts)]
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        coded, sizes = cut.flatten().dictionary_encode(), np.diff(np.asarray(cut.offsets))
        # chunks that are empty or have other white space at an end do not stand between single spaces or line ends
        odd = pc.or_(pc.equal(coded.dictionary, ""), pc.match_substring_regex(coded.dictionary, EDGE)).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.of_chunks(coded, sizes)
        of = np.unique(np.repeat(np.arange(len(texts)), sizes)[odd[coded.indices.to_numpy()]])
        kept = np.setdiff1d(np.arange(len(texts)), of)
        again = [BETWEEN.split(texts[n]) for n in of]
        pieces = [cut.take(pa.array(kept)).flatten(), pa.array([c for own in again for c in own], pa.large_string())]
        sizes = np.concatenate((sizes[kept], [len(own) for own in again])).astype(np.int64)
        found = self.of_chunks(pa.concat_arrays(pieces).dictionary_encode(), sizes)
        return [found[n] for n in np.argsort(np.concatenate((kept, of)), kind="stable")]


@lru_cache(maxsize=2)
def encoder(model: str, plain_special: bool) -> Encoder:
    return Encoder(model, plain_special)


def encode_texts(texts: list[str], encode) -> Iterator[np.ndarray]:
    """The ids of the texts in order, about ``CALL_CHARS`` at a time."""
    waiting, size = [], 0
    for text in texts:
        waiting.append(text)
        size += len(text)
        if size >= CALL_CHARS:
            yield from encode(waiting)
            waiting, size = [], 0
    if waiting:
        yield from encode(waiting)


class Packer:
    """A task's stream of ids, cut into blocks with the places of their documents."""

    def __init__(self, shard: int, block_ids: int, key_type: pa.DataType):
        self.shard, self.size, self.key_type = shard, block_ids, key_type
        self.block = self.first = self.place = 0
        self.ids: list[np.ndarray] = []
        self.filled, self.docs = 0, []

    def add(self, key, ids: np.ndarray) -> Iterator[dict]:
        start, done = self.first + self.filled, 0
        while done < len(ids):
            take = min(len(ids) - done, self.size - self.filled)
            self.ids.append(ids[done: done + take])
            self.docs.append({
                "key": key, "place": self.place, "start": start, "n_tokens": len(ids), "done": done, "at": self.filled, "n": take})
            done += take
            self.filled += take
            if self.filled == self.size:
                yield self.close()
        self.place += 1

    def close(self) -> dict:
        row = {
            "shard": self.shard, "block": self.block, "first": self.first, "n_ids": self.filled,
            "ids": pack(np.concatenate(self.ids)), "docs": self.docs}
        self.block, self.first = self.block + 1, self.first + self.filled
        self.ids, self.filled, self.docs = [], 0, []
        return row


def _docs_type(key_type: pa.DataType) -> pa.DataType:
    fields = [("place", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("done", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]
    return pa.list_(pa.struct([("key", key_type), *fields]))


def _encoder(model: str, plain_special: bool, end_id: int, block_ids: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, schema, end = None, None, np.array([end_id], dtype=np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            if packer is None:
                kind = batch.schema.field("_id").type
                packer = Packer(batch.column("shard")[0].as_py(), block_ids, kind)
                schema = pa.schema([
                    ("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()),
                    ("docs", _docs_type(kind))])
            texts = batch.column("_text").to_pylist()
            found = encode_texts(texts, encoder(model, plain_special).encode)
            for key, ids in zip(batch.column("_id").to_pylist(), found):
                for row in packer.add(key, np.concatenate((ids, end))):
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
        if packer is not None and packer.filled:
            yield pa.RecordBatch.from_pylist([packer.close()], schema=schema)
    return encode


def encode_blocks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, end_id: int = END_ID,
    block_ids: int = BLOCK_IDS, plain_special: bool = False,
) -> DataFrame:
    """Blocks of all documents' ids in ascending order of the key: shard, block, first, n_ids, ids, docs."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = ["_none", "_id", "_hash", "_row"]
    # the last two split a key that many rows have
    ranked = given.withColumns({"_none": F.col("_id").isNull(), "_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    shards = ranked.repartitionByRange(*order).sortWithinPartitions(*order)
    return shards.select(F.spark_partition_id().alias("shard"), "_id", "_text").mapInArrow(
        _encoder(model or default_model(), plain_special, end_id, block_ids),
        f"shard int, block long, first long, n_ids long, ids binary, "
        f"docs array<struct<key:{kind},place:bigint,start:bigint,n_tokens:bigint,done:bigint,at:int,n:int>>")


def write_tokens(docs: DataFrame, path: str, **options) -> None:
    """Write the blocks of :func:`encode_blocks`, each shard's in order."""
    encode_blocks(docs, **options).write.parquet(path)


# --- reading ------------------------------------------------------------------------------------

def read_blocks(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    return spark.read.schema(
        f"shard int, block long, first long, n_ids long, ids binary, "
        f"docs array<struct<key:{key_type},place:bigint,start:bigint,n_tokens:bigint,done:bigint,at:int,n:int>>").parquet(path)


def _key_type(blocks: DataFrame) -> str:
    return blocks.schema["docs"].dataType.elementType["key"].dataType.simpleString()


def _pieces(values: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                ids = unpack(batch.column("ids")[number].as_py())
                docs = batch.column("docs").slice(number, 1).flatten()
                at, n, total, done = (docs.field(x).to_numpy() for x in ("at", "n", "n_tokens", "done"))
                rows = pa.array(np.full(len(docs), batch.column("shard")[number].as_py(), dtype=np.int32))
                columns = [rows, *[docs.field(x) for x in ("key", "place", "start", "n_tokens", "done")]]
                names = ["shard", "key", "place", "start", "n_tokens", "done"]
                if values:
                    # the documents of a block stand one behind the other
                    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "ids"])
                    continue
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [
                    shifted_crc(zlib.crc32(data[4 * a: 4 * (a + k)]), 4 * (t - d - k))
                    for a, k, t, d in zip(at.tolist(), n.tolist(), total.tolist(), done.tolist())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(crcs, pa.int64())], names=[*names, "crc"])
    return decode


def read_pieces(blocks: DataFrame) -> DataFrame:
    """The ids of every document, one row for each block it stands in (``done`` ids of it come before)."""
    return blocks.mapInArrow(
        _pieces(True), f"shard int, key {_key_type(blocks)}, place long, start long, n_tokens long, done long, ids array<long>")


def shard_offsets(blocks: DataFrame) -> DataFrame:
    """Ids of all shards before each one; one row for each task that wrote."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))


def document_checksums(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document's key, ``start`` among all ids, ``n_tokens`` and ``ids_crc32``, from the blocks as they are read."""
    pieces = blocks.mapInArrow(
        _pieces(False), f"shard int, key {_key_type(blocks)}, place long, start long, n_tokens long, done long, crc long")
    whole = pieces.groupBy("shard", "place").agg(
        F.first("key").alias(key), F.first("start").alias("_start"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return whole.join(F.broadcast(shard_offsets(blocks)), "shard").select(key, (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return document_checksums(read_blocks(spark, path, docs.schema["doc_id"].dataType.simpleString()))

"""Packed token ids against plain encoding, exact round trips of the block form, and checksums from pieces."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from incidentlens.llm import token_output as T
from conftest import TESTDATA


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2 ** 32 - 1)), max_size=700))
def test_block_round_trip(ids):
    assert T.unpack(T.pack(np.array(ids, dtype=np.uint32))).tolist() == ids


def test_block_form():
    zeros = T.pack(np.zeros(1000, dtype=np.uint32))
    assert len(zeros) == 16 + 8 * 5 and T.unpack(zeros).tolist() == [0] * 1000
    wide = np.array([T.ESCAPE - 1, T.ESCAPE, T.ESCAPE + 1, 2 ** 32 - 1, 0, 5], dtype=np.uint32)
    assert len(T.pack(wide)) == 16 + 8 * 2 + 4 * 3 and T.unpack(T.pack(wide)).tolist() == wide.tolist()
    assert all(count * bits <= 60 for count, bits in T.FORMS) and len(T.FORMS) <= 16
    with pytest.raises(ValueError):
        T.unpack(zeros[:-1])


@given(st.binary(max_size=300), st.binary(max_size=300), st.binary(max_size=300))
def test_checksum_of_pieces(a, b, c):
    whole = T.shifted_crc(zlib.crc32(a), len(b) + len(c)) ^ T.shifted_crc(zlib.crc32(b), len(c)) ^ zlib.crc32(c)
    assert whole == zlib.crc32(a + b + c)


def _expected(rows):
    tokenizer, start, out = T.tokenizer(T.default_model(), False), 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def _result(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_query(spark):
    sf = str(TESTDATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert _result(T.op12_token_output(spark, sf)) == _expected([(r.doc_id, r.text) for r in docs])


def test_small_blocks_and_odd_rows(spark, tmp_path):
    long = "\n".join(f"line {n} of a very long text, it's number {n}" for n in range(2000)) + "\n\n  end \n x"
    rows = [(5, "five"), (-3, None), (9, ""), (7, long), (7, "other"), (7, "other"), (2, "漢字 𝒳 é<|endoftext|>\x00 a\r\nb"), (None, "nobody"), (11, "\n" * 50), (12, " " * 70)]
    df = spark.createDataFrame([(k, t, "x", 0, 0) for k, t in rows], "doc_id long, text string, shard string, block int, start int").repartition(7)
    path = str(tmp_path / "tokens")
    T.write_tokens(df, path, block_ids=64)
    blocks = T.read_blocks(spark, path)
    assert blocks.where("n_ids > 64").isEmpty() and blocks.count() > 100
    got = _result(T.document_checksums(blocks))
    spread = spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) as h").collect()
    by_hash = {r.t: r.h for r in spread}
    want = _expected(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, by_hash[r[1] or ""])))
    assert got == want
    whole = {}
    for r in sorted(T.read_pieces(blocks).collect(), key=lambda r: r.done):
        whole.setdefault((r.shard, r.place), []).extend(r.ids)
    decoded = sorted(T.tokenizer(T.default_model(), False).decode(ids[:-1], skip_special_tokens=False) for ids in whole.values())
    assert decoded == sorted(t or "" for _, t in rows)
    T.write_tokens(df.limit(0), str(tmp_path / "none"))
    assert T.document_checksums(T.read_blocks(spark, str(tmp_path / "none"))).count() == 0


def test_texts_are_cut_where_no_token_crosses():
    rng = np.random.default_rng(1)
    tokens = ["a", "it's", " ", " ", " b", "  ", "\n", "\n\n", "\t", "é", "漢", "1", "!", "\r\n", "_", "\x85", "x\ny", "\u3000", "\u180e", "\u200b", "<|endoftext|>", "\x1c", " 's"]
    text = "".join(rng.choice(tokens, 1_200_000).tolist())
    cut = T.parts(text)
    assert len(cut) > 1 and "".join(cut) == text
    library = T.tokenizer(T.default_model(), False)
    assert [i for part in cut for i in library.encode(part).ids] == library.encode(text).ids
    texts = ["b", text, "", "c", " lead", "trail ", " ", "  ", *["".join(rng.choice(tokens, rng.integers(1, 30)).tolist()) for _ in range(3000)]]
    own = T.Encoder(T.default_model(), False)
    for _ in range(2):
        for found, want in zip(T.encode_texts(texts, own.encode), texts, strict=True):
            assert found.tolist() == library.encode(want, add_special_tokens=False).ids


def test_known_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "KNOWN", 50)
    own, library = T.Encoder(T.default_model(), False), T.tokenizer(T.default_model(), False)
    for n in range(20):
        texts = [f"word{n} and other{n + k} words" for k in range(8)]
        assert [x.tolist() for x in own.encode(texts)] == [library.encode(t).ids for t in texts]
        assert len(own.behind_space) <= 50 and len(own.behind_space.old) <= 50

"""The trie of conversations against SQL and against a dictionary of all prefixes, with small blocks and hot nodes."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np

from incidentlens.llm import prefix_trie as T
from compare import differences
from conftest import TESTDATA

SF = str(TESTDATA / "sf0.001")
SCHEMA = "conv_id long, turn int, role string, text string, seq string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def _brute(rows, shared):
    turns = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    if shared:
        own = dict(told)
        for c in own:
            h = zlib.crc32(str(c).encode()) % 4
            told[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in told.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        ends = sorted(c for c in convs if len(told[c]) == len(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * _words(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def _rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[1], r[0]))


def test_query_equals_sql(spark):
    assert differences(T.op11_prefix_trie(spark, SF), SF, T.ORACLE) == []


def test_small_blocks_hot_nodes_and_odd_rows(spark):
    """A third of the conversations are copies, another third begin alike; blocks hold a few rows only."""
    rng = np.random.default_rng(5)
    rows = []
    for c in range(240):
        if c % 3 == 0:
            rows += [(c, t, "user", f"the same turn {t}", "x") for t in range(3)]
        elif c % 3 == 1:
            rows += [(c, 0, "user", "a first turn of all", "x")] + [(c, t, "bot", f"w{rng.integers(3)} " * int(rng.integers(1, 4)), "x") for t in range(1, int(rng.integers(2, 7)))]
        else:
            rows += [(c, t, "user", f"say {rng.integers(2)}", "x") for t in range(int(rng.integers(1, 5)))]
    rows += [(500, None, None, None, "x"), (500, None, "a", "", "x"), (500, 1, "", "b\x0bc\td", "x"), (501, 0, "us", "er", "x"), (502, 0, "use", "r", "x")]
    rows += [(-7, 2, "user", "é 漢字 𝒳", "x"), (-7, 2, "user", "é 漢字 𝒳", "x"), (None, 0, "user", "nobody", "x"), (600, 0, "user", "say 1", None)]
    rows += [(700, t, "user", f"long {t}", "x") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for shared in (False, True):
        want = _brute(rows, shared)
        assert _rows(T.conversation_trie(df, shared=shared, cells=7, chunk_ids=2)) == want
        assert _rows(T.conversation_trie(df, shared=shared)) == want


def test_turnless_and_empty(spark):
    df = spark.createDataFrame([(41, 0, "u", "one", "x")], SCHEMA)
    assert zlib.crc32(b"41") % 4 and _rows(T.conversation_trie(df, shared=True)) == [(41, 0, None, 1, 0, 1, 0, hashlib.sha256(b"41").hexdigest())]
    assert T.conversation_trie(df.limit(0)).count() == 0

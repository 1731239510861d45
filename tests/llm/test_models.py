"""Toxicity, decontamination, piece sampling and the pipeline against brute force and held-out rows."""

import os
import subprocess
import sys
from collections import Counter
from itertools import combinations
from math import exp, sqrt
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from incidentlens.llm import decontaminate as B
from incidentlens.llm import pieces as S
from incidentlens.llm import toxicity as T
from conftest import TESTDATA

ROOT = Path(__file__).resolve().parents[2]
SF1, SF2 = str(TESTDATA / "sf0.001"), str(TESTDATA / "sf0.01")


def _kernel(a, b):
    total = 0.0
    for x in combinations(range(len(a)), T.LETTERS):
        for y in combinations(range(len(b)), T.LETTERS):
            if all(a[i] == b[j] for i, j in zip(x, y)):
                total += T.DECAY ** (x[-1] - x[0] + 1 + y[-1] - y[0] + 1)
    return total


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_kernel_equals_enumeration():
    units, marks = ["idiots", "id.iots", "aaaa", "aaaaaa", "xyz", "tidiotis", "édiots", "i-d-i-o-t-s"], ["idiots", "stupid", "aaaaa", "éîdiots"]
    got = T.Landmarks(marks).kernels(units)
    for n, u in enumerate(units):
        for m, t in enumerate(marks):
            own = _kernel(u, u) * _kernel(t, t)
            value = _kernel(u, t) / sqrt(own) if own else 0.0
            common = _common(u, t)
            assert got[n, m] == pytest.approx(value if common >= T.COMMON * len(t) else 0.0, rel=1e-4, abs=1e-6), (u, t)


def test_broken_up_insults():
    rng = np.random.default_rng(1)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "tion", "ing"]
    prose = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60))
    clean = [prose() for _ in range(120)]
    toxic = [prose() + " " + ("moron", "pathetic", "worthless")[i % 3] + " " + prose() for i in range(60)]
    model = T.train(toxic, clean)
    for text in ("a MORON!!", "m-o-r-o-n", "patheetic", "p a t h e t i c", "wor.thl.ess", "_w o r t h l e s s_ worthlesss"):
        assert model.score_texts([prose() + " " + text + " " + prose()], {})[0] > T.CUT, text
    scores = model.score_texts(["", None, *clean], {})
    assert (scores < T.CUT).all()
    assert (model.score_texts([prose() for _ in range(100)], {}) < T.CUT).mean() > 0.97


_TRAIN = """
import hashlib, random
from incidentlens.llm import toxicity as T
rng = random.Random(3)
prose = lambda: " ".join("".join(rng.choice("th er on an re he in ed nd ha tion ing".split()) for _ in range(rng.randrange(1, 4))) for _ in range(40))
toxic = [prose() + " " + rng.choice("moron pathetic worthless scum clown".split()) + " " + prose() for _ in range(60)]
model = T.train(toxic, [prose() for _ in range(120)])
scores = model.score_texts([prose() for _ in range(50)] + toxic, {})
print(model.landmarks.texts, hashlib.sha256(scores.tobytes()).hexdigest())
"""


def test_same_model_for_any_hash_seed():
    seen = set()
    for seed in ("1", "2", "77"):
        env = dict(os.environ, PYTHONHASHSEED=seed, PYTHONPATH=str(ROOT))
        seen.add(subprocess.run([sys.executable, "-c", _TRAIN], env=env, capture_output=True, text=True, check=True).stdout)
    assert len(seen) == 1 and all(f"{w}{T.END}" in next(iter(seen)).encode().decode("unicode_escape") for w in ("moron", "scum", "clown"))


def test_every_insult_of_the_sample_gets_a_landmark():
    # texts hold several insults each: covering the texts once would need only the first of them
    words = ["moron", "pathetic", "worthless", "clown", "disgusting"]
    toxic = [[w for n, w in enumerate(words) if n == 0 or (i >> n) & 1] for i in range(64)]
    chosen = T.choose_landmarks(toxic, [["plain", "words"]] * 64)
    assert all(any(w in c or c.strip(T.START + T.END) in w for c in chosen) for w in words)


def test_toxicity_query_on_held_out_rows(spark):
    sf = str(TESTDATA / "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = T.op5_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    true = sum(s >= 0.3 and y for s, y in held)
    assert true / sum(s >= 0.3 for s, _ in held) > 0.85
    assert true / sum(y for _, y in held) > 0.85


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate([None, "", "moron", "x" * 100_000])] + [(None, "a", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = T.train_on(docs, labels)
    assert [r.score for r in T.score_documents(docs, model).collect()] == [0.0] * 5
    assert T.train_on(docs.limit(0), labels.limit(0)).landmarks is None
    assert T.without_toxic(docs, model).columns == docs.columns and T.score_documents(docs.limit(0), model).count() == 0


def _bm25(index_items, statistics, words):
    """Scores of all items for one passage, without index and pruning."""
    from math import log
    held, out = set(words), {}
    for item, text in index_items:
        counts = Counter(B.words_of(text))
        n = sum(counts.values())
        weight = {
            w: log(1 + (statistics.items - statistics.frequency[w] + .5) / (statistics.frequency[w] + .5)) * c * (B.K1 + 1)
            / (c + B.K1 * (1 - B.B + B.B * n / statistics.mean_words)) for w, c in counts.items()}
        if n:
            out[item] = sum(x for w, x in weight.items() if w in held) / sum(weight.values())
    return out


def test_block_max_wand_equals_all_scores():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 30))) + " the of" + " and" * (i % 2)) for i in range(700)]
    lengths = [len(B.words_of(t)) for _, t in items]
    frequency = Counter(w for _, t in items for w in set(B.words_of(t)))
    statistics = B.Statistics(len(items), sum(lengths) / len(items), frequency)
    index = B.Index(items, statistics, lowest=0.3)
    assert index.frequent and index.frequent_most <= 0.15
    for n in range(60):
        words = [*rng.choice(vocabulary, 60), "the", "and"]
        threshold = (0.3, 0.4, 0.6)[n % 3]
        want = {i: s for i, s in _bm25(items, statistics, words).items() if s >= threshold - 1e-9}
        got = dict(index.search(sorted({index.term[w] for w in words if w in index.term}), threshold))
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_decontamination_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF2}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in B.op2_decontaminate(spark, SF2).collect()}
    lowered = {d: " ".join(B.words_of(t)) for d, t in docs.items()}
    exact = {(d, i) for i, t in items for d, x in lowered.items() if " ".join(B.words_of(t)) in x}
    assert exact <= found
    for d, i in found - exact:  # what is no exact copy still holds most of the question in order
        question, _ = B.question_and_answer(dict(items)[i])
        assert _common(question, B.words_of(docs[d])) >= 0.75 * len(question)


def test_decontamination_does_not_depend_on_other_items(spark):
    """One very long item neither lets a short item's scattered words match nor changes a match's score."""
    item = "Which river runs through the old town of Bern and under its bridges? It is the river Aare in fact."
    words = B.words_of(item)
    scattered = " ".join(w + " filler" * 40 for w in words)
    docs = spark.createDataFrame([(1, scattered), (2, "x " * 500 + item + " y" * 500), (3, "x " * 31 + item)], "doc_id long, text string")
    long = " ".join(f"word{n % 7919}" for n in range(20_000))
    short = [(10, item), (11, "Some quite different question about nothing? The answer is none.")]

    def found(items):
        rows = B.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        return {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap, r.first_word) for r in rows}

    alone, both = found(short), found(short + [(12, long)])
    assert set(alone) == {(2, 10), (3, 10)} and alone == both


def test_decontamination_edges(spark):
    item = "Which river runs through the old town of Bern and under its bridges? It is the river Aare in fact."
    rows = [(1, item), (2, "x " * 5000 + item + " y" * 5000), (3, None), (4, ""), (5, item.replace("old", "new")), (6, item[:60]), (7, "the of " * 50_000), (1, item), (None, item.upper())]
    docs = spark.createDataFrame([(i, t, 0, 0.0) for i, t in rows], "doc_id long, text string, item_id int, score double")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "..."), (14, "A short one with few words here")], "item_id long, text string")
    got = B.find_leaks(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 10), ("2", 10), ("5", 10), ("None", 10)]
    kept = B.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]
    assert B.find_leaks(docs, items.limit(0)).count() == 0 and B.find_leaks(docs.limit(0), items).count() == 0
    assert len(B.build_shards(items, "item_id", "text", shard_chars=40)) > 1


def test_decontamination_in_many_shards_equals_one(spark):
    """Statistics, finds and kept documents do not depend on the number of shards; textual ids and repeated items are allowed."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    bench = spark.read.parquet(f"{SF2}/benchmark.parquet").selectExpr("concat('i', item_id) AS item_id", "text")
    items = bench.unionByName(bench.limit(20))
    chars = sum(len(r.text) for r in bench.collect())
    shards = B.build_shards(items, "item_id", "text", shard_chars=chars // 3)
    assert len(shards) > 2 and shards.items == bench.count()
    assert sorted(i for shard in shards for index in shard for i in index.ids) == sorted(r.item_id for r in bench.collect())
    one = {tuple(r) for r in B.find_leaks(docs, bench).collect()}
    assert one and {tuple(r) for r in B.find_leaks(docs, items, shard_chars=chars // 3).collect()} == one
    kept = B.without_leaks(docs, items, shard_chars=chars // 3)
    assert kept.schema.names == docs.schema.names
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in B.without_leaks(docs, bench).collect())
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {r[0] for r in one}


@pytest.fixture(scope="module")
def pieces():
    return S.vocabulary(S.MODEL, S.EXPONENT, S.ALPHA)


def _paths(text, known, price):
    """All segmentations of a short segment with their probabilities (not summing to 1)."""
    if not text:
        return {(): 1.0}
    out = {}
    for size in range(1, len(text) + 1):
        if text[:size] in known:
            for rest, p in _paths(text[size:], known, price).items():
                out[(known[text[:size]][0], *rest)] = out.get((known[text[:size]][0], *rest), 0) + exp(known[text[:size]][1]) * p
    return out


def test_sampling_follows_path_probabilities(pieces):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    ids = {int(n): m for m, n in enumerate(pieces.ids)}
    known = {model.id_to_piece(n): (n, pieces.log[m]) for n, m in ids.items()}
    paths = _paths("▁hello", known, pieces.byte_log)
    total = sum(paths.values())
    n = 40_000
    out, counts = S.encode_texts(["hello"] * n, np.arange(n, dtype=np.uint64) * np.uint64(977), pieces)
    stops = np.cumsum(counts)
    seen = Counter(tuple(out[a:b]) for a, b in zip(stops - counts, stops))
    assert set(seen) <= set(paths)
    for path, p in paths.items():
        assert abs(seen[path] / n - p / total) < 4 * sqrt(p / total / n) + 1e-4


def test_every_piece_keeps_marks_in_front(pieces):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert not [p for n in range(model.get_piece_size()) if "▁" in (p := model.id_to_piece(n)).lstrip("▁")]


def test_piece_round_trip_and_edges(spark):
    texts = [None, "", " ", "  a  ", "▁", "a▁b ▁", "tab\tnew\nline\r", "𝒳 é\u0000 �", "x" * 50_000, "word " * 30_000, "a b", " ▁ ", "end "]
    rows = [(i, t, [1], True) for i, t in enumerate(texts)] + [(None, "null key", None, None), (1, "", [0], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces array<int>, lossless boolean")
    encoded = S.encode_documents(df, check=True)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    back = {r.doc_id: r.text for r in S.decode_documents(encoded).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}
    again = S.encode_documents(df.repartition(5), check=False).collect()
    assert Counter((r.doc_id, tuple(r.pieces)) for r in again) == Counter((r.doc_id, tuple(r.pieces)) for r in got)
    other = {r.doc_id: r.pieces for r in S.encode_documents(df, seed=2).collect()}
    assert other[9] != next(r.pieces for r in got if r.doc_id == 9)
    assert S.encode_documents(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Every stage against a plain decision on its own input."""
    from test_near_lines import _components

    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF1)
        before = {r.doc_id: r.text for r in docs.collect()}
        if name != "pieces":
            assert out.columns == columns
        rows = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in T.op5_toxicity(spark, SF1).collect()}
            assert set(rows) == {d for d, p in scores.items() if not p}
        elif name == "near-duplicates":
            ids = sorted(before)
            labels, _ = _components([before[i] for i in ids])
            assert set(rows) == {ids[n] for n in set(labels)}
        elif name == "decontamination":
            items = spark.read.parquet(f"{SF1}/benchmark.parquet")
            assert set(rows) == set(before) - {r.doc_id for r in B.find_leaks(docs, items).collect()}
        elif name == "secrets":
            gone = set(before) - set(rows)
            assert all("token" in before[d] or "AKIA" in before[d] for d in gone)
            assert not [d for d in rows if 'token = "' in (before[d] or "")]
        else:
            assert set(rows) == set(before) and all(r.lossless for r in rows.values())
        docs = out
    assert corpus_pipeline.run(spark, SF1).count() == len(rows)

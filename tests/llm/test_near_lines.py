"""MinHash components and line dedup against SQL, and their defined edge cases."""

import numpy as np

from incidentlens.llm import line_dedup as D
from incidentlens.llm import minhash as M
from incidentlens.llm.graph import components
from incidentlens.llm.shingles import shingle_sets
from compare import differences
from conftest import TESTDATA

SF = str(TESTDATA / "sf0.001")


def test_minhash_query_equals_sql(spark):
    assert differences(M.op4_minhash(spark, SF), SF, M.ORACLE) == []


def test_line_query_equals_sql(spark):
    assert differences(D.op10_line_dedup(spark, SF), SF, D.ORACLE) == []


def _set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _components(texts):
    sets = [_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * 100 >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_minhash_edges_and_hot_group(spark):
    """Copies, a chain, many near copies of one text, texts that share a passage, short, empty and odd texts."""
    rng = np.random.default_rng(7)
    word = lambda: "w%05d" % rng.integers(100_000)
    base = [word() for _ in range(120)]
    texts = [None, "", " \n\t", "one", "One", "one two three four", "one two three four five", "ONE two\x0bthree\ffour", "É a b c d", "é a b c d", "a\xa0b c d e f"]
    texts += [" ".join(base)] * 4
    for n in range(60):
        near = list(base)
        for at in rng.choice(120, n % 9, replace=False):
            near[at] = word()
        texts.append(" ".join(near))
    for step in range(12):
        texts.append(" ".join(base[step * 4:] + ["z%d" % i for i in range(step * 4)]))
    texts += [" ".join(base[:60] + [word() for _ in range(70)]) for _ in range(25)]
    texts.append(" ".join(word() for _ in range(60_000)))
    want, sizes = _components(texts)
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, n long")
    got = {r.doc_id: r for r in M.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    kept = sorted(r.doc_id for r in M.keep_one_of_each(df).collect())
    assert kept == sorted(set(want))
    assert M.keep_one_of_each(df).columns == df.columns
    odd = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in M.near_duplicates(odd).collect()) == [
        ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None"), ("None", "None")]
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[500:])
    s = M.signature([a, b], 1024)
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05


def test_shingles_of_pieces_equal_sets():
    texts = ["a b c d e f", None, "x", "a b c d e f", "A B C D E F g"] * 50
    sets = [s for part in shingle_sets(texts) for s in part]
    assert [len(s) for s in sets] == [len(_set(t)) for t in texts]
    assert np.array_equal(sets[0], sets[3]) and set(sets[0]) < set(sets[4])


def test_components_of_a_chain(spark):
    links = spark.range(1, 200).selectExpr("id as a", "id + 1 as b")
    assert components(links).where("component <> 1").count() == 0
    assert components(links.limit(0)).count() == 0


def by_id(rows, key):
    return next(r for r in rows if r.doc_id == key)


def test_short_and_unspaced_lines_and_hot_line(spark):
    """A third of the documents share a line; lines without spaces and of one letter are units like others."""
    rows = [(i, f"own {i}\nshared by many\n漢字かな交じり文を繰り返す\n|\n\nend {i}" if i % 3 == 0 else f"own {i}\n|") for i in range(300)]
    got = {r.doc_id: r.text for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == (f"own {i}\nend {i}" if i % 3 == 0 else f"own {i}") for i in range(1, 300))


def test_paragraph_units(spark):
    """Paragraphs wrapped in different ways are copies; breaks of what is left stay as they were."""
    rows = [(1, "a b\nc d\n\nkeep\none"), (2, "first\n \t\na B c\n d \n\n\n\nlast"), (3, "a b c d"), (4, "\n\n"), (5, None), (6, "keep one\n\n x"), (7, "x\n\nx")]
    got = {r.doc_id: r for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), unit="paragraph").collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "first\n\n\n\nlast", 3: "", 4: "\n\n", 5: "", 6: " x", 7: ""}
    assert [tuple(s) for s in got[2].spans] == [(9, 18)] and got[2].kept_doc_ids == [1] and got[7].kept_doc_ids == [6, 6]


def test_line_edges(spark):
    long = "these are certainly more than eight words in one line"
    rows = [
        (3, f"intro\n{long}\nend"), (1, f"{long}\nhi"), (2, f"hi\n\n{long.upper()}  \nhi\nother"), (4, None), (5, ""), (6, "hi"), (None, long),
        (7, "a b c\nd e f\n\ng h i\nx"), (8, "y\na b c\nd e f\n\ng h i"), (9, f"{long}𝒳\n{long}𝒳"), (10, f"{long}\n" * 2000), (11, f"w\n{long}"), (11, f"w\n{long}"),
    ]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, spans string, place int")
    got = sorted(D.dedup_lines(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, len(r.spans)))
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    assert text[1] == f"{long}\nhi" and text[3] == "intro\nend" and text[4] == text[5] == "" and text[6] == text[None] == ""
    assert text[2] == "other"  # empty lines go with the removed line before them
    assert all(r.n_chars == len(r.text) for r in got) and by_id(got, 2).n_chars_before == len(rows[2][1])
    assert text[7] == "a b c\nd e f\n\ng h i\nx" and text[8] == "y" and text[9] == f"{long}𝒳" and text[10] == ""
    by = {r.doc_id: r for r in got}
    assert [tuple(s) for s in by[3].spans] == [(6, 6 + len(long))] and by[3].kept_doc_ids == [1]
    assert [r.text for r in got if r.doc_id == 11] == ["w", ""]
    assert D.dedup_lines(df.limit(0)).count() == 0

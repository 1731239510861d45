"""License scan and fingerprints against brute force, and their defined edge cases."""

import hashlib
import math
import re

from incidentlens.llm import fingerprints as P
from incidentlens.llm import licenses as L
from conftest import TESTDATA

SF = str(TESTDATA / "sf0.001")


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _license(text):
    words, found = _words(text), []
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    own, best = set(), 0.0
    for paragraph in re.split(r"\n[ \t\x0b\x0c\r]*(?=\n)", text or ""):
        here = _words(paragraph)
        for label, want in L.template_sets(L.TEMPLATES).items():
            span, known = 2 * len(L.spaced_words(L.TEMPLATES[label])), set(want)
            for i, word in enumerate(here):
                share = len(known.intersection(here[i:i + span])) / len(want) if word in known else 0
                if share >= L.THRESHOLD - 1e-9:
                    own.add(label)
                    best = max(best, share)
    at = [i for i, _ in found]
    base = {x for _, x in found}
    return (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | own)), 1.0 if found else best)


def _compare(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == (
            *_license(texts[r.doc_id])[:6], round(_license(texts[r.doc_id])[6], 9)), r.doc_id


def test_license_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _compare(L.op7_license_scan(spark, SF).collect(), docs)


def test_license_edges(spark, tmp_path):
    notice = L.TEMPLATES["mit-text"]
    texts = [
        None, "", "...", "CC BY cc-by (cc) by", "cc by cc by", "Kcc by É CC BY cc BY", "all rights\nreserved",
        "the a of " * 40_000 + "GNU General Public License", notice.replace("charge", "cost"), notice, " ".join(reversed(notice.split())),
        "Licensed under CC BY-SA 4.0.\nAll Rights Reserved", "İ all rights reserved", notice[: len(notice) // 2], "KKall rights reserved",
    ]
    rows = [(i, t, 1, "x", [0]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, label string, places array<int>")
    (tmp_path / "t").mkdir()
    docs.write.parquet(str(tmp_path / "t" / "documents.parquet"))
    _compare(L.op7_license_scan(spark, str(tmp_path / "t")).collect(), dict(enumerate(texts)))
    twice = docs.union(docs.limit(4)).selectExpr("cast(null as long) doc_id", "text")
    assert L.scan_licenses(twice).count() == len(texts) + 4
    assert L.scan_licenses(docs.limit(0)).count() == 0


def test_wrapped_notices(spark):
    """Notices as published, wrapped over lines, have their labels; words of two paragraphs do not meet."""
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction")
    bsd = ("Redistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions are met:")
    gpl = ("    This program is free software: you can redistribute it and/or modify\r\n    it under the terms of the GNU General Public License as published by\r\n"
           "    the Free Software Foundation")
    texts = [mit, "x y z\n" * 30 + mit.replace(" ", "  "), f"Copyright\n\n{bsd}\n\nmore", gpl, "one " * 500 + "\n\n" + mit.replace(" ", "\n"), bsd.replace("\n", "\n \n")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {b.label for b in r.blocks} for r in L.scan_licenses(df).collect()}
    assert got == {0: {"mit-text"}, 1: {"mit-text"}, 2: {"bsd"}, 3: {"gpl-notice"}, 4: {"mit-text"}, 5: set()}


def test_scattered_words_make_no_block(spark):
    """Template words spread over a long line are no notice; inside twice the notice's length they are, also far into a long line."""
    words = "licensed under CC BY 4.0".replace(".", " ").split()
    scattered = " ".join(f"{w} {'filler ' * 20}" for w in words)
    near = " ".join(f"{w} filler" for w in words)
    tail = "filler " * 1000 + near + " filler" * 1000
    df = spark.createDataFrame([(0, scattered), (1, near), (2, tail), (3, "cc " * 3000 + near), (4, scattered.replace(" ", "\n"))], "doc_id long, text string")
    got = {r.doc_id: {(b.label, b.at) for b in r.blocks} for r in L.scan_licenses(df).collect()}
    assert got[0] == got[4] == set() and got[1] == {("cc-by-4.0", 0)} and got[2] == {("cc-by-4.0", 1000)}
    assert {label for label, _ in got[3]} == {"cc-by-4.0"}


def _signs(text):
    if text == "":
        return frozenset()
    words = _words(" " + text.lower())
    content = [w not in set(P.ANCHORS) for w in words]
    chains = set()
    for start in range(len(words)):
        if not content[start]:
            chain = [w for w, c in zip(words[start + 1:], content[start + 1:]) if c][: P.CHAIN]
            if chain and content[start + 1]:
                chains.add(" ".join(chain))
    if not chains:
        content_words = [w for w, c in zip(words, content) if c]
        chains = {" ".join(content_words[i:i + P.CHAIN]) for i in range(len(content_words))}
    return frozenset(chains or {text})


def _jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def _check_prints(rows, docs):
    order = sorted(docs, reverse=True)
    following = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    texts = {d: docs[d] or "" for d in docs}
    prints = {}
    assert len(rows) == len(docs)
    for r in rows:
        text, nxt = texts[r.doc_id], texts[following[r.doc_id]]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r.near_edited, _jaccard(_signs(text), _signs(edited)), abs_tol=1e-9), (r.doc_id, text[:80])
        assert math.isclose(r.near_next, _jaccard(_signs(text), _signs(nxt)), abs_tol=1e-9)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == 8 * len(_signs(text))


def test_fingerprint_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _check_prints(P.op3_fingerprints(spark, SF).collect(), docs)


def test_fingerprint_edges(spark, tmp_path):
    texts = [None, "", "x", "the", "the of", "!!!", "one two three", "𝒳𝒴 the 𝒵 a b", "the cat " * 9000, "cat of the dog and bird", "!!!"]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs.items()], "doc_id long, text string, _id string, _chars int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    _check_prints(P.op3_fingerprints(spark, str(tmp_path)).collect(), docs)
    assert P.edited_pairs(df.union(df.limit(3)).unionByName(df.limit(2).selectExpr("cast(null as long) doc_id", "text", "_id", "_chars"))).count() == 16
    assert P.edited_pairs(df.limit(1)).count() == 1
    assert P.edited_pairs(df.limit(0)).count() == 0


def test_similar_documents(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = {}
    for r in docs:
        sets.setdefault(_signs(r.text or ""), []).append(r.doc_id)
    reps = [(min(ids), s) for s, ids in sets.items() if s]
    want = {frozenset((i, j)) for i, a in reps for j, b in reps if i < j and _jaccard(a, b) >= P.SIMILARITY}
    got = P.similar_documents(spark.createDataFrame(docs)).collect()
    assert {frozenset((r.id_a, r.id_b)) for r in got} == want and len(got) == len(want)

"""License scans: phrases at word positions, and an exact set-similarity join of text blocks with licence templates.

A text block is a run of words inside one paragraph (what stands between empty lines, however it is wrapped), for a template of ``m``
words one of ``2 * m`` words. So words that are scattered over a long line make no block together.

The method: every text block and every template is a set of words, ordered by how rare a word is in the whole
corpus (ties by the word). A block meets a template when it holds at least ``threshold`` of the template's words. A
template of ``n`` words needs ``need = ceil(threshold * n)`` common words, so any fitting block holds one of its
``n - need + 1`` rarest words (prefix filter): only the surroundings of such words are looked at, the other texts are
left after one pass over their words. There must be at least ``need`` template words around it (length filter), and behind
the first common word in the order enough must remain on both sides (positional filter). What is left is counted in full, block by block.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are judged row by row and
all returned; an empty table gives an empty result; of a very long text only the surroundings of rare words are kept,
at most three times its words. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm.common import lower_ascii, materialize, read_table, values_table

#: What separates words, and the phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence notices and the label of each.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "all-rights-reserved": "All rights reserved",
}
#: Share of a template's words that a block must hold. High enough to tell the short notices apart.
THRESHOLD = 0.9


def template_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct words of each template, by the same rule that cuts the texts."""
    return {label: sorted(set(spaced_words(text))) for label, text in templates.items()}


def spaced_words(text: str) -> list[str]:
    """The words of a fixed text in order, A-Z lower-cased."""
    cut = "".join(c if (c.isascii() and c.isalnum()) or not c.isascii() else " " for c in text)
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in cut.split(" ") if w]


def spaced(text: Column) -> Column:
    """Words with one space between them, in their own case."""
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def places(words: Column, phrase: list[str]) -> Column:
    """Every start (from 0) at which the phrase's words stand consecutively."""
    shifted = [(words if n == 0 else F.slice(words, n + 1, 1 << 30)).alias(f"w{n}") for n in range(len(phrase))]

    def fits(x: Column) -> Column:
        same = F.lit(True)
        for n, word in enumerate(phrase):
            same = same & F.coalesce(x[f"w{n}"] == word, F.lit(False))
        return same

    marked = F.transform(F.arrays_zip(*shifted), lambda x, at: F.when(fits(x), at))
    return F.filter(marked, lambda at: at.isNotNull())


def phrase_places(spaced_text: Column, phrases: dict[str, str]) -> Column:
    """Label and start of every place of every phrase; words are cut only for texts that hold the phrase's text."""
    none = F.array().cast("array<struct<label:string,at:int>>")
    lowered = lower_ascii(spaced_text)
    found = [
        F.when(
            F.contains(F.lower(spaced_text), F.lit(phrase)),
            F.transform(places(F.split(lowered, " "), phrase.split(" ")), lambda at: F.struct(F.lit(label).alias("label"), at.alias("at"))),
        ).otherwise(none)
        for phrase, label in phrases.items()
    ]
    return F.concat(*found)


def word_frequency(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word stands in the corpus; as many rows as the templates have words."""
    words = docs.select(F.explode(F.split(lower_ascii(spaced(F.col(text))), " ")).alias("word"))
    return {r["word"]: r["n"] for r in words.where(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count("*").alias("n")).collect()}


def surroundings(paragraphs: Column, rare: list[str], length: int) -> Column:
    """Paragraph, first place and words of every stretch of ``3 * length`` words whose middle third holds a rare word."""
    def of_paragraph(words: Column, number: Column) -> Column:
        thirds = F.array_distinct(F.filter(
            F.transform(words, lambda w, at: F.when(w.isin(rare), F.floor(at / length).cast("int"))), lambda third: third.isNotNull()))
        return F.transform(thirds, lambda third: F.struct(
            number.alias("paragraph"), F.greatest((third - 1) * length, F.lit(0)).alias("base"),
            F.slice(words, F.greatest((third - 1) * length, F.lit(0)) + 1, F.when(third == 0, 2 * length).otherwise(3 * length)).alias("words")))

    return F.flatten(F.transform(paragraphs, of_paragraph))


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """Key, ``n_words``, ``places`` (label, at) of the phrases and ``blocks`` (label, paragraph, at, share) of the templates: the best
    block around each rare word, and the place of its first template word in the paragraph."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    sets = template_sets(templates)
    vocabulary = sorted({w for words in sets.values() for w in words})
    frequency = word_frequency(docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text", vocabulary)
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: n for n, w in enumerate(order)}
    prefixes = []
    for label, words in sets.items():
        ranks, need = sorted(rank[w] for w in words), math.ceil(threshold * len(words) - 1e-9)
        shape = {"label": label, "need": need, "all": ranks, "size": len(ranks), "span": 2 * len(spaced_words(templates[label]))}
        prefixes += [{"token": r, "place": i, **shape} for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    rare = sorted({order[p["token"]] for p in prefixes})
    longest = max(p["span"] for p in prefixes)
    to_rank = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).withColumn("_spaced", spaced(F.col("_text"))).withColumn("_words", F.split(lower_ascii(F.col("_spaced")), " "))
    own = F.transform(F.split("_text", r"\n[\x20\t\x0B\x0C\r]*(?=\n)"), lambda p: F.split(lower_ascii(spaced(p)), " "))
    cut = rows.withColumn("_paragraphs", F.when(F.exists("_words", lambda w: w.isin(rare)), own))
    none = F.array().cast("array<struct<paragraph:int,base:int,words:array<string>>>")
    held = materialize(cut.select(
        "_row", "_key", F.when(F.col("_spaced") == "", 0).otherwise(F.size("_words")).cast("long").alias("n_words"),
        phrase_places(F.col("_spaced"), phrases).alias("places"),
        F.coalesce(surroundings(F.col("_paragraphs"), rare, longest), none).alias("_near"),
    ))
    near = held.where(F.size("_near") > 0).select("_row", F.inline("_near"))
    tokens = F.filter(F.transform("words", lambda w, at: F.when(
        w.isin(vocabulary), F.struct((F.col("base") + at).alias("at"), F.element_at(to_rank, w).alias("rank")))), lambda t: t.isNotNull())
    known = near.select("_row", "paragraph", tokens.alias("tokens")).withColumn(
        "ranks", F.array_sort(F.array_distinct(F.transform("tokens", lambda t: t["rank"]))))
    probes = known.select("_row", "paragraph", "tokens", "ranks", F.posexplode("ranks").alias("at", "token"))
    wanted = values_table(docs.sparkSession, prefixes)
    candidates = probes.join(F.broadcast(wanted), "token").where(  # as many rows as the given templates have prefix words
        (F.size("ranks") >= F.col("need")) & (F.least(F.size("ranks") - F.col("at"), F.col("size") - F.col("place")) >= F.col("need")))
    mine = candidates.select(
        "_row", "paragraph", "label", "need", "size", "span", F.filter("tokens", lambda t: F.array_contains(F.col("all"), t["rank"])).alias("mine"))
    best = F.array_max(F.transform("mine", lambda s: F.struct(
        F.size(F.array_distinct(F.transform(
            F.filter("mine", lambda t: t["at"].between(s["at"], s["at"] + F.col("span") - 1)), lambda t: t["rank"]))).alias("n"),
        (-s["at"]).alias("at"))))
    hits = (
        mine.withColumn("best", best).where(F.col("best.n") >= F.col("need")).groupBy("_row")
        .agg(F.sort_array(F.collect_set(F.struct(
            "label", "paragraph", (-F.col("best.at")).alias("at"), (F.col("best.n") / F.col("size")).alias("share")))).alias("blocks"))
    )
    no_blocks = F.array().cast("array<struct<label:string,paragraph:int,at:int,share:double>>")
    return held.drop("_near").withColumnRenamed("_key", key).join(hits, "_row", "left").select(
        key, "n_words", "places", F.coalesce("blocks", no_blocks).alias("blocks"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels, and the template labels. The score is the best share of a template, and 1 with a phrase."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["at"].cast("long"))
    base, own = F.transform("places", lambda p: p["label"]), F.transform("blocks", lambda b: b["label"])

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))).alias("score"),
    )

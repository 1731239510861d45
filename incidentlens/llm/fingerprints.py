r"""Document fingerprints: SpotSigs, chains of content words that follow common-word anchors.

A common word (anchor) is followed by a chain of the next ``CHAIN`` words that are no common words; the chain's hash is
one signature, and the set of them is the fingerprint. Texts in which no anchor is followed by a word (tables, lists of
names) take a chain from every word, a single word is its own signature, and a text without any word
character has one signature of the text itself. So only the empty text has the empty fingerprint, and equal texts have equal ones.

Two fingerprints are compared by Jaccard similarity of their sets. ``similar_documents`` partitions documents by set
length so that only neighbouring partitions can meet, looks candidates up by the signatures of a prefix, and
prunes by length and position before it counts.

Defined results: null texts are empty; two empty fingerprints have likeness 1, an empty and another one 0. Documents are ordered by
descending id (null last), rows of one id by their text's hash; repeated rows are all returned, and rows that
agree in id and text share their neighbour, which is the next row that differs from them (of a table of
one distinct row: that row). An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize, read_table
from incidentlens.operators.ranking import number_rows

#: Content words of a chain.
CHAIN = 2
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from had has he in is it not of on or that the this to was were which with "
    "au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui se sur un une "
    "als auch auf aus bei das dem den der die ein eine einen er es für im ist mit nicht sich sie sind und von zu "
    "al como con del el lo los las más no para pero por su una y"
).split()
#: Share of the larger set's length that the smaller one must have to be compared at all.
SIMILARITY = 0.75


def _any_of(words: list[str]) -> str:
    """A pattern of the words by shared beginnings, so that a text word is tried against one branch only."""
    branches: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        branches.setdefault(word[:1], []).append(word[1:])
    ends = "" in branches
    inner = "|".join(c + _any_of(rest) for c, rest in branches.items() if c)
    return "" if not inner else f"(?:{inner})" + ("?+" if ends else "")


def with_signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add the sorted distinct signatures (32-bit hashes) of a text column.

    Every step is a column of its own, so that no step is computed twice.
    """
    word = "[^ \x01]+"
    chain = f"( {word}(?:\x01* {word}){{0,{CHAIN - 1}}})"
    spaced = F.concat(F.regexp_replace(F.concat(F.lit(" "), F.lower(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    spots = F.regexp_extract_all(F.col("_marked"), F.lit(f"\x01(?={chain})"), F.lit(1))
    every = F.regexp_extract_all(F.col("_marked"), F.lit(f"(?={chain})"), F.lit(1))
    hashed = F.transform("_found", lambda s: F.hash(F.replace(s, F.lit("\x01"), F.lit(""))))
    return (
        rows.withColumn("_marked", F.regexp_replace(spaced, f" {_any_of(ANCHORS)}(?= )", "\x01"))
        .withColumn("_found", spots)
        .withColumn("_found", F.when(F.size("_found") > 0, F.col("_found")).otherwise(every))
        .withColumn("_found", F.when(F.size("_found") > 0, F.col("_found")).when(F.col(text) != "", F.array(text))
                    .otherwise(F.array().cast("array<string>")))
        .withColumn(out, F.array_sort(F.array_distinct(hashed))).drop("_marked", "_found")
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    together = F.size(a) + F.size(b) - common
    return F.when(together == 0, 1.0).otherwise(common / together)


def fingerprint_text(signature_set: Column) -> Column:
    """Eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(signature_set, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


#: A row's key in the joins: id (with a stand-in for null), whether it is null, and the text's hash.
ROW_KEY = ["_slot", "_none", "_hash"]


def neighbours(rows: DataFrame) -> DataFrame:
    """Of every distinct (id, text hash): key and length of the row before it in descending order.

    Only ids, hashes and lengths are sorted; the last row comes before the first one.
    """
    distinct = rows.select(*ROW_KEY, "_chars").distinct()
    ranked = materialize(number_rows(distinct, [], [F.col("_none"), F.col("_slot").desc(), F.col("_hash")], "_rank"))
    count = ranked.count()
    before = ranked.select(
        (F.col("_rank") % F.lit(max(count, 1)) + 1).alias("_rank"), "_chars", *[F.col(c).alias(f"_before{c}") for c in ROW_KEY],
    ).withColumnRenamed("_chars", "_before_chars")
    return ranked.drop("_chars").join(before, "_rank").drop("_rank")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its signatures, its edited text and those of the next row.

    The edited text is the row's own with the last half replaced by as much of the next row's beginning.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumns({
        "_slot": F.coalesce("_id", F.lit(0).cast(kind)), "_none": F.col("_id").isNull(),
        "_hash": F.xxhash64("_text"), "_chars": F.length("_text"),
    })
    order = neighbours(rows)
    placed = with_signatures(rows.drop("_id"), "_text", "_signs").join(order, ROW_KEY)
    following = placed.select(
        *[F.col(f"_before{c}").alias(c) for c in ROW_KEY],
        # names every column of the other branch, so that both read one shuffle of the texts
        F.expr("left(_text, least(_chars, int(_before_chars / 2)))").alias("_next"), F.col("_signs").alias("_next_signs"),
    ).dropDuplicates(ROW_KEY)
    joined = placed.select(*ROW_KEY, "_text", "_chars", "_signs").join(following, ROW_KEY)
    edited = F.concat(F.expr("left(_text, _chars - int(_chars / 2))"), F.col("_next"))
    return with_signatures(joined.select(
        F.when(~F.col("_none"), F.col("_slot")).alias(key), F.col("_chars").cast("long").alias("n_chars"),
        "_signs", "_next_signs", edited.alias("_edited"),
    ), "_edited", "_edited_signs")


def length_partition(size: Column, threshold: float = SIMILARITY) -> Column:
    """Partitions whose bounds grow by 1 / threshold: similar sets lie in one partition or in neighbouring ones."""
    return F.floor(F.log(1 / threshold, F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def similar_documents(docs: DataFrame, threshold: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of different fingerprints (by their smallest ids) with a Jaccard similarity of ``threshold`` or more.

    Documents of one fingerprint are one class, so copies form no pairs. A set of ``n`` signatures is found through its
    first ``n - ceil(threshold * n) + 1`` ones, rarest in the corpus first, in its own and the next length partition.
    """
    signed = with_signatures(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text", "signs").drop("_text")
    classes = materialize(signed.groupBy("signs").agg(F.min("id").alias("id")).where(F.size("signs") > 0))
    spread = classes.select("id", F.explode("signs").alias("sign"))
    counts = spread.groupBy("sign").agg(F.count("*").alias("n"))
    ordered = materialize(spread.join(counts, "sign").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "sign"))), lambda x: x["sign"]).alias("signs")
    ).withColumn("size", F.size("signs")).withColumn("part", length_partition(F.col("size"), threshold)))
    prefix = F.expr(f"slice(signs, 1, size - int(ceil({threshold} * size - 1e-9)) + 1)")
    found = ordered.select("id", "size", "part", F.posexplode(prefix).alias("at", "sign"))
    probe = found.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    a, b = probe.alias("a"), found.alias("b")
    need = F.lit(threshold / (1 + threshold)) * (F.col("a.size") + F.col("b.size"))
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    fits = (
        (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.id") < F.col("b.id")))
    ) & (F.col("a.size") >= threshold * F.col("b.size") - F.lit(1e-9))
    first = F.least(F.col("a.at"), F.col("b.at")) + left >= need - 1e-9
    pairs = a.join(b, ["sign", "part"]).where(fits & first).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    one = ordered.select(F.col("id").alias("id_a"), F.col("signs").alias("signs_a"))
    two = ordered.select(F.col("id").alias("id_b"), F.col("signs").alias("signs_b"))
    return pairs.join(one, "id_a").join(two, "id_b").select(
        "id_a", "id_b", likeness(F.col("signs_a"), F.col("signs_b")).alias("similarity")
    ).where(F.col("similarity") >= threshold - 1e-12)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike text, edited text and next text are."""
    rows = edited_pairs(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("_signs")).alias("fingerprint"), fingerprint_text(F.col("_edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("_signs"), F.col("_edited_signs")).alias("near_edited"),
        likeness(F.col("_signs"), F.col("_next_signs")).alias("near_next"),
        length_partition(F.size("_signs")).alias("length_partition"),
    )

"""Secret scans: candidate strings, and how widely each of them is copied over repositories and owners.

Candidates of the base kinds (``assign``, ``access``, ``hex``) and of the method's own kinds are found in each text.
Their hashes are counted over the whole corpus by distinct repositories and owners. A value that many owners have is
a copied *example*; a value of a single owner is *live*-looking; between them it is *shared*. Spans of ``entropy``
(long strings of mixed letters and digits that stay random without the words and numbers in them) are reported only
where the count says owner-specific.

Positions come from the text between the matches: a text is split at the pattern, and the lengths of gaps and matches
are summed by a window over one document's few candidates, so neither texts nor large groups are shuffled.

Defined results: a null or empty text has no spans (the digest is that of the empty text); a null repository or owner counts
as one unnamed one; repeated rows and repeated ids are judged row by row and both are returned; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize, read_table

#: Owners from which on a value is a widely copied example.
EXAMPLE_OWNERS = 3


@dataclass(frozen=True)
class Kind:
    """A kind of candidate. ``hints``: every match's text, lower-cased, holds one of them; ``gate``: a cheaper
    pattern found in every text that has a match; ``value``: the group that is the secret itself; ``random``: only
    values that pass ``is_random`` count."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    gate: str | None = None
    owner_specific: bool = False
    random: bool = False


#: The base kinds, in their order.
BASE = [
    Kind(
        "assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        value=2, least=12, hints=("password", "passwd", "secret", "token", "api_key", "apikey"),
    ),
    Kind("access", r"AKIA[A-Z0-9]+", least=18, hints=("akia",)),
    Kind("hex", r"[0-9a-f]+", least=16, gate=r"[0-9a-f]{16}"),
]
#: Published formats of well-known credentials, and long mixed strings.
OWN = [
    Kind("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{30,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Kind("google", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyj",)),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("-----begin ",)),
    Kind(
        "entropy",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}",
        gate=r"[A-Za-z0-9+/_-]{24}", owner_specific=True, random=True,
    ),
]
#: A hexadecimal string by itself may be a commit or a checksum; with one of these before it, it is given as a credential.
HEX_IN_CONTEXT = Kind(
    "hex",
    r"""(?<=(?i:(?:key|secret|token|passwd|password|pwd|passphrase|credential|auth)[A-Za-z0-9_"'\x20\]-]{0,16}(?:[:=]|\x20is\x20)|bearer|basic)"""
    r"""[\x20\t"'>]{0,4})(?<![0-9a-f])(?=[0-9]*[a-f])[0-9a-f]{16,}""",
    gate=r"[0-9a-f]{16}",
)

#: What a path, a title or a file name is made of: pronounceable words, long numbers and capitals, short parts between separators.
WORDS = (
    r"[AEIOUY][a-z]{3,}|(?=[A-Z]?[a-z]{3})(?![a-z]{3}(?![a-z]))[A-Z]?[a-z]*[aeiouy][a-z]*|[0-9]{4,}|[A-Z]{5,}"
    r"|(?<![A-Za-z0-9])(?:[A-Za-z][a-z]{0,3}|[A-Z]{1,4}|[0-9]+)(?![A-Za-z0-9])"
)
#: Letters and digits that must be left without those, and bits a character of the whole value. Of 20,000 random strings
#: of letters and digits, 98.1 % of 24 characters and 99.9 % of 32 have so many left.
RANDOM_LEFT, RANDOM_BITS = 12, 2.25


def entropy_bits(value: Column) -> Column:
    """Shannon entropy of the value's characters, in bits a character."""
    size = F.length(value)
    shares = F.transform(
        F.array_distinct(F.split(value, "")), lambda c: (size - F.length(F.replace(value, c, F.lit("")))) / size)
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def is_random(value: Column) -> Column:
    left = F.regexp_replace(F.regexp_replace(value, WORDS, "/"), "[^A-Za-z0-9]", "")
    return (F.length(left) >= RANDOM_LEFT) & (entropy_bits(value) >= RANDOM_BITS)


def gaps_and_matches(kind: Kind, text: Column, lowered: Column) -> Column:
    """Of each match in order: the length of the text before it, its own length, the value's length and hash.

    Matches that are too short or not random are kept here without a hash: they take their place in the text.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value))
    gaps = F.split(text, kind.pattern, -1)
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value")),
        lambda x: F.struct(
            F.lit(kind.name).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"),
            F.when((F.length(x["value"]) >= kind.least) & (is_random(x["value"]) if kind.random else F.lit(True)), F.xxhash64(x["value"]))
            .alias("value"),
        ),
    )
    may = F.lit(False)
    for hint in kind.hints:
        may = may | F.contains(lowered, F.lit(hint))
    if kind.gate:
        may = text.rlike(kind.gate)
    return F.when(may, F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.array().cast(
        "array<struct<kind:string,gap:int,size:int,value:bigint>>"))


def find_candidates(docs: DataFrame, kinds: list[Kind], key: str, repo: str, owner: str, text: str, extra: list[str]) -> DataFrame:
    """One row per input row with its candidates, without its text, written once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(repo).alias("_repo"), F.col(owner).alias("_owner"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"), *extra,
    ).withColumn("_lowered", F.lower("_text"))
    found = F.concat(*[
        F.transform(gaps_and_matches(k, F.col("_text"), F.col("_lowered")), lambda x, p: x.withField("place", p)) for k in kinds
    ])
    return materialize(rows.select("_row", "_key", "_repo", "_owner", *extra, found.alias("_found")))


def ownership(candidates: DataFrame, text_hash: str | None = None) -> DataFrame:
    """Distinct rows, repositories and owners of every value hash. With ``text_hash``, copies of one text are one
    document, that of its smallest repository and owner."""
    if text_hash:
        first = F.min(F.struct("_repo", "_owner")).alias("_first")
        pairs = candidates.groupBy("value", text_hash).agg(first, F.count("*").alias("_rows")).select("value", "_first.*", "_rows")
    else:
        pairs = candidates.groupBy("value", "_repo", "_owner").agg(F.count("*").alias("_rows"))
    unnamed = F.lit("")
    return pairs.groupBy("value").agg(
        F.sum("_rows").alias("copies"),
        F.count_distinct(F.coalesce(F.col("_repo").cast("string"), unnamed)).alias("repositories"),
        F.count_distinct(F.coalesce(F.col("_owner").cast("string"), unnamed)).alias("owners"),
    )


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", repo: str = "source", owner: str = "source", text: str = "text",
    kinds: list[Kind] | None = None, base: int = len(BASE), example_owners: int = EXAMPLE_OWNERS, extra: list[str] | None = None,
    text_hash: str | None = None,
) -> DataFrame:
    """Key and ``found`` of every row: its spans by start, then kind as listed.

    Each span has kind, start, end (code points, end exclusive), repositories, owners, copies and ``standing``
    (example, shared or live). The first ``base`` kinds are always kept; a span of the others is kept where it
    touches no base span and, for owner-specific kinds, no span of another kind, and where one owner alone has the value. With ``text_hash``, one
    of the ``extra`` columns, owners are counted over distinct texts and owner-specific kinds stay unless an example.
    """
    kinds = kinds or BASE + OWN
    rank = F.lit(None).cast("int")
    for number, kind in enumerate(kinds):
        rank = F.when(F.col("kind") == kind.name, number).otherwise(rank)
    specific = [k.name for k in kinds if k.owner_specific]
    extra = extra or []
    rows = find_candidates(docs, kinds, key, repo, owner, text, extra)
    upto = Window.partitionBy("_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        rows.where(F.size("_found") > 0).select("_row", "_repo", "_owner", *([text_hash] if text_hash else []), F.inline("_found"))
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
        .where("value IS NOT NULL").withColumn("_rank", rank).drop("gap", "size", "place")
    )
    spans = materialize(spans)
    judged = spans.join(ownership(spans, text_hash), "value").withColumn(
        "standing", F.when(F.col("owners") >= example_owners, "example").when(F.col("owners") == 1, "live").otherwise("shared"))
    if specific:
        own = F.col("standing") != "example" if text_hash else F.col("standing") == "live"
        judged = judged.where(~F.col("kind").isin(specific) | own)
    of_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "_rank", "kind", "end", "copies", "repositories", "owners", "standing"))).alias("_all"))
    fixed = F.filter("_all", lambda x: x["_rank"] < base)
    kept = F.filter("_all", lambda x: (x["_rank"] < base) | ~F.exists(
        F.col("_fixed"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    if specific:  # a credential of a known format is one span
        known = F.filter("_all", lambda x: ~x["kind"].isin(specific))
        of_row = of_row.withColumn("_all", F.filter("_all", lambda x: ~x["kind"].isin(specific) | ~F.exists(
            known, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    of_row = of_row.withColumn("_fixed", fixed).select("_row", kept.alias("found"))
    none = F.array().cast("array<struct<start:bigint,_rank:int,kind:string,end:bigint,copies:bigint,repositories:bigint,owners:bigint,standing:string>>")
    return rows.select("_row", F.col("_key").alias(key), *extra).join(of_row, "_row", "left").select(
        key, *extra, F.coalesce("found", none).alias("found"))


def without_live_secrets(docs: DataFrame, key: str = "doc_id", repo: str = "source", owner: str = "source", text: str = "text") -> DataFrame:
    """The rows without a credential that is not a widely copied example, with all their columns.

    Owners are counted over distinct texts, so that copies of one document make no example. A hexadecimal string is a
    credential only in such a context (``HEX_IN_CONTEXT``); digits only (card and telephone numbers) are none.
    """
    kinds = [HEX_IN_CONTEXT if k.name == "hex" else k for k in BASE + OWN]
    found = scan_secrets(
        docs.withColumn("_digest", F.xxhash64(text)), key, repo, owner, text, kinds, extra=["_digest"], text_hash="_digest")
    live = found.where(F.exists("found", lambda x: x["standing"] != "example")).select(
        F.col(key).alias("_key"), F.col("_digest").alias("_hash")).distinct()
    same = F.col(f"d.{key}").eqNullSafe(F.col("l._key")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("l._hash"))
    return docs.alias("d").join(live.alias("l"), same, "left_anti")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, all spans, and the method's own standing of every document.

    ``source`` is repository and owner at once: the table names no other.
    """
    found = scan_secrets(read_table(spark, sf_dir, "documents"))

    def number(field: str, value: str) -> Column:
        return F.size(F.filter("found", lambda x: x[field] == value)).cast("long")

    base = F.filter("found", lambda x: x["_rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[number("kind", k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text("found").alias("spans"),
        number("standing", "live").alias("n_live"), number("standing", "example").alias("n_example"),
    )

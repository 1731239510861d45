"""URL filters: exact membership in rule lists from a cascade of Bloom filters, without a join.

A url is looked up under a few keys, one per *shape* of the rules: the last ``k`` labels of its host followed by
the first ``n`` characters of its path. The corpus's distinct keys are the complete universe of look-ups. Level 0 of
a cascade holds the listed keys, level 1 those keys of the universe that level 0 takes wrongly, level 2 the listed keys
that level 1 takes wrongly, and so on until a level takes nothing wrongly. Walking down the levels then answers
exactly for every key of the universe, and the filters are constants of the plan.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty host fits
none; repeated rows are judged one by one; an empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm.common import lower_ascii, materialize, read_table, values_table

#: Bits per key and probes per key of every filter (about one wrong answer in 150).
BITS_PER_KEY, PROBES = 12, 4
#: Largest filter that becomes a constant of the plan: 64 MiB hold 45 million keys.
MAX_FILTER_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


@dataclass(frozen=True)
class Level:
    bits: int
    data: bytes


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def shape_key(host: Column, path: Column, labels: int, chars: int) -> Column:
    """The key of one shape, null where host or path is too short for it."""
    long_enough = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars) & (host != "")
    return F.when(long_enough, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))


def probe(key: Column, level: int, number: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1000 * level + number), key), F.lit(bits))


def holds(key: Column, number: int, level: Level) -> Column:
    """All probes of ``key`` are set in the filter."""
    found = F.lit(True)
    for n in range(PROBES):
        at = probe(key, number, n, level.bits)
        place = (F.shiftright(at, 3) + 1).cast("int")
        byte = F.conv(F.hex(F.substring(F.lit(bytearray(level.data)), place, F.lit(1))), 16, 10).cast("int")
        found = found & (F.call_function("getbit", byte, (at % 8).cast("int")) == 1)
    return found


def build_level(keys: DataFrame, number: int, count: int) -> Level:
    """Set bits are gathered as one row per word of the filter; the filter's size follows ``count`` and is checked."""
    bits = max(64, 64 * -(-count * BITS_PER_KEY // 64))
    if bits // 8 > MAX_FILTER_BYTES:
        raise ValueError(f"{count} keys need a filter of more than {MAX_FILTER_BYTES} bytes; split the rule list")
    at = F.explode(F.array(*[probe(F.col("key"), number, n, bits) for n in range(PROBES)]))
    words = (
        keys.select(at.alias("at")).groupBy((F.col("at") / 64).cast("long").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("set")).collect()
    )
    data = bytearray(bits // 8)
    for row in words:
        data[row["word"] * 8: row["word"] * 8 + 8] = (row["set"] & (2**64 - 1)).to_bytes(8, "little")
    return Level(bits, bytes(data))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that answer exactly for every key of ``universe``; ``listed`` are its listed keys (column ``key``)."""
    levels: list[Level] = []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    while True:
        count = inside.count()
        if not count:
            return levels
        number = len(levels)
        level = build_level(inside, number, count)
        levels.append(level)
        wrong = materialize(outside.where(holds(F.col("key"), number, level)))
        inside, outside = wrong, inside


def listed(key: Column, levels: list[Level]) -> Column:
    """Exact membership: the first level that does not hold the key decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in reversed(range(len(levels))):
        answer = F.when(~holds(key, number, levels[number]), F.lit(number % 2 == 1)).otherwise(answer)
    return F.coalesce(answer & key.isNotNull(), F.lit(False))


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Key, host, path, longest fitting rule (by length, then host) and verdict of every row.

    ``default`` is the verdict where no rule is listed for any key of the url.
    """
    if len({r.key for r in rules}) != len(rules):
        raise ValueError("a rule is listed twice")
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shapes = sorted({r.shape for r in rules})
    keys = {shape: shape_key(F.col("host"), F.col("path"), *shape) for shape in shapes}
    universe = materialize(
        rows.select(F.explode(F.array(*keys.values())).alias("key")).where("key IS NOT NULL").distinct()
    )
    cascades = {}
    for action in sorted({r.action for r in rules}):
        wanted = values_table(pages.sparkSession, [{"key": r.key} for r in rules if r.action == action])
        cascades[action] = build_cascade(wanted, universe)
    hits = []
    for (labels, _), k in keys.items():
        action = F.lit(None).cast("string")
        for name, levels in cascades.items():
            action = F.when(listed(k, levels), F.lit(name)).otherwise(action)
        hits.append(F.struct(
            F.when(action.isNotNull(), F.length(k)).alias("chars"), F.lit(labels).alias("labels"), k.alias("key"), action.alias("action"),
        ))
    best = F.array_max(F.filter(F.array(*hits), lambda h: h["action"].isNotNull()))
    return rows.withColumn("_best", best).select(
        key, "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )


#: The rules that the query applies.
QUERY_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]

ORACLE = r"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT p.*, r.* FROM parts p LEFT JOIN (VALUES
    ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
  ) r(action, rule_host, rule_path)
  ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(action, 'allow') AS verdict
FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) = 1
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), QUERY_RULES)

"""URL filter: path rules first, then exact membership in a list of domains by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 those keys of the corpus that are not listed but pass level 1;
level 3 the listed keys that pass level 2; and so on until nobody passes wrongly. The key universe is
every domain that a host of the corpus lies in, so for each of them the first level that it fails
decides, exactly, and no join is made. DataFrame functions only.

A filter has at most ``FILTER_BITS`` bits (8 MB), which bounds what a task holds. Level 1 grows with the
list, level 2 with the false positives of the whole universe. Where either needs more, list and
universe are split by a hash of the key into segments with a cascade each; should a level still need
more, there are twice as many segments. A url's domains are looked up in one segment after the other.

A null url, and one without ``://``, has an empty host and path, fits no rule and lies in no listed
domain: allow. Repeated rows are all judged; null and repeated listed keys count once or not at all; an
empty list allows, an empty table stays empty; other columns of the input stay out unless asked for.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import common

FILTER_BITS = 1 << 26
BITS_A_KEY = 12
HASHES = 4
LEVELS = 64

#: (rule, verdict) of the query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: IANA's list of top-level domains, as it came with hypothesis (its first line has the version).
TOP_LEVEL = tuple(x.lower() for x in (Path(__file__).parent / "top_level_domains.txt").read_text().split("\n")[1:] if x)
#: Domains that the query lists: each name under every top-level domain, and under its ``example`` domain.
NAMES = ("spam-farm", "cheap-pills")
BLOCKED = tuple(f"{name}.{under}{top}" for name in NAMES for top in TOP_LEVEL for under in ("", "example."))

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str) -> tuple[Column, Column]:
    c = F.col(url)
    rest = F.when(c.contains("://"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one. A rule fits its host and all subdomains of it."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domains(host: Column) -> Column:
    """All domains that a host lies in, itself first: array of strings, empty for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(level * HASHES + j)).bitwiseAND(F.lit(bits - 1)) for j in range(HASHES)]


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def passes(key: Column, words: Column, level: int, bits: int) -> Column:
    return reduce(Column.__and__, [F.get(words, F.shiftrightunsigned(p, 6).cast("int")).bitwiseAND(_mask(p)) != 0 for p in _places(key, level, bits)])


def size_bits(keys: int) -> int:
    return 1 << max(6, (keys * BITS_A_KEY - 1).bit_length())


def encode(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the filter's words, dense."""
    places = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p"))
    words = places.groupBy(F.shiftrightunsigned("p", 6).alias("id")).agg(F.bit_or(_mask(F.col("p"))).alias("w"))
    dense = keys.sparkSession.range(bits >> 6).join(words, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]).alias("words"))


class Cascade:
    """(bits, one-row table of words) of each level."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def columns(self) -> list[Column]:
        return [t.scalar().alias(f"__words{k}") for k, (_, t) in enumerate(self.levels)]

    def holds(self, key: Column) -> Column:
        """True for listed keys, given the words as columns: the first level that a key fails decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(passes(key, F.col(f"__words{k}"), k, self.levels[k][0]), out).otherwise(F.lit(k % 2 == 1))
        return out


class TooLarge(Exception):
    """A level needs more than the bits of a filter."""


def build(listed: DataFrame, universe: DataFrame, scratch: common.Scratch, name: str = "cascade", filter_bits: int = FILTER_BITS) -> Cascade:
    """listed, universe: (key), distinct. Levels are added until none of the other side passes the last one."""
    out = Cascade()
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    for level in range(LEVELS):
        n = inside.count()
        if not n:
            return out
        bits = size_bits(n)
        if bits > max(64, filter_bits):
            raise TooLarge(f"level {level + 1} of {name} needs {bits} bits")
        words = scratch.write(encode(inside, level, bits), f"{name}-{level}-words")
        out.levels.append((bits, words))
        tested = outside.select("key", words.scalar().alias("words"))
        wrong = scratch.write(tested.filter(passes(F.col("key"), F.col("words"), level, bits)).select("key"), f"{name}-{level}-keys")
        inside, outside = wrong, inside
    raise RuntimeError(f"{name} is not decided after {LEVELS} levels")


def cascades(listed: DataFrame, universe: DataFrame, scratch: common.Scratch, filter_bits: int) -> list[Cascade]:
    """A cascade for each segment of the keys, as many as keep all levels within the bits of a filter."""
    wrong = (1 - 2.718281828 ** (-HASHES / BITS_A_KEY)) ** HASHES
    most = max(listed.count(), 1.2 * wrong * universe.count())
    segments = max(1, -(-int(most * BITS_A_KEY * 1.1) // filter_bits)) if size_bits(int(most)) > filter_bits else 1
    part = lambda t, k, n: t.filter(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(n)) == k)
    for attempt in range(LEVELS):
        try:
            return [build(part(listed, k, segments), part(universe, k, segments), scratch, f"segments-{attempt}-{k}", filter_bits) for k in range(segments)]
        except TooLarge:
            segments *= 2
    raise RuntimeError("segments of the filter cannot be made small enough")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), filter_bits: int = FILTER_BITS) -> DataFrame:
    """keep, host, path, rule, verdict and listed for every row of pages; listed: (key), domains to block."""
    scratch = common.Scratch(pages.sparkSession, "url-filter")
    host, path = host_and_path(url)
    parts = pages.select(*keep, host.alias("host"), path.alias("path")).withColumn("__domains", domains(F.col("host")))
    universe = scratch.write(parts.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct(), "universe")
    listed = scratch.write(listed.select(F.lower("key").alias("key")).filter("key is not null and key <> ''").distinct(), "listed")
    held = cascades(listed, universe, scratch, filter_bits)
    found = F.lit(False)
    for k, cascade in enumerate(held):
        if not cascade.levels:
            continue
        own = lambda d: F.pmod(F.xxhash64(d, F.lit(-1)), F.lit(len(held))) == k  # noqa: B023, E731
        names = parts.columns
        parts = parts.select(*names, *cascade.columns())
        hit = F.exists("__domains", lambda d: own(d) & cascade.holds(d))  # noqa: B023
        parts = parts.select(*names, hit.alias(f"__hit{k}"))
        found = found | F.col(f"__hit{k}")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = parts.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("__verdict"), found.alias("listed"))
    return out.select(*keep, "host", "path", "rule", F.coalesce("__verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged."""
    listed = spark.range(1).select(F.explode(F.split(F.lit(" ".join(BLOCKED)), " ")).alias("key"))
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), listed)


ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    regexp_matches(host, '(^|[.])({"|".join(NAMES)})[.](example[.])?({"|".join(TOP_LEVEL)})$') AS listed
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
  listed
FROM judged
"""

"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Each document's counts are taken in one pass. Documents that pass the base rules feed the sketches:
logarithmic histograms whose bins have a relative width of ``2 * ACCURACY``, so a sketch is a set of
(bin, count) rows, merges by adding counts, gives the same quantiles in whatever order it was filled,
and has a bound on its bins that does not grow with the corpus. A metric's fences lie ``REACH`` times
the spread between its quartiles beyond them, with a least spread for metrics that hardly vary.
A source with fewer than ``LEAST`` documents uses the sketch of its language, merged from its sources',
and a language with fewer the sketch of all. The fences are joined back to the documents' counts.

A null text has no words and fails the base rules; null languages and sources count as the empty
name; repeated rows are all judged; a value on a fence passes; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
REACH = 3.0
LEAST = 50
#: Up to so many fences (of about 100 bytes) are broadcast; beyond, a hot source's rows are dealt over SALTS copies of them.
BROADCAST_ROWS, SALTS = 100_000, 32
#: Metric: least spread between the quartiles, and whether low values fail too. The shares' fences can so lie at 0.06, well
#: below the base rule for repeats.
METRICS = {"word_length": (0.5, True), "symbol_share": (0.02, False), "dup_line_share": (0.02, False), "repeat_share": (0.02, False)}


#: Characters from which on a text's words are numbered instead of listed; the counts are the same.
LONG = 1 << 20
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that are found twice or more."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set[tuple] = set()
    twice: set[tuple] = set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, end = 0, 0
    for start, w in enumerate(windows):
        if w in twice:
            covered += start + size - max(start, end)
            end = start + size
    return covered


def repeated_numbers(ids: np.ndarray, size: int = WINDOW) -> int | None:
    """repeated_words of numbered words, by hashes of windows that are compared in full where they are equal; None where different windows have one hash."""
    if len(ids) <= size:
        return 0
    n = len(ids) - size + 1
    hashed = np.zeros(n, np.uint64)
    for k in range(size):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k].astype(np.uint64) + np.uint64(1)
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(size)):
        return None
    twice = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.concatenate([a, b]))
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + size, -1)
    return int((np.cumsum(twice) > 0).sum())


def long_counts(text: str) -> tuple[int, int]:
    """n_words and n_repeat_words of a very long text, whose words are numbered one after the other and never listed."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(m[0], len(known)) for m in WORDS.finditer(text.encode())), np.int64)
    repeats = repeated_numbers(ids)
    return len(ids), repeated_words(text.encode().split()) if repeats is None else repeats


def counts_of(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = text.encode().split() if len(text) < LONG else []
    n_words, n_repeat_words = (len(words), repeated_words(words)) if len(text) < LONG else long_counts(text)
    lines = [x for x in text.split("\n") if x.strip(common.SPACES)]
    return (
        n_words,
        len(text) - sum(text.count(c) for c in common.SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        n_repeat_words,
    )


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [counts_of(x or "") for x in batch.column(3).to_pylist()]
        got = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *got], names=["key", "lang", "source", *names])

    own = docs.select(F.col(key).alias("key"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col(text).alias("text"))
    return common.map_batches(own, run, f"key {dict(docs.dtypes)[key]}, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def metric(name: str) -> Column:
    part, whole = {"word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}[name]
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): the sketch of each group; bin null holds the zeros."""
    long = counted.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), metric(m).alias("v")) for m in METRICS))).alias("x"))
    at = F.when(F.col("x.v") > 0, F.ceil(F.log("x.v") / math.log(GAMMA)).cast("int"))
    return long.groupBy("lang", "source", F.col("x.metric").alias("metric"), at.alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, n, low, high: from the quartiles; a quantile is the middle of the bin with the row at rank floor(q (n - 1))."""
    w = Window.partitionBy(*by, "metric")
    run = w.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cum = sketch.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(w))
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    quantile = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("total") - 1)), value))
    got = cum.groupBy(*by, "metric").agg(F.max("total").alias("n"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    least = F.create_map(*(F.lit(x) for m, (s, _) in METRICS.items() for x in (m, s)))
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), least[F.col("metric")])
    return got.select(*by, "metric", "n", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and each metric's fences: those of the source, else of its language, else of all."""
    own, lang, all_ = fences(sketch, ["lang", "source"]), fences(merged(sketch, ["lang"]), ["lang"]), fences(merged(sketch, []), [])
    lang, all_ = (t.select(*k, "metric", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "low", "high"))) for t, k, x in ((lang, ["lang"], "lang"), (all_, [], "all")))
    both = own.join(lang, ["lang", "metric"]).join(F.broadcast(all_), "metric")  # one row a metric
    pick = lambda c: F.when(F.col("n") >= LEAST, F.col(c)).when(F.col("n_lang") >= LEAST, F.col(f"{c}_lang")).otherwise(F.col(f"{c}_all"))
    return both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, pick(c))).alias(f"{m}_{c}") for m in METRICS for c in ("low", "high")))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's counts, base_failed and kept."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    counted = scratch.write(counts(docs, key, text), "counts").withColumn("base_failed", base_failed())
    sketch = scratch.write(sketches(counted.filter("not base_failed")), "sketch")
    passes = F.lit(True)
    for m, (_, both) in METRICS.items():
        passes = passes & (metric(m) <= F.col(f"{m}_high")) & ((metric(m) >= F.col(f"{m}_low")) if both else F.lit(True))
    limits = scratch.write(thresholds(sketch), "limits")
    if limits.count() <= BROADCAST_ROWS:
        joined = counted.join(F.broadcast(limits), ["lang", "source"], "left")
    else:
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")
        spread = limits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = counted.select("*", salt).join(spread, ["lang", "source", "salt"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(passes, F.lit(False)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    out = judge(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SHARE = {"word_length": "word_chars / greatest(n_words, 1)", "symbol_share": "n_symbols / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)"}


def _fences_sql(by: str, source: str) -> str:
    keys = f"{by}, " if by else ""
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in METRICS.items()) + " END"
    q = lambda x: f"min(CASE WHEN upto > floor({x}::DOUBLE * (total - 1)) THEN CASE WHEN bin IS NULL THEN 0.0::DOUBLE ELSE 2 * pow({GAMMA!r}::DOUBLE, bin) / {GAMMA + 1!r}::DOUBLE END END)"
    return f"""
  (SELECT {keys}metric, total AS n, q1 - {REACH}::DOUBLE * greatest(q3 - q1, {least}) AS low, q3 + {REACH}::DOUBLE * greatest(q3 - q1, {least}) AS high FROM (
    SELECT {keys}metric, max(total) AS total, {q(0.25)} AS q1, {q(0.75)} AS q3 FROM (
      SELECT *, sum(n) OVER (PARTITION BY {keys}metric ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {keys}metric) AS total
      FROM (SELECT {keys}metric, bin, sum(n) AS n FROM {source} GROUP BY ALL)) GROUP BY {keys}metric))"""


ORACLE_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS k FROM windows) WHERE k > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
metrics AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {e} AS v FROM based WHERE NOT base_failed" for m, e in _SHARE.items())}),
sketch AS (SELECT lang, source, metric, CASE WHEN v > 0 THEN ceil(ln(v) / {math.log(GAMMA)!r}::DOUBLE)::INTEGER END AS bin, count(*) AS n FROM metrics GROUP BY ALL),
picked AS (
  SELECT o.lang, o.source, o.metric,
    CASE WHEN o.n >= {LEAST} THEN o.low WHEN l.n >= {LEAST} THEN l.low ELSE a.low END AS low,
    CASE WHEN o.n >= {LEAST} THEN o.high WHEN l.n >= {LEAST} THEN l.high ELSE a.high END AS high
  FROM {_fences_sql("lang, source", "sketch")} o JOIN {_fences_sql("lang", "sketch")} l USING (lang, metric) JOIN {_fences_sql("", "sketch")} a USING (metric)),
limits AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{m}' THEN {c} END) AS {m}_{c}" for m in METRICS for c in ("low", "high"))} FROM picked GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(f"{_SHARE[m]} <= {m}_high" + (f" AND {_SHARE[m]} >= {m}_low" if both else "") for m, (_, both) in METRICS.items())}, false) AS kept
FROM based LEFT JOIN limits USING (lang, source)
"""

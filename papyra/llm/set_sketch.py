"""Near-duplicates by SetSketch registers, with components over exact Jaccard similarity.

A register is the minimum of exponential values, one for each distinct shingle, on an exponential scale: with
the least value h of the rate ``A``, it is 1 - log_B h, rounded down and truncated to 0 .. ``TOP``. The
registers of a union are the larger ones of each place, so sketches merge; two sets agree in a
register with a chance that grows with their similarity.

1. ``BANDS`` bands of ``ROWS`` registers are keys of a text. At similarity 0.8 two texts share no key with
   a chance of 3 in 10 million.
2. Texts with a key in common form a bucket, which is searched as in similar.py: a bucket gives a spanning forest of pairs
   that may be similar and never lists its pairs. A pair may be similar if the joint likelihood of its registers, given the sizes
   of both sets, does not fall towards ``FLOOR`` similarity and above (a pair at 0.8 fails this with a chance of
   1 in 10 million), and the parity maps of its sets do not exclude it.
3. What is left is verified on the whole sets of shingles; where a candidate fails, its bucket is searched on.

Odd input. Rows with equal words are one node, so copies cost nothing, however long. A null or word-less
text has no shingles and is its own component; a text of one word is one shingle. Null keys never name a group: such a row
has the component of its group, null if there is none, and is kept only then. Of ties the smallest key names the group; rows that repeat a key
are one document. Very long texts are taken whole. An empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import common, forest, similar, simhash

SIZE, SIMILARITY = 2, 0.8
#: Base of the scale, rate, largest register.
B, A, TOP = 1.001, 20.0, (1 << 16) - 1
BANDS, ROWS, REGISTERS = 21, 3, 128
FLOOR = 0.58
_RNG = np.random.default_rng(13)
MULTIPLIERS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)


def registers(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) of the distinct shingle hashes from each start to the next."""
    least = np.zeros((len(starts), REGISTERS), np.uint64)
    for k, (a, b) in enumerate(zip(MULTIPLIERS, OFFSETS, strict=True)):
        x = flat * a + b
        least[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)  # the order of the values is that of their uniform parts
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / A
    return np.clip(np.floor(1 - np.log(value) / np.log(B)), 0, TOP).astype(np.uint16)


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(one, two)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def _slope(x: np.ndarray) -> np.ndarray:
    return (B - 1) / B / (1 - x * (B - 1) / B) / np.log(B)


def rises(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the joint likelihood still rises at a similarity, so that its one maximum lies at it or above.

    more, less, same: registers of the first set above, below and equal to the second's; u, v: the sizes' shares of their sum.
    A register of the first is above with chance p(u - v J), below with p(v - u J).
    """
    x, y = np.maximum(u - v * similarity, 1e-12), np.maximum(v - u * similarity, 1e-12)
    above, below = _p(x), _p(y)
    equal = np.maximum(1 - above - below, 1e-12)
    return same * (v * _slope(x) + u * _slope(y)) / equal - more * v * _slope(x) / above - less * u * _slope(y) / below >= 0


class Likely(forest.Parities):
    """Pairs that neither the likelihood of their registers nor their parity maps exclude."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray, similarity: float, sketches: list[bytes]) -> None:
        super().__init__(maps, sizes, similarity)
        self.sketches = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, REGISTERS)
        self.words = max(self.words, REGISTERS // 4)

    def _likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for some in np.array_split(np.arange(len(i)), max(1, len(i) * REGISTERS // forest.WORK)):
            one, two = self.sketches[i[some]], self.sketches[j[some]]
            more, less = (one > two).sum(axis=1), (one < two).sum(axis=1)
            a, b = self.sizes[i[some]].astype(np.float64), self.sizes[j[some]].astype(np.float64)
            fits = np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-9
            out[some] = fits & rises(more, less, REGISTERS - more - less, a / (a + b), b / (a + b), FLOOR)
        return out

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = self._likely(i, j)
        out[out] = super().pairs(i[out], j[out])
        return out

    def block(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = np.repeat(i, len(j)), np.tile(j, len(i))
        return self.pairs(x, y).reshape(len(i), len(j))


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of the registers of each band."""
    out = np.zeros((len(sketches), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(sketches), k + 1, np.uint64)
        for r in range(ROWS):
            key = (key ^ sketches[:, k * ROWS + r].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, k] = key
    return out


def marks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, same, n, keys, map, sketch): a digest of the words, the number of distinct shingles, the band keys (none without words), parity map and registers."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, same binary, n long, keys array<bigint>, map binary, sketch binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.text_bytes(batch.column(1))
        sets = [np.unique(np.array(simhash.shingle_hashes(t, size), np.uint64)) for t in texts]
        same = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
        lengths = np.array([len(h) for h in sets], np.int64)
        own = np.flatnonzero(lengths)
        keys, sketches = [[] for _ in texts], [bytes(2 * REGISTERS)] * len(texts)
        if len(own):
            found = registers(np.concatenate([sets[i] for i in own]), (np.cumsum(lengths) - lengths)[own])
            for i, sketch, k in zip(own.tolist(), found, band_keys(found).view(np.int64).tolist(), strict=True):
                keys[i], sketches[i] = k, sketch.astype("<u2").tobytes()
        maps = [forest.Parities.of(h) for h in sets]
        columns = [pa.array(same, pa.binary()), pa.array(lengths), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array(sketches, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "same", "n", "keys", "map", "sketch"])

    return common.map_batches(docs.select(key, text), run, schema, 1 << 20)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component): every row with the smallest key that it reaches over links."""
    scratch = common.Scratch(docs.sparkSession, "set-sketch")
    marked = scratch.write(marks(docs, key, text, size), "marked")
    nodes = scratch.write(marked.filter("n > 0").groupBy("same").agg(F.min(key).alias("node"), *(F.first(c).alias(c) for c in ("n", "keys", "map", "sketch"))), "nodes")
    own = nodes.filter("node is not null")
    labels = own.select("node", F.col("node").alias("label")).distinct()
    texts = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))

    def near(held: forest.Groups) -> Likely:
        return Likely(held.field("map").to_pylist(), held.field("n").to_numpy(zero_copy_only=False), similarity, held.field("sketch").to_pylist())

    labels = similar.joined(own.select("node", "n", "keys", "map", "sketch"), labels, texts, scratch, size, similarity, near)
    whole = nodes.join(labels, "node", "left").select("same", "label")
    out = marked.select(key, "same", "n").join(whole, "same", "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col(key)).alias("component"))


def op13_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles, component and whether it stays, for every document."""
    found = groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


#: All pairs that share a shingle, and the closure of the links.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS MATERIALIZED (
    SELECT r, count(*) AS n FROM shingles GROUP BY r
), links AS MATERIALIZED (
    SELECT x.r AS a, y.r AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r JOIN sizes p ON p.r = x.r JOIN sizes q ON q.r = y.r
    WHERE p.n * 100 >= 80 * q.n AND q.n * 100 >= 80 * p.n
    GROUP BY x.r, y.r HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))
), reached AS (
    SELECT r, r AS other FROM words
    UNION
    SELECT v.r, l.b FROM reached v JOIN links l ON l.a = v.other
), named AS (
    SELECT v.r, min(w.doc_id) AS component_id FROM reached v JOIN words w ON w.r = v.other GROUP BY v.r
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM words w LEFT JOIN sizes s ON s.r = w.r JOIN named c ON c.r = w.r
"""

"""Near-duplicate groups of SimHash and of shingle similarity together, for stages that promise a similarity.

64 bits cannot carry a similarity of 0.8 of word shingles: about 15 % of the bits differ, so that most
such pairs lie beyond any radius that a grid can search. ``groups`` therefore joins the links of
simhash.py (radius 4, by the grid of segment bit counts) with links of a Jaccard similarity of at least
``SIMILARITY``, which it finds as follows.

1. Each distinct text has ``BANDS`` keys of ``ROWS`` minima of its shingles under fixed permutations. At
   similarity 0.8 two texts share no key with a chance of 1 in 100,000.
2. Texts that share a key form a bucket. A bucket of texts that are known to be connected is left out. From each other
   bucket come candidates: a spanning forest (forest.py) of the pairs that the maps of their shingles' parities cannot
   exclude; these maps never exclude a similar pair.
3. Candidates are verified on the whole sets of shingle hashes. Where all of a bucket's candidates hold, its forest
   connects whatever is similar in it. A bucket with a candidate that does not hold is searched once more, with its members' whole
   sets at hand, so that only similar pairs are near: its forest connects all that is similar in it and is no larger than the bucket.

Texts without a word are equal to each other. Rows with equal words are one node, so copies cost
nothing, however long. Null keys never name a group; an empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import common, forest, simhash

SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
#: For the rounding of distances.
SLACK = 1e-9
#: Of a member in a tile besides its map: node, label and number of shingles.
MEMBER_BYTES = 64
#: Of a tile whose members bring their whole sets.
EXACT_TILE_BYTES = 8 << 20
_RNG = np.random.default_rng(7)
MULTIPLIERS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of the shingle hashes from each start to the next."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k, (a, b) in enumerate(zip(MULTIPLIERS, OFFSETS, strict=True)):
        x = flat * a + b
        least = np.minimum.reduceat(x ^ (x >> np.uint64(31)), starts)
        out[:, k // ROWS] = (out[:, k // ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
    return out


def marks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, same, fp, n, keys, map): a digest of the words, the fingerprint, the number of distinct shingles, the band keys (none without words), and the parity map."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, same binary, fp long, n long, keys array<bigint>, map binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.text_bytes(batch.column(1))
        hashes = [np.array(simhash.shingle_hashes(t, size), np.uint64) for t in texts]
        same = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
        sets = [np.unique(h) for h in hashes]
        lengths = np.array([len(h) for h in hashes], np.int64)
        own = np.flatnonzero(lengths)
        fp, keys = np.zeros(len(texts), np.uint64), [[] for _ in texts]
        if len(own):
            starts = (np.cumsum(lengths) - lengths)[own]
            over = simhash.bit_counts(np.concatenate(hashes), starts) * 2 > lengths[own][:, None]
            fp[own] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
            counts = np.array([len(sets[i]) for i in own])
            for i, k in zip(own.tolist(), band_keys(np.concatenate([sets[i] for i in own]), np.cumsum(counts) - counts).view(np.int64).tolist(), strict=True):
                keys[i] = k
        maps = [forest.Parities.of(h) for h in sets]
        columns = [pa.array(same, pa.binary()), pa.array(fp.view(np.int64)), pa.array([len(h) for h in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "same", "fp", "n", "keys", "map"])

    return common.map_batches(docs.select(key, text), run, schema, 1 << 20)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of (node, text), sorted, as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(np.array(simhash.shingle_hashes(t, size), np.uint64)).tobytes() for t in common.text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return common.map_batches(docs, run, f"node {dict(docs.dtypes)['node']}, shingles binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those (u, v) whose sets have at least the similarity."""
    kind = dict(pairs.dtypes)["u"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
            shared = int((both[1:] == both[:-1]).sum())
            found.append(shared >= similarity * (len(both) - shared) - SLACK)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(found, pa.bool_()))

    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    return common.map_batches(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y"), run, f"u {kind}, v {kind}")


def candidates(groups: DataFrame, kind: str, nearness: Callable[[forest.Groups], object]) -> DataFrame:
    """(cell, u, v, p, q): a spanning forest of the near pairs of each bucket, p and q their labels."""

    def run(batch: pa.RecordBatch, held: forest.Groups) -> pa.RecordBatch:
        i, j = held.forest(nearness(held))
        i_, j_, node, label = pa.array(i), pa.array(j), held.field("node"), held.field("label")
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held.of[i])), node.take(i_), node.take(j_), label.take(i_), label.take(j_)], names=["cell", "u", "v", "p", "q"])

    return forest.map_groups(groups, run, f"cell long, u {kind}, v {kind}, p {kind}, q {kind}")


def joined(nodes: DataFrame, labels: DataFrame, texts: DataFrame, scratch: common.Scratch, size: int, similarity: float, nearness: Callable[[forest.Groups], forest.Parities] | None = None) -> DataFrame:
    """(node, label): labels, united where similar texts connect them; nodes: (node, n, keys, map) and what nearness reads, labels: (node, label), texts: (node, text)."""
    kind = dict(nodes.dtypes)["node"]
    details = nodes.drop("keys")
    weight = sum(F.octet_length(c) for c, t in nodes.dtypes if t == "binary" and c != "node") + MEMBER_BYTES

    def parities(held: forest.Groups) -> forest.Parities:
        return forest.Parities(held.field("map").to_pylist(), held.field("n").to_numpy(zero_copy_only=False), similarity)

    bound = nearness or parities

    def exact(held: forest.Groups) -> forest.Exact:
        return forest.Exact(bound(held), held.field("shingles").to_pylist(), similarity)

    def united(labels: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        edges = edges.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
        found = scratch.write(simhash.components(edges, scratch, f"united-{name}"), f"unions-{name}")
        new = labels.join(found.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("label"))
        return scratch.write(new, f"labels-{name}"), found

    placed = nodes.select("node", weight.alias("bytes"), F.explode("keys").alias("cell"))
    held = forest.tiles(placed.join(labels, "node"), scratch, "bucket", details)
    found = scratch.write(candidates(held, kind, bound), "candidates")
    members = held.select(F.explode("members.node").alias("node")).distinct()
    sets = scratch.write(shingle_sets(texts.join(members, "node", "left_semi").select("node", "text"), size), "sets")
    scratch.drop("bucket-tiles", "bucket-detailed", "bucket-heavy")
    tried = found.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    true = scratch.write(similar(scratch.write(tried.select("u", "v").distinct(), "pairs"), sets, similarity).distinct(), "similar")
    labels, unions = united(labels, tried.join(true, ["u", "v"], "left_semi"), "first")
    p, q = unions.select(F.col("node").alias("p"), F.col("component").alias("p_now")), unions.select(F.col("node").alias("q"), F.col("component").alias("q_now"))
    failed = tried.join(true, ["u", "v"], "left_anti").join(p, "p", "left").join(q, "q", "left")
    again = scratch.write(failed.filter(F.coalesce("p_now", "p") != F.coalesce("q_now", "q")).select("cell").distinct(), "again")
    if again.take(1):
        details = details.join(sets.dropDuplicates(["node"]), "node")
        heavier = placed.join(again, "cell", "left_semi").join(nodes.select("node", "n").dropDuplicates(["node"]), "node").withColumn("bytes", F.col("bytes") + 8 * F.col("n")).drop("n")
        held = forest.tiles(heavier.join(labels, "node"), scratch, "open", details, EXACT_TILE_BYTES)
        labels, _ = united(labels, scratch.write(candidates(held, kind, exact), "exact"), "second")
        scratch.drop("open-tiles", "open-detailed", "open-heavy")
    return labels


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component): every row with the smallest key that it reaches over links of either kind."""
    scratch = common.Scratch(docs.sparkSession, "similar")
    marked = scratch.write(marks(docs, key, text, size), "marked")
    nodes = scratch.write(marked.groupBy("same").agg(F.min(key).alias("node"), *(F.first(c).alias(c) for c in ("fp", "n", "keys", "map"))), "nodes")
    own = nodes.filter("node is not null")
    points = scratch.write(own.groupBy("fp").agg(F.min("node").alias("node")), "points")
    near = points.join(simhash.named(points, scratch), "node").select("fp", "label")
    labels = scratch.write(own.join(near, "fp").groupBy("node").agg(F.min("label").alias("label")), "labels")
    texts = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))
    labels = joined(own.select("node", "n", "keys", "map"), labels, texts, scratch, size, similarity)
    whole = nodes.join(labels, "node", "left").select("same", F.col("label").alias("component")).distinct()
    out = scratch.write(marked.select(key, "same").join(whole, "same").select(key, "component"), "out")
    scratch.drop("marked", "nodes", "points", "labels", "sets", "named")
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, that with the smallest key; rows with a null key, or that repeat the smallest key, stay."""
    found = groups(docs, key, text, size, similarity)
    return docs.join(found.filter(F.col(key) != F.col("component")).select(key).distinct(), key, "left_anti").select(*docs.columns)

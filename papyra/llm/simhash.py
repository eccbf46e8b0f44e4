"""SimHash fingerprints of word shingles and near-duplicate groups under Hamming distance.

Links are found in the embedding of a fingerprint as the bit counts of its ``SEGMENT``-bit segments.
The Manhattan distance of two such vectors is a lower bound of the Hamming distance. The segments are
split into two halves: within radius 4, one half lies within Manhattan distance 2. The grid of each
half has a cell for each vector of counts, and a fingerprint stands in its own cell and in those one
step away, so any two within distance 2 share a cell, that of the vector half-way. Pairs that share a
cell are then verified bit by bit. No pair within the radius is missed.

Documents with one fingerprint are one node. No cell lists its pairs: it gives a spanning forest of its
links (see forest.py). Cells that fingerprints have of their own counts come first; the labels that they
connect are then joined over all cells, where only cells of several labels are searched.

Null, empty and word-less texts have fingerprint zero and link like any other. Repeated rows and ties:
a group is named by its smallest doc_id. An empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from papyra.llm import common, forest

RADIUS = 4
#: Of a member in a tile: node, label and fingerprint.
MEMBER_BYTES = 64
#: Of stars; a path of 2 ** ROUNDS nodes is far beyond any corpus.
ROUNDS = 100
#: Edges that a task may hold of one node.
WHOLE = 1_000_000
SEED = 42
#: For each byte, its bits (lowest first) as eight 8-bit lanes of a word.
LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
#: The low bit of each 2-bit segment of a half.
LOW = 0x55555555


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of the space-joined shingles of ``size`` words, repeats included; of all words if they are fewer; none without words."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(ends) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set between starts[i] and the next start; eight lanes a word, emptied before they can overflow."""
    data = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ends = np.append(starts[1:], len(hashes))
    cuts = np.unique(np.concatenate([starts, *(np.arange(a, b, 255) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 255)]))
    part = np.add.reduceat(LANES[data], cuts, axis=0)
    lanes = part.astype("<u8").view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    return np.add.reduceat(lanes, np.searchsorted(cuts, starts), axis=0)


def fingerprints_of(texts: list[bytes], size: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    hashes = [shingle_hashes(t, size) for t in texts]
    lengths = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    own = np.flatnonzero(lengths)
    if len(own):
        flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(lengths.sum()))
        starts = (np.cumsum(lengths) - lengths)[own]
        over = bit_counts(flat, starts) * 2 > lengths[own][:, None]
        out[own] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(key, fp): the fingerprint of every whole text as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints_of(common.text_bytes(batch.column(1)), size)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return common.map_batches(docs.select(key, text), run, f"`{key}` {dict(docs.dtypes)[key]}, fp long", 2 << 20)



def home_cells(fp: F.Column) -> list[F.Column]:
    """The cells of the counts of both halves.

    The counts of a half's 16 two-bit segments are packed in one word, two bits each, by adding the odd to
    the even bits; the half stands above them.
    """
    out = []
    for half in (0, 1):
        bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        out.append(bits.bitwiseAND(F.lit(LOW)) + F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(LOW)) + F.lit(half << 33))
    return out


def cells(fp: F.Column) -> F.Column:
    """The cells of both halves that a fingerprint stands in, its own and those one step away: array of longs; a step is one count more or less."""
    out = []
    for cell in home_cells(fp):
        steps = []
        for k in range(16):
            at = F.shiftrightunsigned(cell, 2 * k).bitwiseAND(F.lit(3))
            steps += [F.when(at < 2, cell + F.lit(1 << (2 * k))), F.when(at > 0, cell - F.lit(1 << (2 * k)))]
        out += [cell, *steps]
    return F.array_compact(F.array(*out))


def connected(rows: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(u, v): labels that fingerprints within the radius connect, a forest for each cell; rows: (cell, node, label, fp)."""
    kind = dict(rows.dtypes)["label"]

    def run(batch: pa.RecordBatch, held: forest.Groups) -> pa.RecordBatch:
        fps = held.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        i, j = held.forest(forest.Bits(fps, RADIUS))
        label = held.field("label")
        return pa.RecordBatch.from_arrays([label.take(pa.array(i)), label.take(pa.array(j))], names=["u", "v"])

    placed = rows.withColumn("bytes", F.lit(MEMBER_BYTES))
    found = forest.map_groups(forest.tiles(placed, scratch, name), run, f"u {kind}, v {kind}")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def named(nodes: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(node, label): every node of (node, fp) with the smallest node that it reaches over links; fp distinct, node not null."""
    home = nodes.select(F.explode(F.array(*home_cells(F.col("fp")))).alias("cell"), "node", F.col("node").alias("label"), "fp")
    first = components(connected(home, scratch, "home"), scratch, "first")
    labelled = nodes.join(first, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("label"))
    labelled = scratch.write(labelled, "labelled")
    scratch.drop("home-tiles", "home-heavy")
    placed = scratch.write(labelled.select(F.explode(cells(F.col("fp"))).alias("cell"), "node", "label", "fp"), "cells")
    second = scratch.write(components(connected(placed, scratch, "grid"), scratch, "second"), "relabelled")
    out = labelled.join(second.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("label"))
    out = scratch.write(out.distinct(), "named")
    scratch.drop("cells", "grid-tiles", "grid-heavy", "labelled", "relabelled")
    return out


def components(edges: DataFrame, scratch: common.Scratch, name: str = "components") -> DataFrame:
    """(node, component): the smallest reachable node for every node with an edge, by alternating large and small stars.

    edges: (u, v) with u < v. Each round is written to the shared folder; the rounds grow with the
    logarithm of the longest path.
    """
    now, seen = _counted(edges.select("u", "v").distinct(), scratch, f"{name}-0")
    for k in range(1, ROUNDS):
        if not seen[0]:
            break
        # a join with a written table can be split where one node has many edges; few edges need no splitting
        cut = scratch.write if seen[0] > WHOLE else lambda df, _: df
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
        large = cut(both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct(), f"{name}-large")
        # from each node to its smaller neighbours: all of them, and the node, hang on the smallest
        low = cut(large.groupBy("v").agg(F.min("u").alias("m")), f"{name}-low")
        small = large.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).union(low.select(F.col("m").alias("u"), "v"))
        now, state = _counted(small.filter("u < v").distinct(), scratch, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-least", f"{name}-large", f"{name}-low")
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not found after {ROUNDS} rounds")
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def _counted(edges: DataFrame, scratch: common.Scratch, name: str) -> tuple[DataFrame, tuple]:
    """edges, written, and their number and the sum of their hashes, which are taken as they are written."""
    seen = Observation()
    out = scratch.write(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(key, fp, component): every row with the smallest key that it reaches over links."""
    scratch = common.Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, key, text, size), "marked")
    nodes = scratch.write(marked.groupBy("fp").agg(F.min(key).alias("node")), "nodes")
    known = named(nodes.filter("node is not null"), scratch)
    whole = nodes.join(known, "node", "left").select("fp", F.coalesce("label", "node").alias("component"))
    return marked.join(whole, "fp").select(key, "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """One row of each group, that with the smallest key; rows with a null key or with a repeated smallest key all stay."""
    found = groups(docs, key, text, size)
    out = found.filter(F.col(key) != F.col("component")).select(key).distinct()
    return docs.join(out, key, "left_anti").select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

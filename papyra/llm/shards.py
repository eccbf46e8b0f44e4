"""Sharding by a k-d tree: nodes are split at weighted medians of their widest metadata dimension.

A node that is to become k leaves is split at the weight share (k // 2) / k along the dimension whose
values spread most, measured against the whole table's spread. Medians are found by counting: the
weights of up to ``BINS`` equal bins of every node of a level are added up in one aggregation with
map-side partial sums, then the bin that holds the cut is searched again, until it weighs less than
``TOLERANCE`` of a leaf or has one value. One value that weighs more (a hot source) is cut
along the text's checksum, then along a hash, so no group, however large, stands in the way of equal shards.

Equal texts are one point of the tree, with the metadata of the row of the smallest key and the weight of all of
them, so they stay in one shard. Only copies that together weigh more than ``COPIES`` of a leaf are dealt row by row;
where single documents weigh more than that, copies stay together up to the weight of the heaviest document, a tenth of a leaf at most.

Each point carries the number of its node, which a small
table of cuts, one row a node, changes at each level. The driver sees a row a node and round, no bins; rows
move once, to be numbered.

DataFrame functions only. A null text weighs as an empty one; null metadata are values like any
other, and so is a source or language that the table has no column for; ties are split by a hash of the text, of the key among
copies that are dealt row by row; rows with one key and text stay together; very long texts weigh what they weigh; an empty table gives an empty table;
other columns of the input stay out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm import common

#: Bins of a node, and of all nodes of a level together.
BINS, LEVEL_BINS = 1 << 14, 1 << 22
TOLERANCE = 0.0005
COPIES = 0.01
#: Rows that one task numbers.
NUMBERED = 20_000
#: Leaves of a tree: a table of cuts, at about 60 bytes a node, is broadcast.
MOST_LEAVES = 1 << 18
#: What tells texts apart.
TEXT = ["crc", "bytes", "same"]
SALTS = 64
DIMENSIONS = ("source", "lang", "size", "key")
#: Bounds of what is cut after the dimension: the checksum, then the hash of the key.
TIES = ((0, (1 << 32) - 1), (-(1 << 63), (1 << 63) - 1))


@dataclass
class Node:
    """A node of a level; pinned: values of the dimension and of the checksum that the cut lies in."""

    leaves: int
    first: int
    dimension: int = 0
    pinned: list[int] = field(default_factory=list)
    cut: int = 0
    low: int = 0
    high: int = 0
    before: float = 0.0
    want: float = 0.0
    done: bool = False


def metadata(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Compact rows: the key, size, checksum, the text's hash, dimensions and the key's hash as longs; the text goes no further."""
    t = F.coalesce(F.col(text), F.lit(""))
    held = {c.lower() for c in docs.columns}
    name = lambda c: F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), 34) if c in held else F.lit(0).cast("long")
    size = F.octet_length(t).cast("long") + 8
    dims = F.array(name("source"), name("lang"), (F.log2(size) * (1 << 20)).cast("long"), F.coalesce(F.col(key).cast("long"), F.lit(0)))
    return docs.select(F.col(key).alias("id"), size.alias("bytes"), F.crc32(t).alias("crc"), F.xxhash64(t).alias("same"), dims.alias("dims"), F.xxhash64(F.col(key)).alias("mix"))


def _spread(rows: DataFrame, by: list[str]) -> DataFrame:
    """The weight, and the least and greatest of each dimension, of each node."""
    ends = [f(F.col("dims")[k]).alias(f"{f.__name__}{k}") for k in range(len(DIMENSIONS)) for f in (F.min, F.max)]
    return rows.groupBy(*by).agg(F.sum("bytes").alias("w"), *ends)


def _cuts(spark: SparkSession, nodes: dict[int, Node], values) -> DataFrame:
    """One row for each node: its dimension, pinned values and ``values(node)``, as columns x and y."""
    rows = [(k, n.dimension, len(n.pinned), *(n.pinned + [0, 0])[:2], *values(n)) for k, n in nodes.items()]
    return common.local_rows(spark, rows, "node int, dim int, depth int, a bigint, b bigint, x bigint, y bigint")


def _value(depth: int):
    return F.get("dims", F.col("dim")) if depth == 0 else F.col("crc") if depth == 1 else F.col("mix")


def grow(meta: DataFrame, shards: int, scratch: common.Scratch) -> DataFrame:
    """meta with the shard of each row: the leaf of a tree with ``shards`` leaves of near equal bytes."""
    if shards > MOST_LEAVES:
        raise ValueError(f"{shards} shards; a tree has {MOST_LEAVES} leaves at most")
    total = _spread(meta, []).first()
    rows = meta.withColumn("node", F.lit(0 if shards > 1 else -1))
    if not total["w"]:
        return rows.select("*", (-F.col("node") - 1).alias("shard")).drop("node")
    whole = [max(1, total[f"max{k}"] - total[f"min{k}"]) for k in range(len(DIMENSIONS))]
    leaf, level, depth = total["w"] / shards, {0: Node(shards, 0)} if shards > 1 else {}, 0
    while level:
        open_ = rows.filter("node >= 0")
        found = {r["node"]: r for r in _spread(open_, ["node"]).collect()}  # a row a node
        for k, n in level.items():
            if k not in found:
                n.done = True
                continue
            r = found[k]
            n.dimension = max(range(len(DIMENSIONS)), key=lambda c: (r[f"max{c}"] - r[f"min{c}"]) / whole[c])  # noqa: B023
            n.low, n.high, n.want = r[f"min{n.dimension}"], r[f"max{n.dimension}"], r["w"] * (n.leaves // 2) / n.leaves
        while pending := {k: n for k, n in level.items() if not n.done}:
            _search(open_, pending, leaf)
        after: dict[int, Node] = {}
        sides: dict[int, list[int]] = {}
        for k, n in level.items():
            for leaves, first in ((n.leaves // 2, n.first), (n.leaves - n.leaves // 2, n.first + n.leaves // 2)):
                sides.setdefault(k, []).append(len(after) if leaves > 1 else -1 - first)
                if leaves > 1:
                    after[len(after)] = Node(leaves, first)
        cuts = _cuts(meta.sparkSession, level, lambda n: (n.cut, 0)).join(F.broadcast(common.local_rows(meta.sparkSession, [(k, *v) for k, v in sides.items()], "node int, l int, r int")), "node")
        v, c, m = (_value(k) for k in range(3))
        last = F.when(F.col("depth") == 1, c < F.col("x")).otherwise((c < F.col("b")) | ((c == F.col("b")) & (m < F.col("x"))))
        left = F.when(F.col("depth") == 0, v < F.col("x")).otherwise((v < F.col("a")) | ((v == F.col("a")) & last))
        moved = rows.join(F.broadcast(cuts), "node", "left").withColumn("node", F.when(F.col("node") < 0, F.col("node")).when(left, F.col("l")).otherwise(F.col("r")))
        rows = scratch.write(moved.select(*rows.columns), f"level-{depth}")
        scratch.drop(f"level-{depth - 1}")
        level, depth = after, depth + 1
    return rows.select("*", (-F.col("node") - 1).alias("shard")).drop("node")


def _search(rows: DataFrame, pending: dict[int, Node], leaf: float) -> None:
    """One aggregation: every node's range in bins; the range becomes the bin with the cut, or the next key's."""
    bins = max(2, min(BINS, LEVEL_BINS // len(pending)))
    table = _cuts(rows.sparkSession, pending, lambda n: (n.low, n.high)).join(F.broadcast(common.local_rows(rows.sparkSession, [(k, float(n.want - n.before), max(1, -(-(n.high - n.low + 1) // bins))) for k, n in pending.items()], "node int, want double, step bigint")), "node")
    v, c, m = (_value(k) for k in range(3))
    value = F.when(F.col("depth") == 0, v).when(F.col("depth") == 1, c).otherwise(m)
    inside = (F.col("depth") == 0) | ((v == F.col("a")) & ((F.col("depth") == 1) | (c == F.col("b"))))
    place = F.floor((F.col("v").cast("decimal(20,0)") - F.col("x")) / F.col("step")).cast("int")
    own = rows.join(F.broadcast(table), "node").withColumn("v", value).filter(inside & F.col("v").between(F.col("x"), F.col("y")))
    sums = own.withColumn("bin", place).groupBy("node", "bin").agg(F.sum("bytes").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"), F.first("want").alias("want"))
    so_far = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
    top = F.max("bin").over(Window.partitionBy("node"))
    crossed = sums.withColumn("end", so_far).withColumn("top", top).filter(((F.col("end") >= F.col("want")) & (F.col("end") - F.col("w") < F.col("want"))) | (F.col("bin") == F.col("top")))
    chosen = crossed.groupBy("node").agg(F.min(F.struct("bin", "w", "a", "b", "end")).alias("r")).select("node", "r.*")
    for r in chosen.collect():  # a row a node
        n = pending[r["node"]]
        before = n.before + r["end"] - r["w"]
        rest, alone = n.want - before, r["a"] == r["b"]
        small = r["w"] <= (COPIES if alone and len(n.pinned) == 1 else TOLERANCE) * leaf
        if small or (alone and len(n.pinned) == 2):
            n.cut, n.done = (r["b"] + 1 if rest > r["w"] / 2 else r["a"]), True
        elif alone:
            n.low, n.high = TIES[len(n.pinned)]
            n.pinned.append(r["a"])
        else:
            n.low, n.high = r["a"], r["b"]
        n.before = before


def number(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """slot: gapless from 0 in each shard. A shard's rows are numbered in parts of about NUMBERED rows, each after those before it."""
    parts = max(1, -(-rows // shards // NUMBERED))
    cut = placed.withColumn("part", F.pmod(F.xxhash64("mix", "crc"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "bytes"))
    return cut.withColumn("own", own).join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("own") - 1).cast("long"))


def points(meta: DataFrame, most: float, scratch: common.Scratch) -> DataFrame:
    """(id, size, crc, same, dims, mix, bytes, whole): copies of a text as one point that weighs all of them, or, where they weigh more than ``most``, each row."""
    least = F.min(F.struct(F.col("id").isNull(), "id", "dims"))["dims"]
    groups = scratch.write(meta.groupBy(*TEXT).agg(F.count("*").alias("n"), least.alias("dims")), "groups")
    heavy = (F.col("n") > 1) & (F.col("n") * F.col("bytes") > most)
    # rows of one text may be many, so they meet the few heavy groups in SALTS parts
    split = groups.filter(heavy).select(*TEXT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = meta.withColumn("salt", F.pmod("mix", F.lit(SALTS)).cast("int")).join(split, [*TEXT, "salt"], "left_semi")
    rows = rows.select("id", F.col("bytes").alias("size"), "crc", "same", "dims", "mix", "bytes", F.lit(False).alias("whole"))
    one = groups.filter(~heavy).select(F.lit(None).cast(dict(meta.dtypes)["id"]).alias("id"), F.col("bytes").alias("size"), "crc", "same", "dims", F.xxhash64("same", "bytes").alias("mix"), (F.col("n") * F.col("bytes")).alias("bytes"), F.lit(True).alias("whole"))
    return scratch.write(rows.unionByName(one), "points")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, bytes, crc, shard, slot) of every row, in ``shards`` leaves, or in leaves of about ``target_bytes``."""
    scratch = common.Scratch(docs.sparkSession, "shards")
    meta = scratch.write(metadata(docs, key, text), "meta")
    rows, total, heaviest = meta.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    shards = shards or max(1, -(-total // target_bytes))
    leaf = total / shards
    placed = grow(points(meta, max(COPIES * leaf, min(heaviest, leaf / 10)), scratch), shards, scratch)
    alone = placed.filter("not whole").select("id", F.col("size").alias("bytes"), "crc", "mix", "shard")
    whole = placed.filter("whole").select("crc", F.col("size").alias("bytes"), "same", "shard")
    together = meta.join(whole, TEXT).select("id", "bytes", "crc", "mix", "shard")
    return number(alone.unionByName(together), rows, shards).select("id", "bytes", "crc", "shard", "slot")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = shard(common.table(spark, sf_dir, "documents"), 24)
    return out.select(F.col("id").alias("doc_id"), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

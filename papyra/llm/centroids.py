"""Centroid clustering by kd-tree filtering, exact in integers.

Each task packs its vectors into kd-trees of at most ``BLOCK`` points, split at the median of the widest
dimension. A node holds how many points it has, their integer sum and their box. In a round the centroids, at most
``K`` of them, go down each tree together: of those that may be nearest to some point of a node, the one
nearest to the box's middle is compared with each other one at the corner of the box that favours the
other most; if it is nearer even there, the other is strictly dominated in the whole box and is
dropped. A node with one centroid left is assigned whole, by its count and sum; at a leaf the points are
compared with the centroids that are left. Equal distances go to the smaller number, so a
centroid is dropped only where it is strictly farther. Trees are built once, written, and read in each round.

Odd input. Vectors that are null, of another length than ``DIMENSIONS``, or with a null or non-finite component are left out. Components
become floor(256 x), held within 2**26 either way, so that squared distances fit a long. Equal vectors are one box without extent, assigned at once.
Repeated rows count as often as they stand. Rows with a null vec_id are clustered but start no centroid;
of rows with equal vec_id the least vector starts one. With fewer vectors than ``K`` there are as many centroids as
vectors with a vec_id; an empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import common

K, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
LIMIT = 1 << 26
#: Points of a tree, and of a leaf.
BLOCK, LEAF = 16_384, 48
#: Products of components up to this size are exact in doubles, summed over the dimensions.
EXACT = 1 << 22


class Tree:
    """A kd-tree of integer points: nodes in the order in which they were split, points in the order of leaves."""

    def __init__(self, points: np.ndarray, order: np.ndarray, spans: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        self.points, self.order, self.spans, self.low, self.high, self.sums = points, order, spans, low, high, sums

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(points))
        spans, low, high, sums = [], [], [], []
        waiting = [(0, len(points), -1, 0)]
        while waiting:
            a, b, parent, side = waiting.pop()
            own = points[order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            node = len(spans)
            if parent >= 0:
                spans[parent][2 + side] = node
            spans.append([a, b, -1, -1])
            low.append(lo)
            high.append(hi)
            sums.append(own.sum(axis=0, dtype=np.int64))
            wide = int((hi - lo).argmax())
            if b - a > leaf and hi[wide] > lo[wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
                waiting += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        return cls(points[order], order, np.array(spans, np.int32), np.array(low), np.array(high), np.array(sums))

    def pack(self) -> list[bytes]:
        parts = (self.points.astype("<i4"), self.spans.astype("<i4"), self.low.astype("<i4"), self.high.astype("<i4"), self.sums.astype("<i8"))
        return [x.tobytes() for x in parts]

    @classmethod
    def unpack(cls, packed: list[bytes], dimensions: int) -> Tree:
        points, spans, low, high = (np.frombuffer(x, "<i4").reshape(-1, n).astype(np.int64) for x, n in zip(packed, (dimensions, 4, dimensions, dimensions), strict=False))
        return cls(points, np.arange(len(points)), spans, low, high, np.frombuffer(packed[4], "<i8").reshape(-1, dimensions))

    def assign(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(node or -1, first point, end, nearest centroid: one for the whole node, or one for each point)."""
        waiting = [(0, np.arange(len(centroids)))] if len(self.points) else []
        while waiting:
            node, left = waiting.pop()
            a, b, one, two = self.spans[node].tolist()
            left = undominated(centroids, left, self.low[node], self.high[node])
            if len(left) == 1:
                yield node, a, b, left
            elif (self.low[node] == self.high[node]).all():
                yield node, a, b, left[:1]  # one point: none is strictly farther than the nearest
            elif one < 0:
                yield -1, a, b, left[distances(self.points[a:b], centroids[left]).argmin(axis=1)]
            else:
                waiting += [(one, left), (two, left)]


def undominated(centroids: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The centroids that no point of the box excludes."""
    own = centroids[left]
    best = own[np.square(2 * own - (low + high)).sum(axis=1).argmin()]
    away = own - best
    corner = np.where(away > 0, high, low)
    farther = (away * (own + best - 2 * corner)).sum(axis=1)  # squared distance to the corner, less that of the best
    return left[farther <= 0]


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, (points, centroids)."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return (np.square(p).sum(axis=1)[:, None] + np.square(c).sum(axis=1)[None, :] - 2 * (p @ c.T)).astype(np.int64)
    return np.stack([np.square(points - c).sum(axis=1) for c in centroids], axis=1)


def kept(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """Rows whose vector has all its components, finite."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(F.coalesce((F.size(x) == dimensions) & fine, F.lit(False)))


def whole_numbers(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)


def trees(df: DataFrame, key: str, vector: str, dimensions: int, block: int) -> DataFrame:
    """(ids, points, spans, low, high, sums): kd-trees of each task's vectors; ids in the order of the points."""
    kind = dict(df.dtypes)[key]
    schema = f"ids array<{kind}>, points binary, spans binary, low binary, high binary, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        count = 0

        def packed() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            tree = Tree.of(np.concatenate([h[1] for h in held]))
            row = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(tree.order))), *(pa.array([x], pa.binary()) for x in tree.pack())]
            held.clear()
            return pa.RecordBatch.from_arrays(row, names=["ids", "points", "spans", "low", "high", "sums"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if count + part.num_rows > block:
                    yield packed()
                    count = 0
                held.append((part.column(0), whole_numbers(part.column(1), dimensions)))
                count += part.num_rows
        if count:
            yield packed()

    return common.map_stream(df.select(key, vector), run, schema)


def rows_of(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values, Tree.unpack([batch.column(c)[i].as_py() for c in range(1, 6)], dimensions)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floor(sum / count) of those with points; sums of tasks are added before they reach the driver, which sees one row a component."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, tree in rows_of(batches, dimensions):
            for node, a, b, nearest in tree.assign(centroids):
                if node >= 0:
                    counts[nearest[0]] += b - a
                    sums[nearest[0]] += tree.sums[node]
                else:
                    np.add.at(counts, nearest, 1)
                    np.add.at(sums, nearest, tree.points[a:b])
        own = np.flatnonzero(counts)
        if len(own):
            columns = np.repeat(own, dimensions), np.tile(np.arange(dimensions), len(own)), np.repeat(counts[own], dimensions), sums[own].reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "at", "n", "s"])

    new = centroids.copy()
    total = common.map_stream(forest, run, "cluster long, at long, n long, s long").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    for cluster, at, n, s in total.collect():
        new[cluster, at] = s // n
    return new


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every point."""
    dimensions = centroids.shape[1]
    kind = dict(forest.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in rows_of(batches, dimensions):
            cluster = np.zeros(len(ids), np.int32)
            for _, a, b, nearest in tree.assign(centroids):
                cluster[a:b] = nearest
            distance = np.square(tree.points - centroids[cluster]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return common.map_stream(forest, run, f"id {kind}, cluster int, distance long")


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: str = "2:", dimensions: int = DIMENSIONS, block: int = BLOCK) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    scratch = common.Scratch(df.sparkSession, "centroids")
    own = kept(df.select(key, vector), vector, dimensions)
    kind = dict(df.dtypes)[key]
    out = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    # the k least of a total order, whatever the table's size
    numbers = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(LIMIT / SCALE)), F.lit(-LIMIT / SCALE)) * SCALE).cast("long"))
    first = own.filter(F.col(key).isNotNull()).select(order.alias("h"), numbers.alias("v")).orderBy("h", "v").limit(k).collect()
    if not first:
        return df.sparkSession.createDataFrame([], out)
    centroids = np.array([r["v"] for r in first], np.int64)
    forest = scratch.write(trees(own, key, vector, dimensions, block), "trees")
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    found = scratch.write(assigned(forest, centroids), "assigned")
    scratch.drop("trees")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1
    facts = [(c, min(s, most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    facts = common.local_rows(df.sparkSession, facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row a centroid, k at most
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every embedding."""
    return cluster(common.table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    """The same by all distances of every round."""
    parts = ["""vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
)""", f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM vectors WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K})
)"""]
    for n in range(1, ROUNDS + 2):
        parts.append(f"""a{n} AS MATERIALIZED (
    SELECT r, min(d).k AS k, min(d).d AS d FROM (
        SELECT r, {{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': k}} AS d FROM vectors, c{n - 1}
    ) GROUP BY r
)""")
        if n <= ROUNDS:
            parts.append(f"""c{n} AS MATERIALIZED (
    SELECT k, coalesce(m.c, o.c) AS c FROM c{n - 1} o LEFT JOIN (
        SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM (
            SELECT k, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.k, unnest(v.v) AS x, unnest(range(64)) AS pos FROM a{n} a JOIN vectors v ON v.r = a.r) GROUP BY k, pos
        ) GROUP BY k
    ) m USING (k)
)""")
    last = ROUNDS + 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{last} a JOIN vectors v ON v.r = a.r JOIN c{ROUNDS} c ON c.k = a.k"""


ORACLE_SQL = oracle_sql()

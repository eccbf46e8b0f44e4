"""Exact vector search that reads only the cells that can hold an answer.

Vectors are stored by cell: the pivot that they are most like, and how far from it they lie, in rings. Angles obey the
triangle inequality: a vector of a cell between the angles a and b from its pivot is at least the larger of t - b and a - t away from a query at
the angle t from the pivot. So the cells nearest to a query give its k-th best similarity so far, and of the others only those
are read whose bound reaches it. Nothing is lost; how much is read depends on how the vectors lie.

Pivots come from a bounded sample (``SAMPLE`` rows by hash of the key), farthest first; they only decide how well cells
separate. Rows are added by appending files to their cells. Rows without a vector, or with one of length zero, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.session import shared_folder

SAMPLE, PIVOTS, RINGS = 4096, 64, 16
#: Queries of a search; more are taken block by block. Vectors that a task compares at once.
BLOCK, CHUNK = 4096, 2048
#: For the rounding of angles.
SLACK = 1e-6


def units(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction, and their unit vectors."""
    sizes = np.array([0.0 if v is None else float(np.linalg.norm(np.asarray(v, dtype=np.float64))) for v in vectors])
    fit = np.flatnonzero(sizes > 0)
    return fit, np.stack([np.asarray(vectors[i], dtype=np.float64) / sizes[i] for i in fit]) if len(fit) else np.zeros((0, 1))


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Points far from each other: each next one is the least like those before."""
    chosen, near = [0], points @ points[0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, points @ points[chosen[-1]])
    return points[chosen]


class Nearest:
    """The k best keys of each query so far, by similarity to 12 places, then key; of what comes, only what reaches ``least`` counts."""

    def __init__(self, k: int, least: np.ndarray, keys: np.dtype) -> None:
        self.k, self.least = k, least
        self.keys, self.like = np.full((len(least), k), "" if keys == object else 0, keys), np.full((len(least), k), -np.inf)

    def put(self, asked: np.ndarray, keys: np.ndarray, like: np.ndarray) -> None:
        """Keys in ascending order, and the similarity of each to each query that is asked."""
        placed = np.round(like, 12)
        fits = placed >= np.maximum(self.least[asked], np.round(self.like[asked, -1], 12))[:, None]
        many = np.flatnonzero(fits.sum(axis=1) > 4 * self.k)
        if len(many):  # equal ones stay in the order of their keys
            top = np.argsort(-placed[many], axis=1, kind="stable")[:, : self.k]
            fits[many] = False
            fits[many[:, None], top] = True
            fits[many] &= placed[many] >= self.least[asked[many]][:, None]
        row, col = np.nonzero(fits)
        if not len(row):
            return
        own = np.unique(row)
        rows = np.concatenate([np.repeat(own, self.k), row])
        every = np.concatenate([self.keys[asked[own]].ravel(), keys[col]])
        likes = np.concatenate([self.like[asked[own]].ravel(), like[row, col]])
        order = np.lexsort((every, -np.round(likes, 12), rows))
        rows, every, likes = rows[order], every[order], likes[order]
        begins = np.searchsorted(rows, own)
        best = (begins[:, None] + np.arange(self.k)).ravel()
        self.keys[asked[own]] = every[best].reshape(-1, self.k)
        self.like[asked[own]] = likes[best].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(self.like > -np.inf)
        return row, self.keys[row, col], self.like[row, col]


class VectorIndex:
    """An index in a folder: ``vectors`` by cell, the cells' bounds, and the pivots."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str = "embedding") -> None:
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector
        self.read: dict[str, int] = {}

    def build(self, rows: DataFrame, pivots: int = PIVOTS) -> VectorIndex:
        some = rows.filter(F.col(self.vector).isNotNull()).orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE).select(self.vector).collect()
        _, points = units([r[0] for r in some])
        if not len(points):
            raise ValueError("no row has a vector")
        chosen = farthest_first(points, pivots)
        self.spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(chosen)], "pivot int, at array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pivots")
        return self.add(rows)

    def _pivots(self) -> np.ndarray:
        return np.array([r["at"] for r in self.spark.read.parquet(f"{self.path}/pivots").orderBy("pivot").collect()])  # PIVOTS rows

    def add(self, rows: DataFrame) -> VectorIndex:
        """More rows, by appending to their cells; the bounds of cells are taken again from their angles alone."""
        key, vector, pivots = self.key, self.vector, self._pivots()
        schema = f"`{key}` {dict(rows.dtypes)[key]}, unit array<double>, angle double, cell int"

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                fit, points = units(pdf[vector].tolist())
                if not len(fit):
                    continue
                like = points @ pivots.T
                pivot = like.argmax(axis=1)
                angle = np.arccos(np.clip(like[np.arange(len(fit)), pivot], -1, 1))
                ring = np.minimum((angle * RINGS / np.pi).astype(int), RINGS - 1)
                yield pd.DataFrame({key: pdf[key].to_numpy()[fit], "unit": list(points), "angle": angle, "cell": (pivot * RINGS + ring).astype("int32")})

        dealt = rows.select(key, vector).mapInPandas(run, schema).hint("rebalance", "cell")  # a file a cell, more for a large one
        dealt.write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        bounds = self.spark.read.parquet(f"{self.path}/vectors").groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
        bounds.write.mode("overwrite").parquet(f"{self.path}/cells")
        return self

    def search(self, queries: DataFrame, k: int, query_key: str) -> DataFrame:
        """(query, key, similarity, rank) of each query's k most similar rows; equal ones by key. ``read`` says how many (query, cell) pairs there are and were searched."""
        own = queries.select(F.col(query_key).alias("query"), F.col(self.vector).alias("v")).filter("v is not null")
        blocks = max(1, -(-own.count() // BLOCK))
        self.read = {"pairs": 0, "searched": 0}
        parts = [self._block(own.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect(), k, dict(own.dtypes)["query"]) for b in range(blocks)]  # BLOCK rows each, about
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _block(self, rows: list, k: int, kind: str) -> DataFrame:
        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # PIVOTS * RINGS rows at most
        fit, q = units([r["v"] for r in rows])
        names = [rows[i]["query"] for i in fit]
        number, low, high, n = (np.array([c[x] for c in cells]) for x in ("cell", "low", "high", "n"))
        angle = np.arccos(np.clip(q @ self._pivots().T, -1, 1))[:, number // RINGS] if len(fit) else np.zeros((0, len(cells)))
        least = np.maximum(0, np.maximum(angle - high, low - angle))  # angle to the nearest member, at least
        order = np.argsort(least, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(least.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        w = Window.partitionBy("query").orderBy(F.round("similarity", 12).desc(), self.key)
        best = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        path = shared_folder(self.spark, "nearest")
        near = self._best(first, number, names, q, k, kind, np.full(len(names), -np.inf))
        best(near).drop("rank").write.parquet(path)
        found = self.spark.read.schema(near.schema).parquet(path)
        worst = np.full(len(names), -2.0)
        place = {x: i for i, x in enumerate(names)}
        for r in found.groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("s")).collect():  # a row a query
            worst[place[r["query"]]] = r["s"] if r["n"] == k else -2.0
        more = ~first & (np.cos(np.maximum(0, least - SLACK)) >= worst[:, None] - SLACK)
        self.read["pairs"] += least.size
        self.read["searched"] += int(first.sum() + more.sum())
        return best(found.unionByName(self._best(more, number, names, q, k, kind, worst - SLACK)))

    def _best(self, wanted: np.ndarray, number: np.ndarray, names: list, q: np.ndarray, k: int, kind: str, least: np.ndarray) -> DataFrame:
        """(query, key, similarity): the k best of each query in its wanted cells, of each task, that reach its least; other cells are not read."""
        key = self.key
        stored = self.spark.read.parquet(f"{self.path}/vectors")
        schema = f"query {kind}, `{key}` {dict(stored.dtypes)[key]}, similarity double"
        of = {int(c): np.flatnonzero(wanted[:, j]) for j, c in enumerate(number) if wanted[:, j].any()}
        shared = self.spark.sparkContext.broadcast((of, names, q, least))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of, names, q, least = shared.value
            kept = None
            for pdf in parts:
                kept = kept or Nearest(k, least, pdf[key].to_numpy().dtype)
                for cell, own in pdf.groupby("cell"):
                    asked, own = of[int(cell)], own.sort_values(key)
                    keys, units = own[key].to_numpy(), np.stack(own["unit"].to_list())
                    for at in range(0, len(keys), CHUNK):
                        kept.put(asked, keys[at : at + CHUNK], q[asked] @ units[at : at + CHUNK].T)
            if kept:
                row, keys, like = kept.rows()
                yield pd.DataFrame({"query": pd.Series(names).iloc[row].to_numpy(), key: keys, "similarity": like})

        return stored.filter(F.col("cell").isin(*of)).select(key, "unit", "cell").mapInPandas(run, schema)

"""Links inside large groups as spanning forests, so that a group gives no more rows than members.

A group (a cell of a grid, a bucket) holds members with labels; members of one label are known to be
connected. What is wanted is which labels the near pairs of the group connect, and for that one near
pair for each newly connected label is enough. Each group is searched breadth first: members that have
been reached are compared with those that have not, and whoever is near is reached. A group of copies is
reached in a step or two, after which nothing is left to compare; no group ever lists its pairs.

Groups of one label are left out. A group heavier than ``TILE_BYTES`` is dealt
into tiles, and every two tiles are searched together, so that a task holds two tiles at most while
each pair still meets somewhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import common

TILE_BYTES = 1 << 20
#: Groups of so many members are compared pair by pair in one array operation, all groups of a batch together.
SMALL = 6
#: Words of an array operation.
WORK = 1 << 20


def tiles(rows: DataFrame, scratch: common.Scratch, name: str, details: DataFrame | None = None, tile_bytes: int | None = None) -> DataFrame:
    """(cell, members): the members, array of structs, of each group with several labels, or of every two of its tiles.

    rows: (cell, node, label, bytes) and more columns, bytes being a member's weight in a task. details:
    more columns by node, joined to the members of groups with several labels only. Only heavy groups are
    counted before their members move, so all else is shuffled once.
    """
    limit = tile_bytes or TILE_BYTES
    heavy = rows.groupBy("cell").agg(F.sum("bytes").alias("total")).filter(F.col("total") > limit)
    heavy = scratch.write(heavy.select("cell", F.ceil(F.col("total") / limit).cast("int").alias("t")), f"{name}-heavy")
    dealt = rows.join(heavy, "cell", "left").withColumn("t", F.coalesce("t", F.lit(1)))
    dealt = dealt.withColumn("tile", F.when(F.col("t") > 1, F.pmod(F.xxhash64("node"), F.col("t"))).otherwise(0).cast("int"))
    member = F.struct(*(c for c in rows.columns if c not in ("cell", "bytes")))
    by = ["cell", "t", "tile"]
    held = dealt.groupBy(*by).agg(F.collect_list(member).alias("members"))
    held = held.filter((F.col("t") > 1) | F.exists("members", lambda m: m["label"] != F.get("members", F.lit(0))["label"]))
    held = scratch.write(held, f"{name}-tiles")
    if details is not None:
        open_ = held.select(*by, F.explode("members").alias("m")).select(*by, "m.*").join(details, "node")
        member = F.struct(*(c for c in open_.columns if c not in by))
        held = scratch.write(open_.groupBy(*by).agg(F.collect_list(member).alias("members")), f"{name}-detailed")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("t") - 1), lambda j: j != F.col("tile"))).alias("other")
    two = held.filter("t > 1").select("*", other).groupBy("cell", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q")).agg(F.flatten(F.collect_list("members")).alias("members"))
    return held.filter("t = 1").select("cell", "members").unionByName(two.select("cell", "members"))


class Groups:
    """The groups of a batch: where each begins, and the label of each member, numbered apart for each group."""

    def __init__(self, members: pa.Array) -> None:
        sizes = pc.list_value_length(members).to_numpy(zero_copy_only=False)
        self.values = pc.list_flatten(members)
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        codes = self.field("label").dictionary_encode()
        own = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.part = np.unique(self.of * max(1, len(codes.dictionary)) + own, return_inverse=True)[1] if len(own) else own

    def field(self, name: str) -> pa.Array:
        return pc.struct_field(self.values, name)

    def forest(self, near) -> tuple[np.ndarray, np.ndarray]:
        """Members (i, j): near pairs that connect all labels of a group that near pairs connect, without a cycle."""
        edges = [self._small(near), *(self._search(np.arange(a, a + n), near) for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True) if n > SMALL)]
        return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])

    def _small(self, near) -> tuple[np.ndarray, np.ndarray]:
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, SMALL + 1):
            starts = self.starts[self.sizes == n]
            for a in range(n if len(starts) else 0):
                for b in range(a + 1, n):
                    i.append(starts + a)
                    j.append(starts + b)
        i, j = np.concatenate(i), np.concatenate(j)
        apart = self.part[i] != self.part[j]
        i, j = i[apart], j[apart]
        hit = near.pairs(i, j) if len(i) else np.zeros(0, bool)
        i, j = i[hit], j[hit]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        keep = []
        for k, (x, y) in enumerate(zip(self.part[i].tolist(), self.part[j].tolist(), strict=True)):
            p, q = find(x), find(y)
            if p != q:
                up[p] = q
                keep.append(k)
        return i[keep], j[keep]

    def _search(self, own: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
        found, part = ([], []), self.part[own]
        names, sizes = np.unique(part, return_counts=True)
        left = np.ones(len(own), bool)
        for seed in names[np.argsort(-sizes, kind="stable")].tolist():  # the largest label first
            queue = np.flatnonzero(left & (part == seed))
            left[queue] = False
            step = 1
            while len(queue):
                rest = np.flatnonzero(left)
                if not len(rest):
                    break
                block, queue = queue[:step], queue[step:]
                step = min(2 * step, max(1, WORK // (len(rest) * near.words)))
                hit = near.block(own[block], own[rest])
                met = np.flatnonzero(hit.any(axis=0))
                if not len(met):
                    continue
                new, one = np.unique(part[rest[met]], return_index=True)
                found[0].append(own[block[hit[:, met[one]].argmax(axis=0)]])
                found[1].append(own[rest[met[one]]])
                reached = np.flatnonzero(left & np.isin(part, new))
                left[reached] = False
                queue = np.concatenate([queue, reached])
            if not left.any():
                break
        return tuple(np.concatenate([np.zeros(0, np.int64), *f]) for f in found)


class Bits:
    """Nearness of 64-bit fingerprints: at most ``radius`` different bits."""

    words = 1

    def __init__(self, fps: np.ndarray, radius: int) -> None:
        self.fps, self.radius = fps, radius

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[i] ^ self.fps[j]) <= self.radius

    def block(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[i][:, None] ^ self.fps[j][None, :]) <= self.radius


class Parities:
    """A bound of set similarity that loses nothing: maps of the parity of how many elements fall to each bit.

    Two maps differ in no more bits than their sets differ in elements, and sets of sizes a and b with
    a Jaccard similarity of s differ in (1 - s) / (1 + s) * (a + b) elements at most. A map has at least four bits an
    element, a power of two; the halves of a map, one laid on the other, are the map of half as many bits.
    """

    def __init__(self, maps: list[bytes], sizes: np.ndarray, similarity: float) -> None:
        self.sizes, self.similarity = sizes, similarity
        self.share = (1 - similarity) / (1 + similarity)
        lengths = np.array([len(m) for m in maps], np.int64)
        self.kind = np.log2(np.maximum(lengths, 8)).astype(np.int64) - 3
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(self.kind).tolist():
            same, above = np.flatnonzero(self.kind == k), np.flatnonzero(self.kind == k + 1)
            place = np.full(len(maps), -1, np.int64)
            place[same], place[above] = np.arange(len(same)), len(same) + np.arange(len(above))
            one = np.frombuffer(b"".join(maps[i] for i in same), np.uint64).reshape(len(same), 1 << k)
            two = np.frombuffer(b"".join(maps[i] for i in above), np.uint64).reshape(len(above), 2 << k)
            self.tables[k] = place, np.concatenate([one, two[:, : 1 << k] ^ two[:, 1 << k :]])
        self.words = 1 << max(self.tables, default=0)

    @staticmethod
    def of(hashes: np.ndarray) -> bytes:
        bits = max(512, 1 << (4 * len(hashes) - 1).bit_length()) if len(hashes) else 512
        odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(bool), bitorder="little").tobytes()

    def _over(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the bound is from what the similarity allows, pair by pair; 0 or less: may be similar."""
        out = np.ones(len(i))
        a, b = self.sizes[i], self.sizes[j]
        fits = (np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-9) & (np.abs(self.kind[i] - self.kind[j]) <= 1)
        low = np.minimum(self.kind[i], self.kind[j])
        for k, (place, table) in self.tables.items():
            own = np.flatnonzero(fits & (low == k))
            for some in np.array_split(own, max(1, (len(own) << k) // WORK)):
                bound = np.bitwise_count(table[place[i[some]]] ^ table[place[j[some]]]).sum(axis=1)
                most = self.share * (a[some] + b[some]) + 1e-9
                out[some] = np.where(bound <= most, bound / np.maximum(most, 1) - 1, 1.0)
        return out

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._over(i, j) <= 1e-9


    def block(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), len(j)), bool)
        for k, (place, table) in self.tables.items():
            for here, there in ((k, k), (k, k + 1), (k + 1, k)):
                x, y = np.flatnonzero(self.kind[i] == here), np.flatnonzero(self.kind[j] == there)
                step = max(1, WORK // max(1, len(y) << k))
                for at in range(0, len(x) if len(y) else 0, step):
                    some = x[at : at + step]
                    bound = np.bitwise_count(table[place[i[some]]][:, None, :] ^ table[place[j[y]]][None, :, :]).sum(axis=2)
                    a, b = self.sizes[i[some]][:, None], self.sizes[j[y]][None, :]
                    out[np.ix_(some, y)] = (bound <= self.share * (a + b) + 1e-9) & (np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-9)
        return out


class Exact:
    """Nearness of sets by their whole Jaccard similarity, where a bound that loses nothing does not exclude it."""

    def __init__(self, bound: Parities, sets: list[bytes], similarity: float) -> None:
        self.bound, self.words, self.similarity = bound, bound.words, similarity
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]

    def _true(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = self.sets[x], self.sets[y]
            if len(a) < len(b):
                a, b = b, a
            shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
            out[k] = shared >= self.similarity * (len(a) + len(b) - shared) - 1e-9
        return out

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = self.bound.pairs(i, j)
        out[out] = self._true(i[out], j[out])
        return out

    def block(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = self.bound.block(i, j)
        x, y = np.nonzero(out)
        out[x, y] = self._true(i[x], j[y])
        return out


def map_groups(groups: DataFrame, fn: Callable[[pa.RecordBatch, Groups], pa.RecordBatch], schema: str) -> DataFrame:
    """fn on the batches of (cell, members)."""
    return common.map_batches(groups, lambda batch: fn(batch, Groups(batch.column(1))), schema)

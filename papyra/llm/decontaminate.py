"""Benchmark decontamination: windows of the size of each benchmark item, found by SimHash, verified by shingles.

A document's shingles of ``SHINGLE`` words are hashed once. Windows as long as an item (in words) are
fingerprinted where they can matter: a window reaches the similarity only if enough of its shingles
are shingles of some item, so the others are passed over without loss. Each window and item has two
fingerprints, of its shingles with their repeats and of its distinct ones. A multi-index of ``BLOCKS``
blocks of bits finds all item fingerprints of that size within ``RADIUS`` bits: two that are no further
apart differ in RADIUS // BLOCKS bits at most in one block. What it finds is verified by the weighted
Jaccard similarity of the two bags of shingles, each weighted with its repeats.

The windows that the index names for an item are verified, and those that overlap with them, so that the
best one is reported. 64 bits scatter, so a similar window may lie beyond the radius: on the supplied tables the index
finds all pairs (the tests measure it), and it may miss one in some thousands. Bags with many repeats scatter
further; for items less than half of whose shingles are distinct the windows that hold enough of their shingles are candidates
as well. ``exhaustive`` adds these for all items; then no pair above the similarity is missed.

Words are maximal runs without white space, A-Z lower-cased. An item of fewer words than a shingle is
one shingle and must be found whole; an item without words matches nothing. Null and empty texts
match nothing; very long texts are taken whole; items with equal words all match; of equal windows the
first is reported; repeated rows are all judged; an empty table or benchmark gives an empty table;
other columns of the documents stay out of ``matches`` and as they are in ``clean``.

The benchmark is the stated query set. It is taken in blocks of at most ``BLOCK_BYTES`` of text, each
of which is one pass over the documents with that block broadcast.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import common
from papyra.llm.anchors import BASE_A, Rolling
from papyra.llm.simhash import bit_counts

SHINGLE = 5
SIMILARITY = 0.8
#: Shingle bags at similarity 0.8 have a cosine of 0.89, so a bit differs with chance 0.15: 9.7 bits, with a deviation of 2.9.
RADIUS = 19
BLOCKS = 4
BLOCK_BYTES = 16 << 20
#: Shingles that are gathered at a time.
WORK = 1 << 20


class Words:
    """A text's words, and hashes of its runs of words."""

    def __init__(self, text: bytes) -> None:
        words = text.lower().split()
        self.joined = b" ".join(words)
        data = np.frombuffer(self.joined, np.uint8)
        self.ends = np.append(np.flatnonzero(data == 32), len(data)) if words else np.zeros(0, np.int64)
        self.starts = np.append(0, self.ends[:-1] + 1) if words else self.ends
        self.rolling = Rolling(data, BASE_A) if words else None

    def __len__(self) -> int:
        return len(self.ends)

    def hashes(self, size: int) -> np.ndarray:
        if len(self) < size:
            return np.zeros(0, np.uint64)
        return self.rolling.of(self.starts[: len(self) - size + 1], self.ends[size - 1 :])

    def run(self, at: int, size: int) -> bytes:
        return self.joined[self.starts[at] : self.ends[at + size - 1]]


def fingerprint(over: np.ndarray) -> np.ndarray:
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """(windows, 2): of all shingles of each window, and of its distinct ones."""
    windows = np.sort(hashes[starts[:, None] + np.arange(width)], axis=1)
    whole = fingerprint(bit_counts(windows.reshape(-1), np.arange(0, windows.size, width)) * 2 > width)
    new = np.ones(windows.shape, bool)
    new[:, 1:] = windows[:, 1:] != windows[:, :-1]
    n = new.sum(axis=1)
    if (n == width).all():
        return np.stack([whole, whole], axis=1)
    return np.stack([whole, fingerprint(bit_counts(windows[new], np.cumsum(n) - n) * 2 > n[:, None])], axis=1)


@lru_cache(maxsize=64)
def flips(width: int, most: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``most`` bits set."""
    x = np.arange(1 << width, dtype=np.uint64)
    return x[np.bitwise_count(x) <= most]


class MultiIndex:
    """All stored fingerprints within ``radius`` of a query: in one of the blocks they differ in radius // blocks bits at most."""

    def __init__(self, fps: np.ndarray, radius: int, blocks: int = BLOCKS) -> None:
        self.fps, self.radius, self.reach = fps, radius, radius // blocks
        edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
        self.blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        self.tables = []
        for shift, width in self.blocks:
            values = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], order))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, stored) within the radius."""
        codes = []
        for (shift, width), (values, order) in zip(self.blocks, self.tables, strict=True):
            own, of = np.unique((queries >> np.uint64(shift)) & np.uint64((1 << width) - 1), return_inverse=True)
            masks = flips(width, self.reach)
            for k, v in enumerate(own):
                probes = v ^ masks
                a, b = np.searchsorted(values, probes, "left"), np.searchsorted(values, probes, "right")
                hit = np.flatnonzero(b > a)
                if len(hit):
                    found = order[np.concatenate([np.arange(a[h], b[h]) for h in hit])]
                    asked = np.flatnonzero(of == k)
                    codes.append((asked[:, None] * len(self.fps) + found[None, :]).reshape(-1))
        q, s = np.divmod(np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64), max(1, len(self.fps)))
        near = np.bitwise_count(queries[q] ^ self.fps[s]) <= self.radius
        return q[near], s[near]


class Item:
    """Items of equal words: their ids, the bag of their shingles by number, and how many a window must share."""

    def __init__(self, ids: list[int], shingles: list[int], similarity: float) -> None:
        self.ids, self.width, self.bag = ids, len(shingles), Counter(shingles)
        self.known = np.unique(np.array(shingles))
        self.repeats = 2 * len(self.known) < self.width
        self.need = int(np.ceil(2 * self.width * similarity / (1 + similarity) - 1e-9))


class Items:
    """A block of the benchmark, indexed."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int, similarity: float, radius: int) -> None:
        self.shingle, self.similarity = shingle, similarity
        of: dict[bytes, list[int]] = {}
        for item, text in rows:
            words = b" ".join((text or "").encode().lower().split())
            if words:
                of.setdefault(words, []).append(item)
        self.short: dict[int, dict[int, list[tuple[list[int], bytes]]]] = {}
        self.numbers: dict[bytes, int] = {}
        self.items: list[Item] = []
        sized: dict[int, list[int]] = {}
        hashes: list[np.ndarray] = []
        for text, ids in of.items():
            words = Words(text)
            if len(words) < shingle:
                self.short.setdefault(len(words), {}).setdefault(int(words.hashes(len(words))[0]), []).append((ids, text))
                continue
            own = [self.numbers.setdefault(words.run(k, shingle), len(self.numbers)) for k in range(len(words) - shingle + 1)]
            sized.setdefault(len(own), []).append(len(self.items))
            self.items.append(Item(ids, own, similarity))
            hashes.append(words.hashes(shingle))
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.holders: dict[int, list[int]] = {}
        for i, item in enumerate(self.items):
            for n in item.known.tolist():
                self.holders.setdefault(n, []).append(i)
        self.sizes = {}
        for width, own in sized.items():
            fps = np.concatenate([fingerprints(hashes[i], np.zeros(1, np.int64), width) for i in own])
            self.sizes[width] = (np.array(own), MultiIndex(fps[:, 0], radius), MultiIndex(fps[:, 1], radius))

    def search(self, text: bytes, exhaustive: bool = False) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window of each item that a text holds."""
        words = Words(text)
        best: dict[int, tuple[float, int, int]] = {}
        for n, own in self.short.items():
            hashes = words.hashes(n)
            for at in np.flatnonzero(np.isin(hashes, np.fromiter(own, np.uint64, len(own)))).tolist():
                for ids, known in own[int(hashes[at])]:
                    if known == words.run(at, n):
                        for i in ids:
                            best.setdefault(i, (1.0, -at, n))
        hashes = words.hashes(self.shingle)
        if len(hashes) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            if len(hit):
                numbers = np.full(len(hashes), -1)
                numbers[hit] = [self.numbers.get(words.run(k, self.shingle), -1) for k in hit.tolist()]
                self._windows(hashes, numbers, best, exhaustive)
        return [(item, -at, n, s) for item, (s, at, n) in best.items()]

    def _windows(self, hashes: np.ndarray, numbers: np.ndarray, best: dict, exhaustive: bool) -> None:
        held = np.append(0, np.cumsum(numbers >= 0))
        here: dict[int, list[int]] = {}
        for i in {i for n in np.unique(numbers[numbers >= 0]).tolist() for i in self.holders[n]}:
            here.setdefault(self.items[i].width, []).append(i)
        for width, present in here.items():
            if width > len(hashes):
                continue
            starts = np.flatnonzero(held[width:] - held[:-width] >= self.items[present[0]].need)
            if not len(starts):
                continue
            own, *indexes = self.sizes[width]
            found: set[tuple[int, int]] = set()
            for some in np.array_split(starts, -(-len(starts) * width // WORK)):
                fps = fingerprints(hashes, some, width)
                for index, f in zip(indexes, fps.T, strict=True):
                    q, s = index.search(np.ascontiguousarray(f))
                    found.update(zip(own[s].tolist(), some[q].tolist(), strict=True))
            wanted: dict[int, list[np.ndarray]] = {}
            for i, start in found:
                a, b = np.searchsorted(starts, (start - width + 1, start + width))
                wanted.setdefault(i, []).append(starts[a:b])
            for i in present:
                if exhaustive or self.items[i].repeats:
                    count = np.append(0, np.cumsum(np.isin(numbers, self.items[i].known)))
                    wanted.setdefault(i, []).append(starts[(count[width:] - count[:-width])[starts] >= self.items[i].need])
            for i, some in wanted.items():
                self._verify(self.items[i], numbers, np.unique(np.concatenate(some)).tolist(), best)

    def _verify(self, item: Item, numbers: np.ndarray, starts: list[int], best: dict) -> None:
        """The exact weighted similarity of each window; neighbouring windows differ by a shingle at either end."""
        width, last, bag, shared = item.width, -2, {}, 0
        for start in starts:
            if start == last + 1:
                out, new = int(numbers[last]), int(numbers[last + width])
                shared -= out in item.bag and bag[out] <= item.bag[out]
                bag[out] = bag.get(out, 0) - 1
                shared += new in item.bag and bag.get(new, 0) < item.bag[new]
                bag[new] = bag.get(new, 0) + 1
            else:
                bag = Counter(numbers[start : start + width].tolist())
                shared = (bag & item.bag).total()
            last = start
            similarity = shared / (2 * width - shared)
            if similarity >= self.similarity - 1e-12:
                for i in item.ids:
                    best[i] = max(best.get(i, (0.0, 0, 0)), (similarity, -start, width + self.shingle - 1))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES, exhaustive: bool = False) -> DataFrame:
    """(key, item_id, start_word, n_words, similarity): the best window of each item in each document that holds it."""
    spark = docs.sparkSession
    own = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    blocks = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    schema = f"`{key}` {dict(docs.dtypes)[key]}, item_id long, start_word long, n_words long, similarity double"
    out = None
    for k in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in rows], shingle, similarity, radius))

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            items, at, found = shared.value, [], []
            for i, t in enumerate(common.text_bytes(batch.column(1))):
                got = items.search(t, exhaustive)
                at += [i] * len(got)
                found += got
            columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=[key, "item_id", "start_word", "n_words", "similarity"])

        part = common.map_batches(docs.select(key, text), run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; their columns stay as they are. Rows that share a key, null too, go together."""
    scratch = common.Scratch(docs.sparkSession, "decontaminate")
    (name,) = common.fresh(docs, "__held")
    held = scratch.write(matches(docs, benchmark, key, text).select(F.col(key).alias(name)).distinct(), "held")
    return docs.join(held, docs[key].eqNullSafe(F.col(name)), "left_anti").select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

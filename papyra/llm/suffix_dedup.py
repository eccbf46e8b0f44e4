"""Removal of byte strings that stand earlier in the corpus, by suffix arrays over partitioned suffixes.

A window is a string of ``width`` bytes. A byte goes if a window over it also starts earlier (smaller
key, or same row and earlier place). Three steps find all such windows:

1. *Segments.* Equal windows have equal anchors (see anchors.py), so suffixes are dealt by their
   window's anchor hash; runs of windows with one anchor travel as one row of hashes. Equal segments are
   told apart from unequal ones by hash, first inside each task, so that a segment that a third of all
   rows hold is shuffled once a task, then in the shuffle: all but the first go whole.
2. *Suffix arrays.* Different segments with one anchor may share some windows. Their bytes are fetched,
   cut by the anchor's offset into pieces with a core of ``width - SHARE + 1`` bytes that all windows of
   the piece contain, and dealt by the core's hash; cores that stand alone drop out. The others are packed into blocks, whose suffixes are sorted in two stages (suffix_sort.py). Adjacent
   suffixes with a common prefix of ``width`` bytes are equal windows; all but the first go.
   A core with more than ``HOT`` pieces is not packed: its windows are hashed one by one with 128 bits
   and the first of each is found by an aggregation, which is exact and bounded whatever the group.
3. *Spans.* A document's windows are joined into maximal runs of bytes.

Null and empty texts, and texts shorter than a window, lose nothing; very long texts are taken in
overlapping stretches. Rows with a null key come first. Rows that share a key are one document: they
do not remove each other's bytes at equal places. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm import anchors, common
from papyra.llm.suffix_sort import common_prefixes, suffix_array

WIDTH = 100
GRAM = 32
#: Offsets of the anchor that share a piece.
SHARE = 35
STRETCH = 1 << 20
#: Rows of segments that a task compares at a time.
LOCAL = 1 << 18
BLOCK = 1 << 20
HOT = 4096
#: Whether equal segments are sorted as well instead of settled by 128 bits of hash: the same result for more work (README).
SORT_ALL = False
FIRST = -(1 << 63)


def _stretches(ids: list[int], texts: list[bytes], width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """About STRETCH bytes at a time: bytes, keys, each text's offset and length in it; long texts overlap by a window less one byte."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(t) - width + 1), STRETCH):
            part = t[at : at + STRETCH + width - 1] if len(t) > STRETCH else t
            parts.append((i, at, part))
            size += len(part)
            if size >= STRETCH:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    return b"".join(p for _, _, p in parts), np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts]), np.array([len(p) for _, _, p in parts])


def packed(low: np.ndarray, span: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return low << 16 | span << 8 | offset


def segments(docs: DataFrame, width: int, gram: int, sort_all: bool = False) -> DataFrame:
    """(anchor, inner, id, place, dead) of segments, docs: (id, text); dead ones have an equal, earlier one in their task.

    The anchor of a dead one is a hash of its place, so that it stands alone and hot anchors stay few rows.

    place: first window << 16 | further windows << 8 | offset of the anchor.
    """
    schema = "anchor long, inner long, id long, place long, dead boolean"

    def emit(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, inner, ids, place = (np.concatenate(c) for c in zip(*rows, strict=True))
        both = anchors.mix(anchor + np.uint64(0x2545F4914F6CDD1D)) ^ inner
        order = np.lexsort((place, ids, both))
        equal = np.append(False, both[order][1:] == both[order][:-1])
        order = order[~(equal & np.append(False, (ids[order][1:] == ids[order][:-1]) & (place[order][1:] == place[order][:-1])))]
        again = np.append(False, both[order][1:] == both[order][:-1]) & (not sort_all)
        alone = anchors.mix(ids[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place[order].astype(np.uint64))
        got = [pa.array(np.where(again, alone, anchor[order]).view(np.int64)), pa.array(inner[order].view(np.int64)), pa.array(ids[order]), pa.array(place[order]), pa.array(again)]
        return pa.RecordBatch.from_arrays(got, schema=common.arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for part in common.slices(batch, 8 << 20):
                for data, ids, at, lengths in _stretches(part.column(0).to_pylist(), common.text_bytes(part.column(1)), width):
                    ends = np.cumsum(lengths)
                    of, low, high, anchor, hashed, inner = anchors.segments(np.frombuffer(data, np.uint8), ends - lengths, ends, width, gram)
                    if not len(of):
                        continue
                    rows.append((hashed, inner, ids[of], packed(low - (ends - lengths)[of] + at[of], high - low, anchor - low)))
                    held += len(of)
                if held >= LOCAL:
                    yield from _cut(emit(rows))
                    rows, held = [], 0
        if rows:
            yield from _cut(emit(rows))

    return common.map_stream(docs, run, schema)


def _cut(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def marks(found: DataFrame, sort_all: bool = False) -> DataFrame:
    """(id, place, gone): segments with an equal, earlier one (gone), and first segments whose anchor has another, different one; with sort_all all segments whose anchor has another."""
    if sort_all:
        shared = found.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).filter("n > 1")
        return shared.select("id", "place", F.lit(False).alias("gone"))
    own, group = Window.partitionBy("anchor", "inner"), Window.partitionBy("anchor")
    live = found.repartition("anchor").withColumn("first", F.min(F.struct("id", "place")).over(own))
    live = live.withColumn("a", F.min("inner").over(group)).withColumn("b", F.max("inner").over(group))
    gone = F.col("dead") | (F.struct("id", "place") != F.col("first"))
    return live.withColumn("gone", gone).filter("gone or a <> b").select("id", "place", "gone")


def pieces(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(core, id, low, bytes): the pieces of first segments; core hashes what all windows of a piece contain. places: (id, places)."""
    schema = "core binary, id long, low long, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 8 << 20):
                core, ids, lows, data = [], [], [], []
                for i, t, own in zip(part.column(0).to_pylist(), common.text_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    for place in own:
                        low, span, offset = place >> 16, place >> 8 & 255, place & 255
                        # offsets run from offset down to offset - span as the window moves on
                        for share in range((offset - span) // SHARE, offset // SHARE + 1):
                            a = max(low, low + offset - (share * SHARE + SHARE - 1))
                            b = min(low + span, low + offset - share * SHARE)
                            # the core of the share, not of the windows that happen to be here
                            c0, c1 = low + offset - share * SHARE, low + offset - (share * SHARE + SHARE - 1) + width
                            core.append(hashlib.blake2b(t[c0:c1], digest_size=16, salt=share.to_bytes(1, "little")).digest())
                            ids.append(i)
                            lows.append(a)
                            data.append(t[a : b + width])
                if ids:
                    yield from _cut(pa.RecordBatch.from_arrays([pa.array(core, pa.binary()), pa.array(ids, pa.int64()), pa.array(lows, pa.int64()), pa.array(data, pa.binary())], schema=common.arrow_schema(schema)))

    return common.map_stream(docs.join(places, "id").select("id", "text", "places"), run, schema)


def repeated_windows(block: list[tuple[int, int, bytes]], width: int) -> list[tuple[int, int]]:
    """(index in block, place in its bytes) of windows that an earlier piece, or place, has too; block: (id, low, bytes) pieces."""
    data = b"\xff".join(p for _, _, p in block)  # no UTF-8 text has this byte
    lengths = np.array([len(p) for _, _, p in block])
    starts = np.cumsum(lengths + 1) - lengths - 1
    order = suffix_array(data, width)
    of = np.searchsorted(starts, order, "right") - 1
    fits = order + width <= (starts + lengths)[of]
    order, of = order[fits], of[fits]
    if len(order) < 2:
        return []
    equal = common_prefixes(data, order, width) >= width
    run = np.cumsum(~equal)
    ids, places = np.array([i for i, _, _ in block])[of], np.array([low for _, low, _ in block])[of] + order - starts[of]
    by = np.lexsort((places, ids, run))
    again = np.append(False, run[by][1:] == run[by][:-1])
    same = np.append(False, (ids[by][1:] == ids[by][:-1]) & (places[by][1:] == places[by][:-1]))
    return list(zip(of[by][again & ~same].tolist(), (order - starts[of])[by][again & ~same].tolist(), strict=True))


def sorted_blocks(dealt: DataFrame, width: int) -> DataFrame:
    """(id, low, high): repeated windows of pieces that are sorted by core within their partitions."""
    schema = "id long, low long, high long"

    def flush(block: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        got = [(block[k][0], block[k][1] + at) for k, at in repeated_windows(block, width)]
        ids, low = np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64)
        order = np.lexsort((low, ids))
        ids, low = ids[order], low[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (low[1:] != low[:-1] + 1))[: len(ids)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids))[: len(first)] - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(low[first]), pa.array(low[last])], schema=common.arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, bytes]] = []
        group: list[tuple[int, int, bytes]] = []
        size, now = 0, None
        for batch in batches:
            for core, *piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if core != now:
                    if len(group) > 1:
                        block += group
                        size += sum(len(p) + 1 for _, _, p in group)
                        if size >= BLOCK:
                            yield flush(block)
                            block, size = [], 0
                    group, now = [], core
                group.append(tuple(piece))
        block += group if len(group) > 1 else []
        if block:
            yield flush(block)

    return common.map_stream(dealt, run, schema)


def hot_windows(hot: DataFrame, width: int) -> DataFrame:
    """(id, low, high): repeated windows of crowded cores, one by one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(hashlib.blake2b(p[k : k + width], digest_size=16).digest(), i, low + k) for i, low, p in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True) for k in range(len(p) - width + 1)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["window", "id", "low"])

    windows = common.map_batches(hot, run, "window binary, id long, low long", 1 << 20)
    first = windows.groupBy("window").agg(F.min(F.struct("id", "low")).alias("first"))
    again = windows.join(first, "window").filter(F.struct("id", "low") != F.col("first"))
    return again.select("id", "low", F.col("low").alias("high"))


def repeats(docs: DataFrame, scratch: common.Scratch, width: int = WIDTH, gram: int = GRAM, sort_all: bool = SORT_ALL) -> DataFrame:
    """(id, spans): for each document that has any, its repeated windows as array of (low, high); docs: (id, text). With sort_all equal segments go through the sort too."""
    found = scratch.write(marks(segments(docs, width, gram, sort_all), sort_all), "marks")
    places = found.filter("not gone").groupBy("id").agg(F.collect_list("place").alias("places"))
    cut = scratch.write(pieces(docs, places, width), "pieces")
    hot = scratch.write(cut.groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("core"), "hot")
    crowded = bool(hot.take(1))
    shared = cut.join(hot, "core", "left_anti") if crowded else cut
    dealt = shared.select("core", "id", "low", "bytes").repartition("core").sortWithinPartitions("core", "id", "low")
    again = sorted_blocks(dealt, width)
    if crowded:
        again = again.unionByName(hot_windows(cut.join(hot, "core", "left_semi"), width))
    low = F.shiftright("place", 16)
    whole = found.filter("gone").select("id", low.alias("low"), (low + F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("high"))
    spans = scratch.write(whole.unionByName(again).groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    scratch.drop("marks", "pieces", "hot")
    return spans


def covered(windows: list[tuple[int, int]], width: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows low to high."""
    out: list[list[int]] = []
    for low, high in sorted(windows):
        end = min(size, high + width)
        if low >= end:
            continue
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([low, end])
    return [(a, b) for a, b in out]


def _apply(docs: DataFrame, key: str, text: str, width: int, gram: int, change, added: dict[str, str]) -> DataFrame:
    """docs with the columns added (name to type) that change(text, runs) makes of each text."""
    scratch = common.Scratch(docs.sparkSession, "suffix-dedup")
    number = F.coalesce(F.col(key).cast("long"), F.lit(FIRST))
    spans = repeats(docs.select(number.alias("id"), F.col(text).alias("text")), scratch, width, gram)
    own, types = docs.columns, dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in ({c: types[c] for c in own} | added).items())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, windows in zip(common.text_bytes(batch.column(own.index(text))), batch.column(len(own)).to_pylist(), strict=True):
            rows.append(change(t, covered([(w["low"], w["high"]) for w in windows or ()], width, len(t))))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), *(pa.array([r[k] for r in rows], ADDED[t]) for k, t in enumerate(added.values()))], names=[*own, *added])

    id_, windows = common.fresh(docs, "__id", "__windows")
    joined = docs.withColumn(id_, number).join(spans.select(F.col("id").alias(id_), F.col("spans").alias(windows)), id_, "left").select(*own, windows)
    return common.map_batches(joined, run, schema)


SPANS = "array<struct<start: bigint, end: bigint>>"
ADDED = {"binary": pa.binary(), SPANS: pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "string": pa.string()}


def _parts(t: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    edges = [0, *(x for run in runs for x in run), len(t)]
    return [t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """All columns of docs, with __kept (the bytes that stay) and __spans (removed runs: array of start and end) added; with more underscores where docs has these names."""

    def change(t: bytes, runs: list[tuple[int, int]]):
        return b"".join(_parts(t, runs)), [{"start": a, "end": b} for a, b in runs]

    kept, spans = common.fresh(docs, "__kept", "__spans")
    return _apply(docs, key, text, width, gram, change, {kept: "binary", spans: SPANS})


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated strings taken out of the texts, and what a cut leaves of a character at its edge. Null texts stay null."""

    def change(t: bytes, runs: list[tuple[int, int]]):
        return ("".join(p.decode(errors="ignore") for p in _parts(t, runs)),)

    (cut,) = common.fresh(docs, "__text")
    out = _apply(docs, key, text, width, gram, change, {cut: "string"})
    return out.select(*(F.when(F.col(text).isNotNull(), F.col(cut)).alias(c) if c == text else c for c in docs.columns))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses and keeps."""
    out = deduplicate(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )

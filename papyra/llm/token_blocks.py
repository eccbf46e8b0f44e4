"""Token ids in a binary file format of patched frame-of-reference blocks.

A file holds the ids of documents in ascending key order, cut into blocks of ``BLOCK`` ids:

* the block's minimum is subtracted, the rest packed at the width that ``PERCENTILE`` of its values need;
* values that need more bits are exceptions: their places and full values follow the packed words;
* the footer indexes the byte at which each block starts, and each document's key and first id,
  so one document, or any run of ids, is read without unpacking what stands before it.

Layout (little-endian): magic; blocks (u32 minimum, u16 ids, u8 width, u8 zero, u32 exceptions,
packed u64 words, u16 places, u32 values); u64 block starts; i64 keys; u8 key-is-null flags;
u64 document starts; then u64 ids, u64 documents, u64 blocks, u64 footer place, magic.

Files are written to the shared folder under a name of the task's attempt; a manifest lists those of
the attempts that ended well, so lost executors and repeated attempts leave nothing that is read.

A null text counts as empty and has only the end id; a null key sorts first and is kept as null;
repeated keys keep all their rows; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm import common

MAGIC = b"PFORIDS1"
BLOCK = 1024
PERCENTILE = 0.95
END_ID = 0
HEAD = struct.Struct("<IHBBI")
TAIL = struct.Struct("<QQQQ8s")
#: Most units that a worker keeps, and about how many of their ids.
UNITS, UNIT_IDS = 1_000_000, 8_000_000
UNIT = re.compile(r"(?<=\S) (?=\S)")
#: White space beside white space, or other than spaces and line feeds; plain searches are cheaper than a pattern.
UNEVEN = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


# --- blocks ----------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) values below 2**width as (rows, BLOCK * width / 64) words."""
    lanes = values.reshape(len(values), BLOCK // 64, 64).astype(np.uint64)
    words = np.zeros((len(values), BLOCK // 64, width), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        words[:, :, word] |= lanes[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= lanes[:, :, j] >> np.uint64(64 - shift)
    return words.reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(-1, BLOCK // 64, width) if width else words
    rows = len(words)
    out = np.zeros((rows, BLOCK // 64, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        v = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, j] = v & mask
    return out.reshape(rows, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of BLOCK ids each, the last one possibly shorter."""
    if not len(ids):
        return []
    count = -(-len(ids) // BLOCK)
    full = np.full(count * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    rows = full.reshape(count, BLOCK)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    at = np.partition(rest, rank, axis=1)[:, rank]
    widths = np.where(at > 0, np.floor(np.log2(np.maximum(at, 1).astype(np.float64))).astype(np.int64) + 1, 0)
    out: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        limit = np.uint64(1) << np.uint64(width)
        values = rest[own]
        beyond = values.astype(np.uint64) >= limit
        words = pack(values & np.uint32((1 << width) - 1), width)
        for k, row in enumerate(own.tolist()):
            n = min(BLOCK, len(ids) - row * BLOCK)
            places = np.flatnonzero(beyond[k]).astype("<u2")
            out[row] = HEAD.pack(int(low[row]), n, width, 0, len(places)) + words[k].astype("<u8").tobytes() + places.tobytes() + values[k][places].astype("<u4").tobytes()
    return out


def decode_block(data: bytes) -> np.ndarray:
    low, n, width, _, exceptions = HEAD.unpack_from(data)
    at = HEAD.size + BLOCK // 64 * width * 8
    words = np.frombuffer(data, "<u8", BLOCK // 64 * width, HEAD.size)
    values = unpack(words.reshape(1, -1), width)[0] if width else np.zeros(BLOCK, np.uint32)
    if exceptions:
        values[np.frombuffer(data, "<u2", exceptions, at)] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    return values[:n] + np.uint32(low)


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of adjacent blocks; starts: their byte places in data. Blocks of one width are unpacked together."""
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    out = np.zeros((len(heads), BLOCK), np.uint32)
    widths = np.array([h[2] for h in heads])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        if width:
            words = np.stack([np.frombuffer(data, "<u8", BLOCK // 64 * width, int(starts[i]) + HEAD.size) for i in own])
            out[own] = unpack(words, width)
    for i, (low, _, width, _, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[i]) + HEAD.size + BLOCK // 64 * width * 8
            out[i, np.frombuffer(data, "<u2", exceptions, at)] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
        out[i] += np.uint32(low)
    flat = out.reshape(-1)
    return flat[: (len(heads) - 1) * BLOCK + heads[-1][1]] if heads else flat


# --- files -----------------------------------------------------------------


class Writer:
    """One file; keeps no more than the ids of an unfinished block group and the document index."""

    def __init__(self, uri: str, name: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path, recursive=True)
        self.uri = f"{uri}/{name}"
        self.out = fs.open_output_stream(f"{path}/{name}", compression=None)
        self.out.write(MAGIC)
        self.place, self.ids, self.documents = len(MAGIC), 0, 0
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.starts: list[int] = []
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        ends = np.cumsum(lengths)
        self.keys.append(keys)
        self.nulls.append(nulls)
        self.firsts.append(self.ids + ends - lengths)
        self.ids += int(ends[-1]) if len(ends) else 0
        self.documents += len(keys)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 1024 * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        keep = 0 if last else len(ids) % BLOCK
        for block in encode_blocks(ids[: len(ids) - keep]):
            self.starts.append(self.place)
            self.out.write(block)
            self.place += len(block)
        self.pending, self.waiting = [ids[len(ids) - keep :]], keep

    def close(self) -> None:
        self.flush(True)
        join = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes() if parts else b""
        self.out.write(np.array(self.starts, "<u8").tobytes() + join(self.keys, "<i8") + join(self.nulls, "u1") + join(self.firsts, "<u8"))
        self.out.write(TAIL.pack(self.ids, self.documents, len(self.starts), self.place, MAGIC))
        self.out.close()


class Reader:
    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.ids, documents, blocks, at, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no complete token file")
        foot = self.file.read_at(size - TAIL.size - at, at)
        self.starts = np.append(np.frombuffer(foot, "<u8", blocks), at).astype(np.int64)
        self.keys = np.frombuffer(foot, "<i8", documents, 8 * blocks)
        self.nulls = np.frombuffer(foot, "u1", documents, 8 * (blocks + documents))
        self.firsts = np.append(np.frombuffer(foot, "<u8", documents, 8 * (blocks + documents) + documents), self.ids).astype(np.int64)

    def slice(self, first: int, end: int) -> np.ndarray:
        """Ids first to end - 1, from the blocks that hold them only."""
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-end // BLOCK)
        data = self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
        return decode_blocks(data, self.starts[a:b] - self.starts[a])[first - a * BLOCK : end - a * BLOCK]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end, their ids) in groups of about ``most`` ids."""
        a = 0
        while a < len(self.keys):
            b = max(a + 1, min(len(self.keys), int(np.searchsorted(self.firsts, self.firsts[a] + most, "right")) - 1))
            yield a, b, self.slice(int(self.firsts[a]), int(self.firsts[b]))
            a = b


# --- encoding --------------------------------------------------------------


EMPTY = np.zeros(0, np.uint32)
#: Marks the cuts; white space, so that no text with it is cut by it.
CUT = "\x1f"


class Encoder:
    """Whole texts to ids by the tokenizers library, each distinct unit once while it is kept.

    A text is cut into units where no pre-token crosses: before single spaces, and around single line
    feeds, that stand between characters that are not white space. The distinct units of a batch of texts
    that are not kept yet go through the library's encode together; each text's ids are then gathered.
    A text that holds one of the file's added tokens goes through encode as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.lengths, self.ids = np.zeros(0, np.int64), EMPTY

    def _places(self, units: pa.Array) -> np.ndarray:
        """Places of distinct units among those kept."""
        if len(self.known) > UNITS or len(self.ids) > UNIT_IDS:
            self._clear()
        at = pc.index_in(units, value_set=self.known)
        new = units.filter(at.is_null())
        if len(new):
            lengths, ids = self._encoded(new)
            at = pc.coalesce(at, pa.array(np.cumsum(at.is_null().to_numpy(zero_copy_only=False)) - 1 + len(self.known), pa.int32()))
            self.known = pa.concat_arrays([self.known, new])
            self.lengths, self.ids = np.append(self.lengths, lengths), np.append(self.ids, ids)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def _encoded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each unit has, and all ids. Units go to the library in lines; a line feed has an id that no other unit holds."""
        feed = self.tokenizer.token_to_id("\u010a")
        alone = pc.equal(units, "\n").to_numpy(zero_copy_only=False)
        lines = units.filter(pa.array(~alone))
        step = 1000
        cuts = pa.array(np.append(np.arange(0, len(lines), step), len(lines)), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, lines.cast(pa.string())), "\n").to_pylist()
        flat = [np.array([*e.ids, feed], np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate(flat) if flat else EMPTY
        ends = np.flatnonzero(flat == feed)
        lengths = np.ones(len(units), np.int64)
        lengths[~alone] = np.diff(ends, prepend=-1) - 1
        ids = np.full(int(lengths.sum()), feed, np.uint32)
        ids[np.repeat(~alone, lengths)] = flat[flat != feed]
        return lengths, ids

    def _even(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose only white space is single spaces and line feeds inside them, and how many each has."""
        marked = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.large_string()), " ", f"{CUT} "), "\n", f"{CUT}\n{CUT}")
        units = pc.split_pattern(marked, CUT)
        counts = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(units).dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.lengths[at]
        total = np.cumsum(n)
        ids = self.ids[np.repeat(np.cumsum(self.lengths)[at] - total, n) + np.arange(total[-1])]
        return ids, np.add.reduceat(n, np.cumsum(counts) - counts)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        even, out = [], [EMPTY] * len(texts)
        for k, t in enumerate(texts):
            if any(x in t for x in self.added):
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            elif any(x in t for x in UNEVEN) or t[:1].isspace() or t[-1:].isspace():
                first, *rest = UNIT.split(t)
                out[k] = np.array([i for e in self.tokenizer.encode_batch_fast([first, *(" " + r for r in rest)], add_special_tokens=False) for i in e.ids], np.uint32)
            elif t:
                even.append(k)
        if even:
            ids, lengths = self._even([texts[k] for k in even])
            if len(even) == len(texts):
                return ids, lengths
            for k, own in zip(even, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                out[k] = own
        return np.concatenate(out) if out else EMPTY, np.array([len(o) for o in out], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Text of a file, about, where the session has fewer partitions.
FILE_BYTES = 256 << 20
MANIFEST = "file string, first_key long, first_mix long, documents long, ids long, bytes long"


def write_ids(docs: DataFrame, out: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encode whole texts, append end_id to each, write them in ascending key order to files under out; returns the manifest.

    The texts are dealt by ranges of the key, and of a hash of the text where one key (null, for one) has many rows,
    before they are encoded, so each task writes one file of adjacent documents as it encodes them. files: the number of ranges, by
    default the session's shuffle partitions, or more so that a file has about FILE_BYTES of text.
    """
    spark = docs.sparkSession
    if files is None:
        total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mix")).repartitionByRange(files, "key", "mix").sortWithinPartitions("key", "mix")
    schema = MANIFEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, least, mix = None, None, None
        for batch in batches:
            for part in common.slices(batch, 8 << 20):
                if writer is None:
                    writer, least, mix = Writer(out, f"ids-{uuid.uuid4().hex}.pfor"), part.column(0)[0].as_py(), part.column(2)[0].as_py()
                ids, lengths = encoder(tokenizer_path).texts([x or "" for x in part.column(1).to_pylist()])
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                keys = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                nulls = part.column(0).is_null().to_numpy(zero_copy_only=False)
                writer.add(keys, nulls, lengths + 1, ids)
        if writer is not None:
            writer.close()
            row = {"file": [writer.uri], "first_key": [least], "first_mix": [mix], "documents": [writer.documents], "ids": [writer.ids], "bytes": [writer.place]}
            yield pa.RecordBatch.from_pydict(row, schema=common.arrow_schema(schema))

    common.map_stream(dealt, run, schema).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.schema(schema).parquet(f"{out}/manifest")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids from the files, and how many ids stand before it in all files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    order = Window.orderBy(F.col("first_key").asc_nulls_first(), "first_mix").rowsBetween(Window.unboundedPreceding, -1)
    dealt = manifest.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    schema = "doc_id long, start long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["file"])
                for a, b, ids in reader.documents():
                    cut = (reader.firsts[a : b + 1] - reader.firsts[a]).tolist()
                    data = memoryview(ids.astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.keys[a:b], mask=reader.nulls[a:b].astype(bool)),
                            pa.array(reader.firsts[a:b] + row["before"]),
                            pa.array([bytes(data[4 * x : 4 * y]) for x, y in zip(cut, cut[1:], strict=False)], pa.binary()),
                        ],
                        schema=common.arrow_schema(schema),
                    )

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return common.map_stream(dealt.repartition(files), run, schema)


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to files and read back."""
    import public_tokenizers

    out = common.Scratch(spark, "token-blocks").root
    write_ids(common.table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, out).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

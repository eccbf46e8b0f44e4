"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Every whole text is encoded, whatever its length. Texts above ``SPLIT_CHARS`` are cut at safe
boundaries first: before a single space that stands between two characters that are not white space.
No match of the pattern crosses such a place, because its pieces hold white space only at their start
and the one look-ahead looks no further than the run of white space, so the ids are the same.
A run of white space of ``RUN`` characters or more is taken out by rule (all of it at the end of the
text, all but its last character before other text), since the pattern's engine recurses over it.

Nulls and empty texts give no ids and no bytes. Repeated rows are encoded alike, ties do not matter,
an empty table gives an empty table, and columns besides the named ones are not read.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import common

SPLIT_CHARS = 1 << 16
RUN = 4096
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: The pattern's white space: characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The codec of a rank file (a base64 token and its rank on each line), kept by each Python worker."""
    with open(ranks_path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def pieces(text: str, limit: int = SPLIT_CHARS) -> list[str]:
    """The text in parts of about ``limit`` characters that end at safe boundaries; a part without one stays whole."""
    parts, start = [], 0
    while len(text) - start > limit:
        found = SAFE.search(text, start + limit)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    parts.append(text[start:])
    return parts


def encode_text(codec: tiktoken.Encoding, text: str, limit: int = SPLIT_CHARS) -> np.ndarray:
    if len(text) < RUN:
        return np.array(codec.encode_ordinary(text), dtype="<u4")
    ids: list[np.ndarray] = []
    start = 0
    for run in LONG_RUN.finditer(text):
        ids += [np.array(codec.encode_ordinary(part), dtype="<u4") for part in pieces(text[start : run.start()], limit)]
        start = run.end() - (run.end() < len(text))
        ids.append(np.array(codec._core_bpe.encode_single_piece(text[run.start() : start].encode()), dtype="<u4"))
    ids += [np.array(codec.encode_ordinary(part), dtype="<u4") for part in pieces(text[start:], limit)]
    return np.concatenate(ids)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids[, decoded]): ids as little-endian unsigned 32-bit integers; with ``decoded`` also the bytes they decode to."""
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, ids binary" + ", decoded binary" * decoded

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoding(ranks_path, pattern)
        ids = [encode_text(codec, x or "") for x in batch.column(1).to_pylist()]
        out = [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())]
        if decoded:
            out.append(pa.array([codec.decode_bytes(x.tolist()) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(out, names=[key, "ids", "decoded"][: len(out)])

    return common.map_batches(docs.select(key, text), run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the raw bytes of each row's ids; null ids decode to no bytes."""
    kind = dict(encoded.dtypes)[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoding(ranks_path, pattern)
        out = [codec.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return common.map_batches(encoded.select(key, ids), run, f"`{key}` {kind}, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return digests(encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True))

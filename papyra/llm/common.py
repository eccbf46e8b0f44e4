"""Shared helpers of the training-data operators: inputs, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same six bytes.
SPACES = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch between Spark and a worker; with long texts the default number of rows would hold far more.
BATCH_BYTES = 8 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, as in local mode; a cluster has it installed."""
    here = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, here]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode without the setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="papyra-")
    return f"file://{_own}"


_own: str | None = None


class Scratch:
    """Tables written to the shared folder to cut lineage, dropped as soon as they are superseded.

    A written table survives lost executors, is read lazily and, unlike a cache, costs no memory.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/papyra-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session has ended
            pass

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, max_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow in slices of about ``max_bytes``, so that a worker's memory follows its longest row, not the row count of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return map_stream(df, run, schema)


def map_stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes. The plan runs later, so the bound is set for the session; it changes no result."""
    importable(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    step = max(1, min(rows, int(rows * max_bytes / max(1, batch.nbytes))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_schema(schema: str) -> pa.Schema:
    """Of a schema string with plain types, where a worker has no session to parse it."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.split() for field in schema.split(","))])


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by DataFrame functions only."""
    names = [f.split()[0] for f in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{a}: {b}' for a, b in (f.split() for f in schema.split(',')))}>>")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (case does not count)."""
    held, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in held:
            n = f"_{n}"
        held.add(n.lower())
        out.append(n)
    return out


def letters(column: str) -> F.Column:
    """True where a text has at least one letter."""
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))

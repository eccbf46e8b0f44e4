"""Sequential decisions along the rows of a partition, as table functions: PARTITION BY says what belongs together, ORDER BY in what order it is read.

The functions are polymorphic: they take a table of any columns and give it back with one more. A partition is read as a stream, one
row at a time, so it may be longer than memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _with(table: AnalyzeArgument, name: str) -> AnalyzeResult:
    schema = StructType(list(table.dataType.fields))
    return AnalyzeResult(schema.add(name, IntegerType()))


@udtf
class Packed:
    """Batches filled in order up to ``most``: (rows, the column of sizes, most)."""

    def __init__(self) -> None:
        self.batch = self.total = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        return _with(rows, "batch")

    def eval(self, rows: Row, size: str, most: int):
        n = rows[size] or 0
        if self.total and self.total + n > most:
            self.batch, self.total = self.batch + 1, 0
        self.total += n
        yield (*rows, self.batch)


@udtf
class Slides:
    """Whole slides in chunks of at most ``most`` words; those of fewer than ``least`` are left out, longer ones stand alone: (rows, the column of text, most, least)."""

    def __init__(self) -> None:
        self.chunk, self.total = -1, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, most: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        return _with(rows, "chunk")

    def eval(self, rows: Row, text: str, most: int, least: int):
        n = len((rows[text] or "").split())
        if n < least:
            return
        if self.chunk < 0 or self.total + n > most:
            self.chunk, self.total = self.chunk + 1, 0
        self.total += n
        yield (*rows, self.chunk)


def register(spark: SparkSession) -> None:
    spark.udtf.register("packed", Packed)
    spark.udtf.register("slides", Slides)


def pack(rows: DataFrame, by: str, order: str, size: str, most: int = 8000) -> DataFrame:
    """rows with the batch that each falls into."""
    register(rows.sparkSession)
    return rows.sparkSession.sql(f"SELECT * FROM packed(TABLE({{rows}}) PARTITION BY (`{by}`) ORDER BY ({order}), '{size}', {int(most)})", rows=rows)


def slide_chunks(rows: DataFrame, by: str, order: str, text: str, most: int, least: int = 5) -> DataFrame:
    """slides with the chunk that each goes to."""
    register(rows.sparkSession)
    return rows.sparkSession.sql(f"SELECT * FROM slides(TABLE({{rows}}) PARTITION BY (`{by}`) ORDER BY ({order}), '{text}', {int(most)}, {int(least)})", rows=rows)

"""Stored tables: appends, snapshots, rebuilds, versions; a vector store; files of an object store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.relational import matching, scan, unmatched
from papyra.operators.search import scored


class Table:
    """A table in a folder, as versions: a rebuild is written whole to a new one, then named the current one; an append adds files to it.

    Readers never see a half-written version, and what a failed task has written is not part of it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        if schema and not self.files.exists(f"{self.path}/current"):
            self.rebuild(spark.createDataFrame([], schema))

    def version(self) -> int:
        return int(self.files.text(f"{self.path}/current"))

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version() if version is None else version}")

    def rebuild(self, rows: DataFrame) -> None:
        """What the table holds from now on: truncate and load, or the result of an update or delete."""
        new = self.version() + 1 if self.files.exists(f"{self.path}/current") else 0
        rows.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        self.files.put(f"{self.path}/current", str(new))

    def append(self, rows: DataFrame) -> None:
        """More rows, by column name, as more files; what the table holds is not read."""
        kinds = self.read().dtypes
        rows.select(*(F.col(c).cast(t).alias(c) for c, t in kinds)).write.mode("append").parquet(f"{self.path}/v{self.version()}")

    def forget(self, keep: int = 1) -> None:
        """Removes all versions but the last ``keep``."""
        for old in range(self.version() - keep, -1, -1):
            if not self.files.delete(f"{self.path}/v{old}"):
                break

    def snapshot(self, path: str) -> DataFrame:
        """A copy of the table as it is now."""
        self.read().write.mode("errorifexists").parquet(path)
        return self.spark.read.parquet(path)

    def delete(self, **where) -> None:
        if not where:
            raise ValueError("a delete needs a filter")
        now = self.read()
        self.rebuild(now.filter(~F.coalesce(matching(now, where), F.lit(False))))


class VectorStore:
    """Texts with metadata and their vectors. embed: a column function of the text, such as a pandas UDF."""

    SCHEMA = "id string, content string, metadata map<string,string>, embedding array<float>"

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column]) -> None:
        self.table, self.embed = Table(spark, path, self.SCHEMA), embed

    def add(self, rows: DataFrame) -> None:
        """rows: (id, content, metadata); rows whose id the store holds take the place of the stored ones. New ids are only appended."""
        new = rows.select("id", "content", "metadata", self.embed(F.col("content")).cast("array<float>").alias("embedding"))
        now = self.table.read()
        if now.select("id").join(rows.select("id"), "id", "left_semi").take(1):
            self.table.rebuild(unmatched(now, rows, ["id"]).unionByName(new))
        else:
            self.table.append(new)

    def delete(self, ids: DataFrame | None = None, **metadata: str) -> None:
        """Rows of the ids (id), or with all of the metadata; one of both is needed."""
        now = self.table.read()
        if ids is not None:
            self.table.rebuild(unmatched(now, ids, ["id"]))
        elif metadata:
            hit = F.lit(True)
            for k, v in metadata.items():
                hit = hit & (F.col("metadata")[k] == v)
            self.table.rebuild(now.filter(~F.coalesce(hit, F.lit(False))))
        else:
            raise ValueError("a delete needs ids or metadata")

    def search(self, query: DataFrame, k: int, above: float | None = None, without: DataFrame | None = None, **metadata: list[str]) -> DataFrame:
        """(id, content, metadata, similarity): the k rows most like the query's one vector, of those with any of the values
        of each metadata key and without the ids that have been decided (id)."""
        rows = self.table.read()
        rows = unmatched(rows, without, ["id"]) if without is not None else rows
        for key, values in metadata.items():
            rows = rows.filter(F.col("metadata")[key].isin(*values))
        return scored(rows, query, above=above).orderBy(F.col("similarity").desc_nulls_last(), "id").limit(k).select("id", "content", "metadata", "similarity")

    def ids(self, **where) -> DataFrame:
        return scan(self.table.read(), where).select("id").distinct()

    def counts(self, key: str) -> DataFrame:
        """Chunks of each document, named by a metadata key."""
        return self.table.read().groupBy(F.col("metadata")[key].alias(key)).agg(F.count("*").alias("chunks"))


class Files:
    """Files of whatever store the session's paths name."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def upload(self, local: str, path: str) -> None:
        fs, p = self._at(path)
        fs.copyFromLocalFile(False, True, self.jvm.org.apache.hadoop.fs.Path(local), p)

    def download(self, path: str, local: str) -> None:
        fs, p = self._at(path)
        fs.copyToLocalFile(False, p, self.jvm.org.apache.hadoop.fs.Path(local), True)

    def put(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def text(self, path: str) -> str:
        fs, p = self._at(path)
        read = fs.open(p)
        data = read.readAllBytes()
        read.close()
        return bytes(data).decode()


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def current_version(names: DataFrame, name: str = "name") -> DataFrame:
    """(number) of the last applied migration, from names such as 000012_views; no row where there is none."""
    number = F.split_part(name, F.lit("_"), F.lit(1)).try_cast("int")
    return names.select(number.alias("number")).filter("number is not null").orderBy(F.col("number").desc()).limit(1)


def pending(names: DataFrame, applied: DataFrame, name: str = "name") -> DataFrame:
    """Migrations after the last applied one, with their numbers, in order."""
    last = F.coalesce(current_version(applied, name).scalar(), F.lit(-1))
    number = F.split_part(name, F.lit("_"), F.lit(1)).try_cast("int")
    return names.withColumn("number", number).filter(F.col("number") > last).orderBy("number")


def settings(rows: DataFrame, environment: dict[str, str]) -> dict[str, str]:
    """Active settings (name, val, isactive) over those of the environment; a settings table is a page long."""
    own = rows.filter("isactive").select("name", "val").orderBy("name").limit(10_000).collect()
    return environment | {r["name"]: r["val"] for r in own}

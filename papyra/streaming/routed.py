"""Routed writes of a stream that a replayed batch leaves as they are.

Each handler turns the events of its types into rows; the rows of a batch are the folder ``batch=<id>`` of the
handler's table, so writing a batch again replaces it. A ledger has a file for each (query, batch, handler) that
is through; it is written after the rows, and a replay passes over what it names. A failure between the two
writes the same folder again. Events without a handler, and those that a handler cannot read, are rows of the dead letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.sources.stores import Files

DEAD = "dead_letters"


class Ledger:
    """Which handlers are through with which batches of a query."""

    def __init__(self, spark: SparkSession, path: str, query: str) -> None:
        self.files, self.root = Files(spark), f"{path.rstrip('/')}/{query}"

    def _path(self, batch: int, handler: str) -> str:
        return f"{self.root}/{batch}.{handler}"

    def done(self, batch: int, handler: str) -> bool:
        return self.files.exists(self._path(batch, handler))

    def mark(self, batch: int, handler: str) -> None:
        self.files.put(self._path(batch, handler), "")


class RoutedWrites:
    """For foreachBatch: handlers by event type, their tables and the ledger in one folder."""

    def __init__(self, spark: SparkSession, path: str, query: str = "events", kind: str = "event_type") -> None:
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        self.ledger = Ledger(spark, f"{self.path}/_ledger", query)
        self.handlers: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame], Column]] = {}

    def on(self, *event_types: str, readable: Column | None = None):
        """Registers a function from the events of some types to rows, named as its table; events that are not readable are dead letters."""

        def put(f: Callable[[DataFrame], DataFrame]):
            self.handlers[f.__name__] = (event_types, f, F.lit(True) if readable is None else F.coalesce(readable, F.lit(False)))
            return f

        return put

    def _alive(self) -> Column:
        out = F.lit(False)
        for types, _, readable in self.handlers.values():
            out = out | (F.col(self.kind).isin(*types) & readable)
        return F.coalesce(out, F.lit(False))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        work = {name: (lambda df, t=types, f=f, r=readable: f(df.filter(F.col(self.kind).isin(*t) & r))) for name, (types, f, readable) in self.handlers.items()}
        work[DEAD] = lambda df: df.filter(~self._alive())
        left = [name for name in work if not self.ledger.done(batch_id, name)]
        if not left:
            return
        held = batch.persist()  # each handler reads it
        try:
            for name in left:
                work[name](held).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
                self.ledger.mark(batch_id, name)
        finally:
            held.unpersist()

    def table(self, name: str) -> DataFrame:
        """What a handler has written, of all batches."""
        return self.spark.read.parquet(f"{self.path}/{name}").drop("batch")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """All that the stream has now."""
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

"""Event streams: Kafka ends, envelopes, routing, completeness, status and field changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kafka_source(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """(key, value, topic, timestamp, headers), key and value as text; needs the Kafka package on the class path."""
    read = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("includeHeaders", True)
    for k, v in options.items():
        read = read.option(k, v)
    return read.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp", "headers")


def kafka_sink(df: DataFrame, servers: str, checkpoint: str, topic: str | None = None):
    """Writes key and value; the checkpoint makes what is repeated after a failure a repeat and not a loss."""
    more = (["topic"] if topic is None else []) + (["headers"] if "headers" in df.columns else [])
    write = df.select(F.col("key").cast("string"), F.col("value").cast("string"), *more).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)
    return write.option("topic", topic) if topic else write


HEADER = "struct<eventType: string, eventSubType: string, requestId: string, createdOn: string>"


def envelope(value: Column, payload: str) -> Column:
    """{header, payload} text as a struct; a payload inside the payload is unwrapped."""
    one = F.from_json(value, f"struct<header: {HEADER}, payload: {payload}>")
    two = F.from_json(value, f"struct<payload: struct<payload: {payload}>>")
    return F.struct(one["header"].alias("header"), F.coalesce(two["payload"]["payload"], one["payload"]).alias("payload"))


def encode(header: Column, payload: Column) -> Column:
    """{header, payload} as JSON text: ids and decimals as their text, dates and times as ISO 8601."""
    return F.to_json(F.struct(header.alias("header"), payload.alias("payload")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"})


def log_rows(messages: DataFrame, payload: str, at: Column) -> DataFrame:
    """(request, kind, header, payload, at, raw) of messages (value), to be appended to the event log; unreadable ones keep their text."""
    read = messages.select(envelope(F.col("value"), f"struct<{payload}>").alias("m"), at.alias("at"), F.col("value").alias("raw"))
    return read.select(F.col("m.header.requestId").alias("request"), F.col("m.header.eventType").alias("kind"), "m.header", "m.payload", "at", "raw")


def failure(request: Column, code: str, user_text: str, internal: Column) -> Column:
    """The envelope of a failure: a code, what the user is told, and what only the log keeps."""
    return encode(F.struct(F.lit("Failure").alias("eventType"), request.alias("requestId")), F.struct(F.lit("FAILED").alias("status"), F.lit(code).alias("error_code"), F.lit(user_text).alias("error_message"), internal.alias("internal_message")))


class Router:
    """Handlers by event type, run in foreachBatch; unknown types go to the dead letters."""

    def __init__(self, renames: dict[str, str] | None = None) -> None:
        self.handlers: dict[str, Callable[[DataFrame], None]] = {}
        self.renames = renames or {}
        self.dead: Callable[[DataFrame], None] = lambda df: None

    def on(self, event_type: str):
        def put(f):
            self.handlers[event_type] = f
            return f

        return put

    def kind(self, c: Column) -> Column:
        out = c
        for a, b in self.renames.items():
            out = F.when(c == a, b).otherwise(out)
        return out

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("event_type", self.kind(F.col("event_type"))).persist()  # each handler reads it
        try:
            for name, handler in self.handlers.items():
                handler(batch.filter(F.col("event_type") == name))
            self.dead(batch.filter(F.col("event_type").isNull() | ~F.col("event_type").isin(*self.handlers)))
        finally:
            batch.unpersist()


def complete(parts: DataFrame) -> DataFrame:
    """(request_id, total, received, complete) of parts (request_id, idx, total, ts): complete once all indices are there; repeats count once."""
    got = parts.filter(F.col("idx").between(1, F.col("total"))).groupBy("request_id").agg(F.max("total").cast("long").alias("total"), F.count_distinct("idx").alias("received"))
    return got.withColumn("complete", F.col("received") == F.col("total"))


def completeness(parts: DataFrame, wait: str = "75 seconds", keep: str = "1 hour") -> DataFrame:
    """Streaming form: a row once a request is complete, or, incomplete, when event time passes its first part by ``wait``.

    A request that has been reported is remembered for ``keep`` of event time, so late or repeated parts do not
    report it twice; then its state goes.
    """
    seconds, kept = (int(in_seconds(x)) for x in (wait, keep))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            total, seen, done, first = state.get
            if done:
                state.remove()
                return
            state.update((total, seen, True, first))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + kept * 1000)
            yield pd.DataFrame({"request_id": [key[0]], "total": [total], "received": [len(list(filter(None, seen.split(","))))], "complete": [False]})
            return
        total, seen, done, first = (state.get[0], set(map(int, filter(None, state.get[1].split(",")))), state.get[2], state.get[3]) if state.exists else (0, set(), False, 0)
        for pdf in batches:
            total = max(total, int(pdf["total"].max()))
            first = first or int(pdf["ts"].min().timestamp() * 1000)
            seen |= {int(i) for i, t in zip(pdf["idx"], pdf["total"], strict=True) if 1 <= i <= t}
        now = len(seen) == total and not done
        state.update((total, ",".join(map(str, sorted(seen))), done or now, first))
        after = kept if done or now else seconds
        state.setTimeoutTimestamp(max(first + after * 1000, state.getCurrentWatermarkMs() + 1))
        if now:
            yield pd.DataFrame({"request_id": [key[0]], "total": [total], "received": [len(seen)], "complete": [True]})

    return parts.withWatermark("ts", wait).groupBy("request_id").applyInPandasWithState(run, "request_id string, total long, received long, complete boolean", "total long, seen string, done boolean, first long", "append", "EventTimeTimeout")


def in_seconds(wait: str) -> float:
    """Of a text such as 75 seconds or 1 hour."""
    number, unit = wait.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def once(messages: DataFrame, ids: list[str], at: str, within: str) -> DataFrame:
    """A stream without repeated messages, by their ids, as far apart as ``within``; a batch without any."""
    return messages.withWatermark(at, within).dropDuplicatesWithinWatermark(ids) if messages.isStreaming else messages.dropDuplicates(ids)


def newest(events: DataFrame, key: str, at: str, index: str) -> DataFrame:
    """The newest message of each request, by time, else by index: a partial maximum, no window over one partition."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(F.col(at), F.col(index))).alias("row")).select(key, "row.*")


#: Status of a document after each kind of event.
STATUS = {"signup": "NEW", "view": "READ", "click": "OPENED", "purchase": "APPROVED", "error": "REJECTED"}


def statuses(events: DataFrame, key: str, kind: str, at: str, index: str, status: dict[str, str] | None = None) -> DataFrame:
    """(key, status, indexed): what the latest event that has a status makes of each document."""
    of = status or STATUS
    mapped = F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col(kind)]
    last = events.withColumn("status", mapped).filter("status is not null").groupBy(key).agg(F.max_by("status", F.struct(F.col(at), F.col(index))).alias("status"))
    return last.withColumn("indexed", F.col("status") == "APPROVED")


def field_changes(payload: Column, columns: list[str]) -> Column:
    """(field, old, new) of newX / oldX pairs of a map that name a column."""
    keys = F.filter(F.map_keys(payload), lambda k: k.startswith("new") & F.lower(F.substring(k, 4, 100)).isin(*[c.lower() for c in columns]))
    rest = lambda k: F.substring(k, 4, 100)
    return F.transform(keys, lambda k: F.struct(F.lower(rest(k)).alias("field"), F.try_element_at(payload, F.concat(F.lit("old"), rest(k))).alias("old"), F.element_at(payload, k).alias("new")))


def enabled_stages(rule: dict[str, bool], finished: set[str], order: list[str], sensitive: bool = True, converted: bool = False) -> list[str]:
    """Stages still to run, in order; without sensitive items redaction goes, and upload unless the file was converted."""
    skip = set() if sensitive else {"redaction"} | (set() if converted else {"upload"})
    return [s for s in order if rule.get(s) and s not in finished and s not in skip]


def stages_left(finished: Column, order: list[str], sensitive: Column, converted: Column) -> Column:
    """enabled_stages as a column: the stages of order that are not in the array ``finished``."""
    named = [F.when(~F.array_contains(finished, s) & (F.lit(True) if s not in ("redaction", "upload") else sensitive | (converted if s == "upload" else F.lit(False))), F.lit(s)) for s in order]
    return F.array_compact(F.array(*named))


def decide_latest(rows: DataFrame, decisions: DataFrame, key: str, at: str, index: str) -> DataFrame:
    """rows with the decision (key, decision) as the status of each key's latest row."""
    last = rows.groupBy(key).agg(F.max_by(index, F.struct(F.col(at), F.col(index))).alias("__last"))
    own = decisions.join(last, key).select(F.col("__last").alias(index), "decision")
    return rows.join(own, index, "left").withColumn("status", F.coalesce("decision", "status")).select(*rows.columns)


def replaced(rows: DataFrame, file: str, at: str, index: str) -> DataFrame:
    """rows with ``current`` false for earlier versions of a file; of those of one time the greatest index is current."""
    return rows.withColumn("current", F.row_number().over(Window.partitionBy(file).orderBy(F.col(at).desc(), F.col(index).desc())) == 1)

"""Queries that run streams over the given tables to their end, and the table function of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import generation
from papyra.plans.registry import query, table
from papyra.plans.registry import stored as stored_once
from papyra.session import shared_folder


def stream_of(spark: SparkSession, rows: DataFrame, files: int, each: int = 1) -> DataFrame:
    """A stream of a table's rows, ``each`` files a batch: the rows are written to the shared folder and read from there."""
    path = shared_folder(spark, "stream")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


_PARTS = "SELECT user_id * 1000 + event_id // 1000 AS request_id, event_id % 4 + 1 AS idx, 4 AS total, ts FROM events"


@query(f"""WITH p AS ({_PARTS} UNION ALL {_PARTS} WHERE event_id % 7 = 0), g AS (SELECT request_id, count(DISTINCT idx) AS received, min(ts) AS first FROM p GROUP BY request_id), n AS (SELECT max(ts) AS now FROM p)
SELECT request_id, 4::BIGINT AS total, received, received = 4 AS complete FROM g, n WHERE received = 4 OR first + INTERVAL 75 SECOND <= now""")
def completeness_stream(spark, d):
    """Requests of four parts, reported when all are there or when event time has left the first one 75 seconds behind; repeated parts count once."""
    from papyra.streaming.stateful import barrier

    e = table(spark, d, "events").select((F.col("user_id") * 1000 + F.floor(F.col("event_id") / 1000)).alias("request_id"), (F.col("event_id") % 4 + 1).alias("idx"), F.lit(4).cast("long").alias("total"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    parts = e.unionByName(e.filter("event_id % 7 = 0")).drop("event_id")
    out, marks = shared_folder(spark, "complete"), shared_folder(spark, "complete-marks")
    stream = stream_of(spark, parts, 4, each=4)
    stream = barrier(stream, buckets=16_384).writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
    stream.awaitTermination()
    return spark.read.schema("request_id long, total long, received long, complete boolean").parquet(out)


@query("""SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'reads' WHEN 'click' THEN 'reads' WHEN 'purchase' THEN CASE WHEN value > 5 THEN 'sales' ELSE 'dead_letters' END ELSE 'dead_letters' END AS target,
 CASE WHEN event_type = 'purchase' AND value > 5 THEN round(value * 2, 2) END AS amount FROM events""")
def routed_events(spark, d):
    """Events through their handlers in several batches; all batches are then replayed from the start, which changes nothing."""
    from papyra.streaming.routed import DEAD, RoutedWrites

    root = shared_folder(spark, "routed")
    routed = RoutedWrites(spark, root)

    @routed.on("view", "click")
    def reads(rows):
        return rows.select("event_id", "user_id")

    @routed.on("purchase", readable=F.col("value") > 5)
    def sales(rows):
        return rows.select("event_id", "user_id", F.round(F.col("value") * 2, 2).alias("amount"))

    stream = stream_of(spark, table(spark, d, "events"), 6, each=2)
    routed.run(stream, f"{root}/_marks/first")
    routed.run(stream, f"{root}/_marks/again")
    named = lambda name: routed.table(name).withColumn("target", F.lit(name))
    parts = named("sales").unionByName(named("reads"), allowMissingColumns=True).unionByName(named(DEAD).select("event_id", "user_id", "target"), allowMissingColumns=True)
    return parts.select("event_id", "user_id", "target", "amount")


_OFFERS = """SELECT DISTINCT l_orderkey AS request, l_suppkey AS project, template, l_quantity AS offer_score, l_extendedprice AS similarity, ratio * 100 AS acceptance FROM (
 SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS template FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN (
 SELECT template, nullif(count(*) FILTER (l_linestatus = 'F'), 0) / count(*)::DOUBLE AS ratio FROM (SELECT l_linestatus, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS template FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY template) USING (template)"""
_STORED = """SELECT l_orderkey AS request, l_suppkey AS project, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS template, l_quantity AS offer_score, l_extendedprice AS similarity, l_tax * 100 AS acceptance,
 CASE WHEN l_linenumber <= 5 THEN 'offerbased' ELSE 'search' END AS method, CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'R' THEN 'REJECTED' ELSE 'GENERATED' END AS status FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query(f"""WITH offers AS ({_OFFERS}), stored AS ({_STORED}),
kpi AS (SELECT template, nullif(count(*) FILTER (status = 'ACCEPTED'), 0) / count(*)::DOUBLE * 100 AS acceptance FROM stored WHERE status <> 'GENERATED' AND method = 'offerbased' GROUP BY template),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request, template ORDER BY offer_score DESC, similarity DESC, project) AS k FROM offers) WHERE k = 1)
SELECT false AS refine, request, project, template, offer_score, similarity, round(acceptance, 6) AS acceptance, 'offerbased' AS method, 'GENERATED' AS status FROM best
UNION ALL SELECT true, s.request, s.project, s.template, s.offer_score, s.similarity, round(coalesce(kpi.acceptance, s.acceptance), 6), s.method, s.status FROM stored s LEFT JOIN kpi ON s.template = kpi.template""")
def generate_recommendation(spark, d):
    """Both branches of the table function for every request."""
    part = table(spark, d, "part")
    keys = ["p_brand", "p_type", "p_size"]
    templates = part.select("p_partkey", *keys).join(part.groupBy(*keys).agg(F.min("p_partkey").alias("template")), keys)
    columns = [F.col("l_orderkey").alias("request"), F.col("l_suppkey").alias("project"), "template", F.col("l_quantity").alias("offer_score"), F.col("l_extendedprice").alias("similarity"), "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
    base = stored_once(table(spark, d, "lineitem").join(templates, F.col("l_partkey") == F.col("p_partkey")).select(*columns), "items")  # read five times
    ratio = base.groupBy("template").agg((F.nullif(F.count_if(F.col("l_linestatus") == "F"), F.lit(0)).cast("double") / F.count("*") * 100).alias("acceptance"))
    offers = base.drop("l_tax", "l_linenumber", "l_returnflag", "l_linestatus").join(ratio, "template")
    method = F.when(F.col("l_linenumber") <= 5, "offerbased").otherwise("search")
    status = F.when(F.col("l_returnflag") == "A", "ACCEPTED").when(F.col("l_returnflag") == "R", "REJECTED").otherwise("GENERATED")
    stored = base.select("request", "project", "template", "offer_score", "similarity", (F.col("l_tax") * 100).alias("acceptance"), method.alias("method"), status.alias("status"))
    name = generation.define(spark, offers, stored)
    requests = base.select("request").distinct().withColumn("refine", F.explode(F.array(F.lit(False), F.lit(True))))
    return generation.generate(requests, name, F.col("refine")).withColumn("acceptance", F.round("acceptance", 6))

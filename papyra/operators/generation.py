"""Recommendations of a request as a table function with a refine branch, and a separate writer.

``define`` registers a SQL table function of two arguments that a LATERAL join calls for each request.
Spark turns the call into joins on the request, so a million requests are one plan, not a million calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import relational

COLUMNS = "request BIGINT, project BIGINT, template BIGINT, offer_score DOUBLE, similarity DOUBLE, acceptance DOUBLE, method STRING, status STRING"

#: What a call with the arguments p_request and p_refine gives: rows of both branches lie in one view, as a call is a plain join only
#: where it compares columns with its arguments. Calls of a UNION are joined in each branch, and their result with the calls again.
BODY = "SELECT request, project, template, offer_score, similarity, acceptance, method, status FROM {rows} WHERE request = p_request AND refine = p_refine"


def decided(stored: DataFrame) -> DataFrame:
    """(template, acceptance): accepted among decided recommendations by offer, in percent; null where none is accepted."""
    own = stored.filter((F.col("status") != "GENERATED") & (F.col("method") == "offerbased"))
    return relational.ratio(own, ["template"], F.col("status") == "ACCEPTED", F.lit(True)).select("template", (F.col("ratio") * 100).alias("acceptance"))


def define(spark: SparkSession, offers: DataFrame, stored: DataFrame, name: str = "generate_recommendation") -> str:
    """Registers the function over offers (request, project, template, offer_score, similarity, acceptance) and stored recommendations (COLUMNS).

    Of a request's offers for a template the best one counts: greatest offer score, then similarity, then smallest project.
    """
    order = [F.col("offer_score").desc_nulls_last(), F.col("similarity").desc_nulls_last(), F.col("project")]
    columns = ["request", "project", "template", "offer_score", "similarity", "acceptance", "method", "status"]
    own = relational.best(offers, ["request", "template"], order).withColumns({"method": F.lit("offerbased"), "status": F.lit("GENERATED")})
    # acceptance is in percent in both branches; a template of which nothing has been decided keeps what it had
    known = stored.join(decided(stored).withColumnRenamed("acceptance", "__decided"), "template", "left").withColumn("acceptance", F.coalesce("__decided", "acceptance"))
    both = own.select(*columns, F.lit(False).alias("refine")).unionByName(known.select(*columns, F.lit(True).alias("refine")))
    both.createOrReplaceTempView(f"{name}_rows")
    body = BODY.format(rows=f"{name}_rows")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(p_request BIGINT, p_refine BOOLEAN DEFAULT false) RETURNS TABLE ({COLUMNS}) RETURN {body}")
    return name


def generate(requests: DataFrame, name: str = "generate_recommendation", refine: Column | None = None) -> DataFrame:
    """The recommendations of each of (request), by a LATERAL call; ``refine``: which branch, a column of requests."""
    calls = requests.select(F.col("request").cast("long").alias("request"), (F.lit(False) if refine is None else refine).alias("refine"))
    return requests.sparkSession.sql(f"SELECT q.refine, f.* FROM {{calls}} q, LATERAL {name}(q.request, q.refine) f", calls=calls)


def written(stored: DataFrame, requests: DataFrame, generated: DataFrame) -> DataFrame:
    """stored after a call: what it held of the requests goes, what the call gave comes; for a table's rebuild."""
    kept = relational.unmatched(stored, requests.select(F.col("request").cast("long").alias("request")).distinct(), ["request"])
    return kept.unionByName(generated.select(*stored.columns))

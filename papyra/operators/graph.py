"""Connected components of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from papyra.session import shared_folder

#: Rounds grow with the logarithm of the longest path.
ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node with an edge reaches. edges: (u, v) with u < v, of any ordered type.

    In a round every node's larger neighbours are hung on the least neighbour, then every node's smaller ones; the edges
    become stars. Each round is written to the shared folder, which cuts the lineage. Its files say little about its rows' size, as
    nodes repeat, so joins are sorted ones: no side goes through the driver.
    """
    spark, root = edges.sparkSession, shared_folder(edges.sparkSession, "components")

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}"), (seen.get["n"], seen.get["h"])

    now, state = kept(edges.select("u", "v").distinct(), "0")
    for k in range(1, ROUNDS):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low.hint("merge"), "v").select(F.least("m", "u").alias("u"), F.greatest("m", "u").alias("v")).unionByName(low.select(F.col("m").alias("u"), "v"))
        now, after = kept(small.filter("u < v").distinct(), str(k))
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components are not found after {ROUNDS} rounds")
    own = now.select(F.col("v").alias("node"), "u").unionByName(now.select(F.col("u").alias("node"), "u"))
    return own.groupBy("node").agg(F.min("u").alias("component"))

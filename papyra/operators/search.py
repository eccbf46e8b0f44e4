"""Vector search: exact top-k for one query or many, thresholds, and ranking by score and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.scoring import cosine, length_of, right_closed
from papyra.operators.relational import with_constant

#: Edges and labels of relevance bins.
EDGES, LABELS = [0.0, 25.0, 60.0, 80.0, 95.0, 100.0], ["Very Low", "Low", "Medium", "High", "Very High"]


def scored(store: DataFrame, query: DataFrame, vector: str = "embedding", above: float | None = None) -> DataFrame:
    """store with its similarity to the one query vector; None keeps all, 0.0 filters."""
    one = query.select(F.struct(F.col(vector).alias("v"), length_of(F.col(vector)).alias("n")).alias("__q")).limit(1)
    out = store.withColumn("__q", one.scalar()).withColumn("similarity", cosine(F.col(vector), F.col("__q.v"), F.col("__q.n"))).drop("__q")
    return out if above is None else out.filter(F.col("similarity") > above)


def top_k(store: DataFrame, query: DataFrame, k: int, key: str, vector: str = "embedding", above: float | None = None) -> DataFrame:
    """The k most similar rows, by a top-k in each partition before the last one."""
    return scored(store, query, vector, above).orderBy(F.col("similarity").desc_nulls_last(), key).limit(k)


#: Rows and columns of the similarities that nearest_of looks at at once; they stay in a core's cache.
ROWS, COLUMNS = 256, 2048


def nearest_of(rows: DataFrame, store: DataFrame, k: int, keys: list[str], store_key: str, vector: str = "embedding", above: float | None = None, block: int = 32_768) -> DataFrame:
    """(keys, store_key, similarity, rank): for each row the k most similar rows of store, a stated set that is taken in blocks.

    Each block is one pass over the rows with it broadcast; a row keeps its k best of a block in its task, so
    nothing is shuffled unless there are several blocks. Similarities are first taken in single precision; what they leave, within
    their rounding, is compared in double precision, to 12 places, equal ones by key. Rows without a vector, or with one of length zero, have none.
    """
    import numpy as np
    import pandas as pd

    spark, kinds, names = rows.sparkSession, dict(rows.dtypes), [*keys, store_key, "similarity"]
    own = store.select(store_key, vector).filter(F.col(vector).isNotNull())
    blocks = max(1, -(-own.count() // block))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", `{store_key}` {dict(store.dtypes)[store_key]}, similarity double"

    def unit(x):
        x = np.array(x, dtype=np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(size > 0, x / np.where(size > 0, size, 1), np.nan)

    out, bound = None, -np.inf if above is None else above
    for n in range(blocks):
        part = own.filter(F.pmod(F.xxhash64(store_key), F.lit(blocks)) == n).orderBy(store_key).toPandas()  # about ``block`` rows
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast((part[store_key].to_numpy(), unit(part[vector].tolist())))

        def run(batches, shared=shared):
            ids, matrix = shared.value
            narrow, slack = matrix.astype(np.float32), (matrix.shape[1] + 8) * 2.0**-22  # of rounding
            for pdf in batches:
                pdf = pdf[pdf[vector].notna()]
                for at in range(0, len(pdf), ROWS):
                    some = pdf.iloc[at : at + ROWS]
                    x = unit(some[vector].tolist())
                    row, place, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                    least, wide = np.full(len(x), bound), x.astype(np.float32)
                    for c in range(0, len(ids), COLUMNS):
                        s = wide @ narrow[c : c + COLUMNS].T
                        fits = s >= (least - slack).astype(np.float32)[:, None]
                        found = np.count_nonzero(fits)
                        if not found:
                            continue
                        if found > 4 * k * len(x):
                            many = np.flatnonzero(fits.sum(axis=1) > 4 * k)
                            part = np.where(np.isnan(s[many]), -np.inf, s[many])
                            fits[many] &= part >= np.partition(part, part.shape[1] - k, axis=1)[:, [part.shape[1] - k]] - 2 * slack
                        r, p = np.divmod(np.flatnonzero(fits), fits.shape[1])
                        v = np.round(np.einsum("ij,ij->i", x[r], matrix[c + p]), 12)
                        more = v > least[r]  # of equal ones those with the smaller keys have come before
                        r, p, v = r[more], p[more] + c, v[more]
                        row, place, value = np.concatenate([row, r]), np.concatenate([place, p]), np.concatenate([value, v])
                        order = np.lexsort((place, -value, row))  # equal ones in the order of their keys
                        row, place, value = row[order], place[order], value[order]
                        nth = np.arange(len(row)) - np.searchsorted(row, row)
                        last = nth == k - 1
                        least[row[last]] = value[last]
                        row, place, value = row[nth < k], place[nth < k], value[nth < k]
                    got = some[keys].iloc[row].reset_index(drop=True)
                    got[store_key], got["similarity"] = ids[place], value
                    yield got[names]

        part = rows.select(*keys, vector).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{schema}, rank int")
    w = Window.partitionBy(*keys).orderBy(F.col("similarity").desc(), store_key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k_many(store: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str = "embedding", block: int = 1000) -> DataFrame:
    """(query, key, similarity, rank): the k most similar rows for each query. Queries are taken in blocks of bounded size against all rows.

    Each task keeps its k best for each query over all that it reads, so what is shuffled is k rows a task and
    query. Rows without a vector, or with one of length zero, have no similarity and are left out.
    """
    import numpy as np
    import pandas as pd

    spark, kinds = store.sparkSession, dict(store.dtypes)
    own = queries.select(F.col(query_key), F.col(vector)).filter(F.col(vector).isNotNull())
    blocks = max(1, -(-own.count() // block))
    schema = f"query {dict(queries.dtypes)[query_key]}, `{key}` {kinds[key]}, similarity double"
    out = None
    for n in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == n).collect()  # about ``block`` rows
        rows = [(r[0], v) for r in rows if np.linalg.norm(v := np.array(r[1], dtype=np.float64)) > 0]
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], np.stack([v / np.linalg.norm(v) for _, v in rows])))

        def run(parts, shared=shared):
            names, q = shared.value
            keys, scores = [np.zeros(0, dtype=object)] * len(names), [np.zeros(0)] * len(names)
            for pdf in parts:
                x = [v for v in pdf[vector].to_numpy()]
                size = np.array([0.0 if v is None else np.linalg.norm(np.asarray(v, dtype=np.float64)) for v in x])
                fit = np.flatnonzero(size > 0)
                if not len(fit):
                    continue
                s = q @ (np.stack([np.asarray(x[i], dtype=np.float64) for i in fit]) / size[fit][:, None]).T
                here = pdf[key].to_numpy()[fit]
                least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                for i in range(len(names)):
                    near = np.flatnonzero(s[i] >= least[i])
                    keys[i], scores[i] = np.concatenate([keys[i], here[near]]), np.concatenate([scores[i], s[i][near]])
                    top = np.lexsort((keys[i], -scores[i]))[:k]
                    keys[i], scores[i] = keys[i][top], scores[i][top]
            for i, name in enumerate(names):
                if len(keys[i]):
                    yield pd.DataFrame({"query": name, key: keys[i], "similarity": scores[i]})

        part = store.select(key, vector).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{schema}, rank int")
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_by_coverage(store: DataFrame, query: DataFrame, group: str, above: float, vector: str = "embedding", weights: tuple[float, float] = (0.9, 0.1)) -> DataFrame:
    """Groups by scaled best similarity and by the share of their chunks above the bound."""
    hits = scored(store, query, vector).filter(F.col(group).isNotNull())
    hit = F.col("similarity") > above
    found = hits.groupBy(group).agg(F.max(F.when(hit, F.col("similarity"))).alias("best"), F.avg(F.when(hit, F.col("similarity"))).alias("mean"), F.count_if(hit).alias("matched"), F.count("*").alias("total")).filter("matched > 0")
    found = with_constant(found, found.agg(F.max("best").alias("__most")))
    scaled = F.coalesce(F.try_divide(F.col("best") - above, F.col("__most") - above), F.lit(0.0)) * 100
    coverage = F.col("matched") * 100.0 / F.col("total")
    out = found.withColumn("coverage", coverage).withColumn("score", weights[0] * scaled + weights[1] * F.col("coverage"))
    return out.withColumn("relevance", right_closed(F.col("score"), EDGES, LABELS)).drop("__most")

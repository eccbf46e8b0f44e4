"""Relational operators: filters by keyword, best and latest rows, ratios, joins, updates, pages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most groups whose bounds are sent to all tasks: some megabytes.
GROUPS = 50_000


def matching(df: DataFrame, where: Mapping[str, Any]) -> Column:
    """All of: a list is membership, None is null, anything else equality. Unknown names raise."""
    unknown = [k for k in where if k not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    tests = [F.col(k).isNull() if v is None else F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in where.items()]
    return reduce(Column.__and__, tests, F.lit(True))


def scan(df: DataFrame, where: Mapping[str, Any] | None = None, columns: list[str] | None = None, order: list[Column] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filtered, ordered and paged scan; paging needs an order, so that pages do not overlap."""
    if (limit is not None or offset) and not order:
        raise ValueError("a page needs an order")
    out = df.filter(matching(df, where or {}))
    out = out.orderBy(*order) if order else out
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out.select(*columns) if columns else out


def update(df: DataFrame, where: Mapping[str, Any], values: Mapping[str, Any]) -> DataFrame:
    """df with new values in the rows that match; an empty filter raises."""
    if not where:
        raise ValueError("an update needs a filter")
    hit = F.coalesce(matching(df, where), F.lit(False))
    return df.select(*(F.when(hit, F.lit(values[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in df.dtypes))


def delete(df: DataFrame, where: Mapping[str, Any]) -> DataFrame:
    """df without the rows that match; rows for which that is unknown stay, an empty filter raises."""
    if not where:
        raise ValueError("a delete needs a filter")
    return df.filter(~F.coalesce(matching(df, where), F.lit(False)))


def insert_absent(df: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """df and those rows whose key it does not hold."""
    return df.unionByName(rows.dropDuplicates(on).join(df.select(*on), on, "left_anti"))


def upsert(df: DataFrame, rows: DataFrame, on: list[str], version: str) -> DataFrame:
    """The latest version of each key of both."""
    return latest(df.unionByName(rows), on, [F.col(version).desc_nulls_last()])


def best(df: DataFrame, by: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; the order must end in a unique key. Spark drops the others before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return best(df, by, order)


def keep_last(df: DataFrame, by: list[Column], sequence: str) -> DataFrame:
    """The last row of each key, by an aggregation with partial maxima, so a hot key needs no sort."""
    keys = [k.alias(f"__k{i}") for i, k in enumerate(by)]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(sequence)).alias("row"))
    return top.select("row.*")


def ratio(df: DataFrame, by: list[str], accepted: Column, decided: Column) -> DataFrame:
    """accepted over decided rows of each group; null where none is accepted."""
    yes, all_ = F.count_if(accepted), F.count_if(decided)
    return df.groupBy(*by).agg(F.try_divide(F.nullif(yes, F.lit(0)).cast("double"), all_.cast("double")).alias("ratio"))


def earlier_ratio(df: DataFrame, by: str, at: Column, accepted: Column) -> Column:
    """Share of accepted among the strictly earlier rows of a key, by a range window in microseconds: linear where a self-join is quadratic."""
    w = Window.partitionBy(by).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return F.avg(F.when(accepted, 1.0).otherwise(0.0)).over(w)


def scaled_by_group(df: DataFrame, by: list[str], value: str, out: str, default: float = 0.0, few: bool | None = None) -> DataFrame:
    """value as 0 to 100 between its group's least and greatest, from a partial aggregation joined back.

    Rows of up to ``GROUPS`` groups meet them where they are: a group may hold most rows, and would all go to one task. The groups are
    counted first, no further than that, unless ``few`` says that they are few.
    """
    from papyra.functions.scoring import min_max

    stats = df.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    few = df.select(*by).distinct().limit(GROUPS + 1).count() <= GROUPS if few is None else few
    return df.join(F.broadcast(stats) if few else stats, by).withColumn(out, min_max(F.col(value), F.col("__low"), F.col("__high"), default)).drop("__low", "__high")


def with_constant(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a table of one row beside every row of df; no row gives an empty result."""
    return df.crossJoin(F.broadcast(one.limit(1)))


def unmatched(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def pivot_settings(rows: DataFrame, by: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row for each group with the greatest value of each named setting; names are given, so the plan has one pass."""
    return rows.groupBy(by).pivot(name, names).agg(F.max(F.col(value).try_cast("double")))


def pages(df: DataFrame, order: list[Column], size: int, by: list[str]) -> DataFrame:
    """page and rows pushed so far for slices of ``size`` rows of each request."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.row_number().over(w)
    return df.withColumn("__n", n).withColumn("page", F.floor((F.col("__n") - 1) / size).cast("int")).withColumn("pushed", F.least((F.col("page") + 1) * size, F.count("*").over(Window.partitionBy(*by))).cast("long")).drop("__n")


def text_scan(df: DataFrame, sql: str, **params: Any) -> DataFrame:
    """A SELECT over ``{df}`` with named parameters (:name), which are bound and never pasted into the text."""
    return df.sparkSession.sql(sql, args=params, df=df)


def by_keys(left: DataFrame, right: DataFrame, on: Mapping[str, Column | str], how: str = "inner") -> DataFrame:
    """Join on several keys, each a column of right against a column or expression of left; right's keys stay out."""
    marked = right.select(*(F.col(k).alias(f"__r_{k}") for k in on), *(c for c in right.columns if c not in on))
    tests = [(F.col(e) if isinstance(e, str) else e) == F.col(f"__r_{k}") for k, e in on.items()]
    return left.join(marked, reduce(Column.__and__, tests), how).drop(*(f"__r_{k}" for k in on))


def positional(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """The n-th row of each group beside the n-th of the other's group, as far as the shorter goes; right's columns are prefixed with ``other_``."""
    place = F.row_number().over(Window.partitionBy(*on).orderBy(order))
    a, b = left.withColumn("place", place), right.withColumn("place", place)
    return a.join(b.select(*on, "place", *(F.col(c).alias(f"other_{c}") for c in right.columns if c not in on)), [*on, "place"])


def members(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the other table holds, each once."""
    return df.join(other.select(*on).distinct(), on, "left_semi")


def mapped(keys: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of every key asked for; null where there is no such row."""
    return keys.select(key).distinct().join(rows.select(key, value), key, "left")


def first_valid(df: DataFrame, by: list[str], value: str, order: str, valid: Column) -> DataFrame:
    """The first value of each group, in order, that is valid; null where none is."""
    return df.groupBy(*by).agg(F.min_by(F.when(valid, F.col(value)), F.when(valid, F.col(order))).alias(value))


def base_name(name: Column, endings: list[str]) -> Column:
    """A file name without its suffix and without the given endings, lower-cased."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"[.][a-z0-9]+$", "")
    for e in endings:
        out = F.when(out.endswith(e.lower()), F.substring(out, F.lit(1), F.length(out) - len(e))).otherwise(out)
    return out


def backfilled(rows: DataFrame, column: str, *sources: tuple[DataFrame, Column, str, str]) -> DataFrame:
    """rows with nulls of a column filled from sources (table, key of rows, key of table, value of table), the first that has one."""
    out, found = rows, [F.col(column)]
    for k, (source, key, on, value) in enumerate(sources):
        own = source.groupBy(F.col(on).alias(f"__k{k}")).agg(F.min(value).alias(f"__v{k}"))
        out = out.join(own, key == F.col(f"__k{k}"), "left")
        found.append(F.col(f"__v{k}"))
    return out.withColumn(column, F.coalesce(*found)).select(*rows.columns)


def excluding(df: DataFrame, decided: DataFrame, on: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows whose key has not been decided yet."""
    return unmatched(df, decided.select(*on).distinct(), on).orderBy(*order).limit(n)

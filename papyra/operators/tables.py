"""Tables in sheets of cells: clusters, headers, ragged rows, merged cells; lines of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from papyra.operators.graph import components
from papyra.session import shared_folder


def clusters_of(points: list[tuple[int, int]]) -> list[int]:
    """Clusters of cells under Manhattan distance: connected over at most 1.5 times the median distance to the nearest cell, 1 at least."""
    if not points:
        return []
    rows: dict[int, list[int]] = {}
    for i, (r, _) in enumerate(points):
        rows.setdefault(r, []).append(i)

    def near(i: int, most: float):
        r, c = points[i]
        for d in range(int(most) + 1):
            for rr in {r - d, r + d}:
                for j in rows.get(rr, ()):
                    if j != i and d + abs(points[j][1] - c) <= most:
                        yield j, d + abs(points[j][1] - c)

    span = max(max(abs(v) for v in p) for p in points) * 2 + 2
    nearest = []
    for i in range(len(points)):
        reach = 1
        while reach <= span and not (got := [d for _, d in near(i, reach)]):
            reach *= 2
        nearest.append(min(got) if reach <= span else 0)
    eps = max(1.0, 1.5 * float(pd.Series(nearest).median()))
    label = [-1] * len(points)
    n = 0
    for i in range(len(points)):
        if label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j, _ in near(todo.pop(), eps):
                    if label[j] < 0:
                        label[j] = n
                        todo.append(j)
            n += 1
    return label


def nearest_cells(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, nearest): the Manhattan distance of each cell to the nearest other one of its sheet, 0 where it is alone.

    Cells that have none within half a radius look for one within it, in squares of the radius's side and those around;
    the radius doubles until all have one. Cells that are left are far apart, so a square holds few of them, and a round makes no
    more pairs than some dozens for each cell, however full a square is. Files of cells are far smaller than their rows, so joins are
    sorted ones: no side goes through the driver.
    """
    spark = cells.sparkSession
    root = shared_folder(spark, "nearest")
    own = cells.select("sheet", "row", "col").distinct()
    alone = own.groupBy("sheet").agg(F.count("*").alias("n")).filter("n = 1").select("sheet")
    done = own.join(alone.hint("merge"), "sheet", "left_semi").withColumn("nearest", F.lit(0))
    left, radius = own.join(alone.hint("merge"), "sheet", "left_anti"), 1
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    while True:
        square = lambda c, r=radius: F.floor(F.col(c) / r)
        seek = left.withColumn("o", F.explode(around)).select("sheet", "row", "col", (square("row") + F.col("o.a")).alias("i"), (square("col") + F.col("o.b")).alias("j"))
        other = own.select("sheet", square("row").alias("i"), square("col").alias("j"), F.col("row").alias("r"), F.col("col").alias("c"))
        distance = F.abs(F.col("row") - F.col("r")) + F.abs(F.col("col") - F.col("c"))
        met = seek.join(other.hint("merge"), ["sheet", "i", "j"]).withColumn("d", distance).filter(F.col("d").between(1, radius))
        found = met.groupBy("sheet", "row", "col").agg(F.min("d").cast("int").alias("nearest"))
        found.write.parquet(f"{root}/{radius}")
        found = spark.read.parquet(f"{root}/{radius}")
        done = done.unionByName(found)
        left.join(found.hint("merge"), ["sheet", "row", "col"], "left_anti").write.parquet(f"{root}/left-{radius}")
        left = spark.read.schema(own.schema).parquet(f"{root}/left-{radius}")
        if not left.take(1):
            return done
        radius *= 2


#: Most cells of a sheet that a task takes as one, and distances between cells that it holds at once.
SHEET, DISTANCES = 1024, 1 << 20


def clusters_of_sheets(rows: np.ndarray, cols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """clusters_of for the cells of many sheets, one sheet after the other; sheets of like size are taken together, with the distances of all their cells."""
    sheet = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((cols, rows, sheet))
    r, c, s = rows[order], cols[order], sheet[order]
    new = np.r_[True, (np.diff(r) != 0) | (np.diff(c) != 0) | (np.diff(s) != 0)][: len(r)]  # a cell that repeats counts once
    own = np.cumsum(new) - 1
    r, c, s = r[new], c[new], s[new]
    n = np.bincount(s, minlength=len(sizes))
    begin, label = np.cumsum(n) - n, np.zeros(len(r), np.int64)
    by_size = np.argsort(n, kind="stable")
    at = int(np.searchsorted(n[by_size], 1))
    while at < len(by_size):
        some = by_size[at : at + max(1, DISTANCES // int(n[by_size[at]]) ** 2)]
        most = int(n[some[-1]])
        some = some[: max(1, DISTANCES // most**2)]
        most, at = int(n[some[-1]]), at + len(some)
        there = np.arange(most) < n[some][:, None]
        place = np.where(there, begin[some][:, None] + np.arange(most), begin[some][:, None])
        x, y = r[place], c[place]
        far = np.int64(1) << 40
        apart = np.abs(x[:, :, None] - x[:, None, :]) + np.abs(y[:, :, None] - y[:, None, :])
        apart[~(there[:, :, None] & there[:, None, :])] = far
        apart[:, np.arange(most), np.arange(most)] = far
        near = apart.min(axis=2)
        near[(n[some] == 1), 0] = 0
        ranked = np.sort(near, axis=1)  # what is not there comes last
        median = (np.take_along_axis(ranked, (n[some][:, None] - 1) // 2, 1) + np.take_along_axis(ranked, n[some][:, None] // 2, 1)) / 2
        linked = apart <= np.floor(np.maximum(1.0, 1.5 * median))[:, :, None]
        linked[:, np.arange(most), np.arange(most)] = True
        first = np.broadcast_to(np.arange(most), place.shape)
        while True:
            less = np.where(linked, first[:, None, :], most).min(axis=2)
            less = np.take_along_axis(less, less, 1)
            if (less == first).all():
                break
            first = less
        number = np.cumsum((first == np.arange(most)) & there, axis=1) - 1
        label[place[there]] = np.take_along_axis(number, first, 1)[there]
    out = np.zeros(len(rows), np.int32)
    out[order] = label[own]
    return out


def cell_clusters(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """cells (sheet, row, col, value, ...) that hold something, with the cluster of each: connected over Manhattan distances of
    at most 1.5 times the sheet's median distance to the nearest cell, 1 at least; numbered in each sheet by first cell.

    Sheets of at most SHEET cells are groups of a task each, which are shuffled once, by sheet, and stay so. A sheet may be as large as a
    table: larger ones are taken cell by cell (``large_clusters``).
    """
    spark, root = cells.sparkSession, shared_folder(cells.sparkSession, "cells")
    held = cells.filter(F.trim(F.coalesce("value", F.lit(""))) != "").withColumnRenamed(sheet, "sheet").filter("sheet is not null and row is not null and col is not null")
    held.write.parquet(root)  # it is read more than once
    kept = spark.read.schema(held.schema).parquet(root)
    sizes = kept.groupBy("sheet").agg(F.count("*").alias("n"))

    def run(rows: pa.Array, cols: pa.Array) -> pa.Array:
        sizes, flat = rows.value_lengths().to_numpy(zero_copy_only=False), [x.flatten().to_numpy(zero_copy_only=False) for x in (rows, cols)]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(clusters_of_sheets(*flat, sizes), pa.int32()))

    labels = F.arrow_udf(run, "array<int>")
    others = [c for c in kept.columns if c != "sheet"]
    small = kept.join(sizes.filter(F.col("n") <= SHEET).hint("merge"), "sheet", "left_semi").groupBy("sheet").agg(F.collect_list(F.struct(*others)).alias("c"))
    labelled = small.select("sheet", "c", labels(F.col("c.row").cast("array<bigint>"), F.col("c.col").cast("array<bigint>")).alias("k"))
    out = labelled.select("sheet", F.inline(F.zip_with("c", "k", lambda c, k: F.struct(*(c[x].alias(x) for x in others), k.alias("cluster")))))
    large = sizes.filter(F.col("n") > SHEET).select("sheet")
    if large.take(1):
        out = out.unionByName(large_clusters(kept.join(large.hint("merge"), "sheet", "left_semi")))
    return out.withColumnRenamed("sheet", sheet).select(*cells.columns, "cluster")


def large_clusters(kept: DataFrame) -> DataFrame:
    """cell_clusters of sheets of any size: kept (sheet, row, col, ...) with their cluster.

    Squares so small that their cells are all within the distance are the
    nodes of a graph; squares are joined where the ends of their rows, or of their columns where one lies below the other, come near
    enough, which is where any of their cells do.
    """
    near = nearest_cells(kept)
    reach = near.groupBy("sheet").agg(F.floor(F.greatest(F.lit(1.0), 1.5 * F.median("nearest"))).cast("int").alias("e"))
    side = F.floor(F.col("e") / 2).cast("int") + 1
    placed = near.drop("nearest").join(reach.hint("merge"), "sheet").withColumns({"i": F.floor(F.col("row") / side), "j": F.floor(F.col("col") / side)})
    by = ["sheet", "e", "i", "j"]
    rows = placed.groupBy(*by, "row").agg(F.min("col").alias("low"), F.max("col").alias("high"))
    cols = placed.groupBy(*by, "col").agg(F.min("row").alias("low"), F.max("row").alias("high"))

    def edges(lines: DataFrame, across: str, offsets: list[tuple[int, int]]) -> DataFrame:
        step = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets)))
        one = lines.withColumn("o", step).select("sheet", "e", F.col("i").alias("i0"), F.col("j").alias("j0"), (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), F.col(across).alias("x"), F.col("high").alias("end"))
        two = lines.select("sheet", "i", "j", F.col(across).alias("y"), F.col("low").alias("begin"))
        met = one.join(two.hint("merge"), ["sheet", "i", "j"]).filter(F.abs(F.col("x") - F.col("y")) + F.col("begin") - F.col("end") <= F.col("e"))
        return met.select(F.struct("sheet", F.col("i0").alias("i"), F.col("j0").alias("j")).alias("p"), F.struct("sheet", "i", "j").alias("q")).distinct()

    beside = edges(rows, "row", [(a, b) for a in range(-2, 3) for b in (1, 2)])
    below = edges(cols, "col", [(1, 0), (2, 0)])
    found = components(beside.unionByName(below).select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")))
    node = F.struct("sheet", "i", "j")
    named = placed.withColumn("node", node).join(found.hint("merge"), "node", "left").select("sheet", "row", "col", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("sheet", "component").agg(F.min(F.struct("row", "col")).alias("first"))
    numbered = firsts.withColumn("cluster", F.row_number().over(Window.partitionBy("sheet").orderBy("first")) - 1).select("component", "cluster")
    labels = named.join(numbered.hint("merge"), "component").select("sheet", "row", "col", "cluster")
    return kept.join(labels.hint("merge"), ["sheet", "row", "col"]).select(*kept.columns, F.col("cluster").cast("int").alias("cluster"))


def rows_text(cells: DataFrame, by: list[str]) -> DataFrame:
    """Each row of cells as text joined by ~ in column order, and whether most of its cells are headers."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), "~")
    heads = F.count_if(F.coalesce("is_header", F.lit(False)))
    return cells.groupBy(*by, "row").agg(ordered.alias("line"), (heads > F.count("*") - heads).alias("header"))


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}_dup_{k}" if k else n)
    return out


def header_of(rows: list[list[str]]) -> tuple[list[str], int]:
    """Names and how many rows they take: two where the first has gaps that the second fills with text."""
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    if not rows:
        return [], 0
    first = rows[0]
    texts = lambda r: all(not x.strip() or not x.strip().replace(".", "", 1).isdigit() for x in r)
    if len(rows) > 1 and any(not x.strip() for x in first) and texts(rows[1]) and all(x.strip() for x in rows[1]):
        last, merged = "", []
        for a, b in zip(first, rows[1], strict=True):
            last = a.strip() or last
            merged.append(f"{last} {b.strip()}".strip())
        return unique_names(merged), 2
    return unique_names([x.strip() or f"column_{k + 1}" for k, x in enumerate(first)]), 1


def records(rows: list[list[str]]) -> list[dict[str, str]]:
    """Rows under their header as name to value; blanks are left out."""
    names, n = header_of(rows)
    return [{k: v for k, v in zip(names, r, strict=False) if v is not None and v.strip()} for r in rows[n:]]


@F.pandas_udf(ArrayType(StructType().add("col", "integer").add("name", "string").add("taken", "integer")))
def _names(heads: pd.Series, widths: pd.Series) -> pd.Series:
    """The names of each sheet's columns, and how many rows they take, from its first two rows of (row, col, value)."""
    out = []
    for cells, width in zip(heads, widths, strict=True):
        rows: dict[int, list[str]] = {}
        for c in sorted(cells, key=lambda c: (c["row"], c["col"])):
            rows.setdefault(c["row"], [""] * int(width))[c["col"] - 1] = c["value"] or ""
        names, n = header_of(list(rows.values()))
        out.append([{"col": k + 1, "name": name, "taken": n} for k, name in enumerate(names)])
    return pd.Series(out)


def table_records(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """(sheet, row, name, value) of the rows under each sheet's header, blanks left out: ragged rows are filled up, repeated
    headers numbered, a header of two rows merged. Only the first two rows of a sheet meet in a task; the others are joined to their names."""
    own = cells.select(sheet, "row", "col", "value")
    first = own.groupBy(sheet).agg(F.min("row").alias("__one"), F.max("col").alias("__width"))
    second = own.join(first.select(sheet, "__one"), sheet).filter(F.col("row") > F.col("__one")).groupBy(sheet).agg(F.min("row").alias("__two"))
    ends = first.join(second, sheet, "left")
    top = own.join(ends, sheet).filter((F.col("row") == F.col("__one")) | (F.col("row") == F.col("__two")))
    heads = top.groupBy(sheet, "__one", "__two", "__width").agg(F.collect_list(F.struct("row", "col", "value")).alias("__cells"))
    named = heads.select(sheet, "__one", "__two", F.explode(_names("__cells", "__width")).alias("n")).select(sheet, "__one", "__two", "n.*")
    below = F.when(F.col("taken") == 2, F.col("__two")).otherwise(F.col("__one"))
    return own.join(named.withColumn("__below", below), [sheet, "col"]).filter((F.col("row") > F.col("__below")) & (F.trim("value") != "")).select(sheet, "row", "name", "value")


def spread_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """cells with the value of each merged range (sheet, row0, col0, row1, col1) in all its cells."""
    rows, cols = F.explode(F.sequence("row0", "row1")).alias("row"), F.explode(F.sequence("col0", "col1")).alias("col")
    value = cells.select("sheet", F.col("row").alias("row0"), F.col("col").alias("col0"), "value")
    # ranges meet their values before they become cells, so that only one join sorts what they cover
    filled = merged.join(value, ["sheet", "row0", "col0"]).select("sheet", rows, "col0", "col1", "value").select("sheet", "row", cols, "value")
    area = merged.select("sheet", rows, "col0", "col1").select("sheet", "row", cols)
    return filled.unionByName(cells.select("sheet", "row", "col", "value").join(area, ["sheet", "row", "col"], "left_anti"))


def full_grid(cells: DataFrame) -> DataFrame:
    """Every (row, col) of each sheet's extent; empty where there is no cell."""
    size = cells.groupBy("sheet").agg(F.max("row").alias("r"), F.max("col").alias("c"))
    grid = size.select("sheet", F.explode(F.sequence(F.lit(1), "r")).alias("row"), "c").select("sheet", "row", F.explode(F.sequence(F.lit(1), "c")).alias("col"))
    return grid.join(cells.select("sheet", "row", "col", "value"), ["sheet", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def word_lines(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """words (doc_id, page, x0, top, text) as lines: a new one where the top leaves the first word's by more than gap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "x0"], kind="stable")
        lines: list[list] = []
        for r in pdf.itertuples():
            if not lines or abs(r.top - lines[-1][0]) > gap:
                lines.append([r.top, []])
            lines[-1][1].append((r.x0, r.text))
        first = pdf.iloc[0]
        return pd.DataFrame([(first["doc_id"], first["page"], k, t, " ".join(x for _, x in sorted(w))) for k, (t, w) in enumerate(lines)], columns=["doc_id", "page", "line", "top", "text"])

    return words.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, line int, top double, text string")


def column_lines(words: DataFrame, gap: float = 3.0, between: float = 20.0) -> DataFrame:
    """words (doc_id, page, x0, x1, top, text) as lines in reading order: (doc_id, page, col, line, top, text).

    A column begins where a word starts more than ``between`` right of all that start before it end. In a column words go by
    top; a line begins where the top leaves that of the line's first word by more than ``gap``. That anchor is carried
    through a page's sorted words by a fold, which keeps only where lines begin; a page is what a task holds.
    """
    page = ["doc_id", "page"]
    ends = F.max("x1").over(Window.partitionBy(*page).orderBy("x0", "x1", "top", "text").rowsBetween(Window.unboundedPreceding, -1))
    starts = (F.col("x0") - ends > between).cast("int")
    order = Window.partitionBy(*page).orderBy("x0", "x1", "top", "text")
    placed = words.withColumn("__new", F.coalesce(starts, F.lit(0))).withColumn("col", F.sum("__new").over(order).cast("int"))
    own = placed.groupBy(*page, "col").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("words"))
    none = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("begins"))

    def step(a: Column, w: Column) -> Column:
        at, new = a["at"] + 1, a["anchor"].isNull() | (w["top"] - a["anchor"] > gap)
        return F.struct(at.alias("at"), F.when(new, w["top"]).otherwise(a["anchor"]).alias("anchor"), F.when(new, F.array_append(a["begins"], at)).otherwise(a["begins"]).alias("begins"))

    begins = own.withColumn("begins", F.aggregate("words", none, step)["begins"])
    lines = begins.select(*page, "col", "words", F.posexplode(F.arrays_zip(F.col("begins").alias("a"), F.concat(F.slice("begins", F.lit(2), F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.size("words"))).alias("b"))).alias("line", "span"))
    line = F.slice("words", F.col("span.a") + 1, F.col("span.b") - F.col("span.a"))
    across = F.array_sort(F.transform(line, lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text"))))
    return lines.select(*page, "col", "line", line[0]["top"].alias("top"), F.array_join(F.transform(across, lambda w: w["text"]), " ").alias("text"))


#: How lines begin that are notices and not text.
NOTICES = ("page", "sr #", "copyright", "table of contents")


def denoised_lines(lines: Column) -> Column:
    """Trimmed lines (array) without repeats of the last kept one, those of fewer than three words, and notices.

    Tests of single lines come first; what is left is kept where it differs from the line before it, which
    is the last kept one or equal to it.
    """
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    words = lambda x: F.size(F.filter(F.split(x, r"[ \t\r]+"), lambda w: w != ""))

    def wanted(x: Column) -> Column:
        low = F.lower(x)
        notice = x.startswith("©") | low.endswith("confidential") | x.contains("." * 15)
        for n in NOTICES:
            notice = notice | low.startswith(n)
        return (words(x) >= 3) & ~notice

    return changed(F.filter(trimmed, wanted))


def changed(values: Column) -> Column:
    """The elements of an array that differ from the one before."""
    pairs = F.arrays_zip(values.alias("now"), F.concat(F.array(F.lit(None).cast("string")), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0)))).alias("before"))
    return F.transform(F.filter(pairs, lambda p: ~p["now"].eqNullSafe(p["before"])), lambda p: p["now"])

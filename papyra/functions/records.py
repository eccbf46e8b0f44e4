"""Columns over records, documents and pages: dates, sections, placeholders, page statistics, responses."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from papyra.functions.text import escape_html

#: Date forms in the order in which they are tried.
FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "dd/MM/yyyy HH:mm", "MMM d, yyyy", "yyyy-MM-dd")


def parsed_time(c: Column, forms: tuple[str, ...] = FORMS) -> Column:
    """The first form that reads the whole text; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in forms))


def with_section(body: Column, header: str, text: Column) -> Column:
    """body with the section under ``## header`` replaced, or added at the end; other sections stay."""
    parts = F.filter(F.split(F.coalesce(body, F.lit("")), r"(?m)(?=^## )"), lambda p: F.trim(p) != "")
    own = F.concat(F.lit(f"## {header}\n"), text, F.lit("\n"))
    here = F.exists(parts, lambda p: p.startswith(f"## {header}\n"))
    put = F.transform(parts, lambda p: F.when(p.startswith(f"## {header}\n"), own).otherwise(p))
    return F.when(here, F.array_join(put, "")).otherwise(F.concat(F.array_join(parts, ""), own))


def fill_placeholders(text: Column, found: Column) -> Column:
    """[IMAGE: name] marks replaced by the map's text; those without one go."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[IMAGE: ([^\]]*)\]"), F.lit(1)))
    return F.aggregate(names, text, lambda t, n: F.call_function("replace", t, F.concat(F.lit("[IMAGE: "), n, F.lit("]")), F.coalesce(F.try_element_at(found, n), F.lit(""))))


def vision_tokens(width: Column, height: Column, patch: int = 14) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("long")


def deck_score(large_fonts: Column, short_lines: Column, wide: Column) -> Column:
    """How much a file looks like slides, in percent of its pages' shares; 60 and more is one."""
    return 0.2 * large_fonts + 0.3 * short_lines + 0.5 * wide


#: Weight of each sign of noise, in the order of the tests.
JUNK_WEIGHTS = (0.1, 0.25, 0.25, 0.1, 0.2, 0.1)


def junk_score(line: Column) -> Column:
    """How much a recognised line looks like noise, 0 to 1; over 0.5 it is.

    Signs: under three characters; over a fifth not letters or digits; short words, by word characters; nothing
    but symbols; short words, by blanks; one word in capitals.
    """
    mean = lambda words: F.coalesce(F.try_divide(F.aggregate(words, F.lit(0.0), lambda n, w: n + F.length(w)), F.size(words).cast("double")), F.lit(0.0))
    signs = (
        F.length(F.trim(line)) < 3,
        F.length(F.regexp_replace(line, "[A-Za-z0-9]", "")) / F.greatest(F.length(line), F.lit(1)) > 0.2,
        mean(F.regexp_extract_all(line, F.lit("[A-Za-z0-9_]+"), F.lit(0))) < 5,
        line.rlike("^[^A-Za-z0-9]{3,}$"),
        mean(F.filter(F.split(line, " "), lambda w: w != "")) < 5,
        (F.upper(line) == line) & (F.lower(line) != line) & ~line.contains(" ") & (F.length(line) > 5),
    )
    return F.round(sum((F.when(test, w).otherwise(0.0) for w, test in zip(JUNK_WEIGHTS[1:], signs[1:], strict=True)), F.when(signs[0], JUNK_WEIGHTS[0]).otherwise(0.0)), 2)


def ranked_html(offers: Column, above: float) -> Column:
    """An HTML table of (name, score) offers above the bound, best first."""
    kept = F.filter(offers, lambda o: o["score"] > above)
    rows = F.transform(F.array_sort(kept, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["name"] < b["name"], -1).otherwise(1)), lambda o: F.concat(F.lit("<tr><td>"), escape_html(o["name"]), F.lit("</td><td>"), F.printf(F.lit("%.1f"), o["score"]), F.lit("</td></tr>")))
    return F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))


#: Answers that mean that there is none.
NEGATIVE = (
    "none", "", "not specified", "not available", "not explicitly mentioned", "not provided", "not specified in the document",
    "none explicitly stated", "n/a", "na", "not found", "not mentioned", "unknown", "null",
)


def cleaned(record: Column, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """A map with lower-case keys, without empty and negative values."""
    low = F.transform_keys(record, lambda k, v: F.lower(F.trim(k)))
    return F.map_filter(low, lambda k, v: v.isNotNull() & ~F.lower(F.trim(v)).isin(*negative))


@F.pandas_udf(MapType(StringType(), StringType()))
def literal_map(line: pd.Series) -> pd.Series:
    """Lines that are a Python dict literal as a map; null for others."""

    def one(x):
        try:
            got = ast.literal_eval(x)
            return {str(k): str(v) for k, v in got.items()} if isinstance(got, dict) else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return line.map(one)


def control_table(header: Column, known: list[str]) -> Column:
    """True for a header row (array of texts) of a document-control table: mostly words, in title case, with a known name."""
    cells = F.filter(header, lambda c: F.trim(c) != "")
    joined = F.array_join(cells, "")
    digits = F.length(F.regexp_replace(joined, "[^0-9]", "")) / F.greatest(F.length(joined), F.lit(1))
    titles = F.forall(cells, lambda c: F.trim(c) == F.initcap(F.trim(c)))
    return (digits < 0.3) & titles & (F.size(F.array_intersect(F.transform(cells, lambda c: F.lower(F.trim(c))), F.array(*map(F.lit, known)))) > 0)


#: Offsets of zone abbreviations that dates come with.
ZONES = {"IST": "+0530", "UTC": "+0000", "GMT": "+0000"}


def zoned_time(c: Column, zones: dict[str, str] | None = None) -> Column:
    """'Mon Jan 01 10:00:00 IST 2024' as a UTC timestamp; null for other forms and zones."""
    rest = F.regexp_extract(c, r"^[A-Za-z]{3} ([A-Za-z]{3} [0-9]{2} [0-9:]{8}) ([A-Z]{3,4}) ([0-9]{4})$", 1)
    zone, year = (F.regexp_extract(c, r"^[A-Za-z]{3} ([A-Za-z]{3} [0-9]{2} [0-9:]{8}) ([A-Z]{3,4}) ([0-9]{4})$", k) for k in (2, 3))
    offset = F.create_map(*(F.lit(x) for kv in (zones or ZONES).items() for x in kv))[zone]
    return F.try_to_timestamp(F.concat_ws(" ", rest, offset, year), F.lit("MMM dd HH:mm:ss xx yyyy"))


def any_time(c: Column) -> tuple[Column, Column]:
    """The time that a text says, and the error where no form reads it."""
    at = F.coalesce(zoned_time(c), parsed_time(c))
    return at, F.when(c.isNotNull() & at.isNull(), F.concat(F.lit("unreadable date: "), c))


def stamp(at: Column) -> Column:
    """A UTC stamp; the session's zone must be UTC."""
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def flat_items(response: Column, required: list[str]) -> Column:
    """Of a map of source to arrays of maps: all items that have every required key, with their source; an array."""
    kept = lambda k: F.filter(response[k], lambda x: F.forall(F.array(*map(F.lit, required)), lambda r: F.coalesce(F.try_element_at(x, r), F.lit("")) != ""))
    return F.flatten(F.transform(F.map_keys(response), lambda k: F.transform(kept(k), lambda x: F.map_concat(x, F.create_map(F.lit("source"), k)))))


def upper_names(names: list[str]) -> list[str]:
    """Headers in capitals with blanks for underscores."""
    return [n.upper().replace("_", " ") for n in names]


def after_mark(lines: Column, marks: list[str]) -> Column:
    """For each line (array) whether the line before it is one of the marks, such as the heading of a table to leave out."""
    return F.transform(lines, lambda x, i: F.when(i == 0, False).otherwise(F.lower(F.trim(F.get(lines, i - 1))).isin(*marks)))


def variant_items(rows: DataFrame, key: str, said: str) -> DataFrame:
    """(key, kind, pos, key of an object's item, value): items of JSON arrays and objects, values as JSON text; other values have none."""
    v = rows.select(F.col(key), F.try_parse_json(said).alias("__v")).withColumn("__schema", F.schema_of_variant("__v"))
    kind = F.when(F.col("__schema").startswith("OBJECT"), "OBJECT").when(F.col("__schema").startswith("ARRAY"), "ARRAY")
    own = v.withColumn("kind", kind).filter("kind is not null")
    item = own.sparkSession.tvf.variant_explode(F.col("__v").outer())
    return own.lateralJoin(item).select(key, "kind", F.col("pos"), F.col("key"), F.to_json("value").alias("value"))

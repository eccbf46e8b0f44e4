"""Sensitive text: detection by patterns and column names, vetoes and lists, redaction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns by label, in a form that both Java's and RE2's engines read alike: addresses by the dec-octet of RFC 3986, bearer tokens by
#: the b64token of RFC 6750.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "INTERNAL_EMAIL": r"[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)?(?:corp|internal|intranet)\.[a-z.]+",
    "SSN": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "IP": r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])",
    "PHONE": r"\+?[0-9]{1,3}[ -]\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}",
    "HEX": r"[0-9a-f]{32,}",
    "URL": r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+",
    "SERVER": r"server(?: ?name)? ?[:=] *([A-Za-z0-9._-]+)",
    "PASSWORD": r"passw(?:or)?d *[:=] *([^ \t\r\n]+)",
    "SESSION": r"session[_-]?id *[:=] *([A-Za-z0-9._-]+)",
    "API_KEY": r"(?:api|access)[_ -]?key(?:_id)? *[:=] *([A-Za-z0-9/+_-]{8,})",
    "TOKEN": r"bearer +([A-Za-z0-9._~+/-]+=*)",
    "COOKIE": r"(?:set-)?cookie *: *([^\r\n]+)",
    "PASSPHRASE": r"pass[ _-]?phrase *[:=] *([^\r\n]+)",
}


#: What a text must hold, in lower case, for a pattern to have a match: found far faster than the pattern is tried.
NEEDS = {"EMAIL": "@", "INTERNAL_EMAIL": "@", "SSN": "-", "IP": ".", "URL": "://", "SERVER": "server", "PASSWORD": "passw", "SESSION": "session", "API_KEY": "key", "TOKEN": "bearer ", "COOKIE": "cookie", "PASSPHRASE": "phrase"}


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, label, text, n): every match of every pattern, case ignored, group 1 where the pattern has one; one pass over the texts.

    A pattern that has NEEDS is tried only where the text holds them.
    """
    needs = NEEDS if patterns is None else {}
    patterns = patterns or PATTERNS

    def hits(name: str, p: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1 if re.compile(p).groups else 0))
        return F.when(F.col("__low").contains(needs[name]), found) if name in needs else found

    found = F.array(*(F.struct(F.lit(name).alias("label"), hits(name, p).alias("hits")) for name, p in patterns.items()))
    rows = docs.select(key, text, F.lower(text).alias("__low")).select(key, F.explode(found).alias("x")).filter(F.size("x.hits") > 0)
    return rows.select(key, "x.label", F.explode("x.hits").alias("text")).groupBy(key, "label", "text").agg(F.count("*").alias("n"))


def detect_cells(tables: DataFrame, names: DataFrame, key: str = "doc_id", row: str = "cells", name: str = "name", label: str = "label") -> DataFrame:
    """(key, label, text, score): values of table columns whose name is in the list, with score 1."""
    cells = tables.select(key, F.explode(row).alias("name", "text"))
    listed = names.select(F.lower(F.trim(name)).alias("__n"), F.col(label).alias("label"))
    return cells.join(listed, F.lower(F.trim("name")) == F.col("__n")).select(key, "label", "text", F.lit(1.0).alias("score")).distinct()


def full_value_label(value: Column, patterns: dict[str, str] | None = None) -> Column:
    """The first pattern that a whole cell value matches."""
    out = F.when(F.lit(False), "")
    for name, p in (patterns or PATTERNS).items():
        out = out.when(value.rlike(f"^(?:{p})$"), name)
    return out


def veto(items: DataFrame, by: list[str]) -> DataFrame:
    """Score 0 for all items with a text that some source scores 0."""
    none = F.max(F.when(F.col("score") == 0, 1).otherwise(0)).over(Window.partitionBy(*by)) == 1
    return items.withColumn("vetoed", none).withColumn("score", F.when(none, 0.0).otherwise(F.col("score")))


def listed(items: DataFrame, include: DataFrame, exclude: DataFrame, above: float = 0.5, longer: int = 3) -> DataFrame:
    """Labelled items above the score and length that are not excluded, and all included ones with score 1. include, exclude: (text[, label])."""
    key = F.lower(F.trim(F.col("text")))
    kept = items.filter(F.col("label").isNotNull() & (F.col("score") > above) & (F.length("text") > longer)).withColumn("__t", key)
    kept = kept.join(exclude.select(key.alias("__t")).distinct(), "__t", "left_anti").drop("__t")
    return kept.unionByName(include.select("text", "label").withColumn("score", F.lit(1.0)), allowMissingColumns=True)


def redact_one(text: str | None, items: list[tuple[str, str]] | None, context: int = 40) -> tuple[str | None, list[tuple[str, str, str]]]:
    """text with each item as <LABEL>, in one pass, longest first, at word bounds, case ignored; what was replaced and its surroundings."""
    if not text or not items:
        return text, []
    of = {}
    for item, label in sorted(items, key=lambda x: (-len(x[0]), x)):
        if item:
            of.setdefault(item.lower(), label)
    if not of:
        return text, []
    quotes = {"'": "['‘’]", '"': '["“”]'}
    spell = lambda s: "".join(quotes.get(c, re.escape(c)) for c in s)
    pattern = re.compile("|".join((r"\b" if i[0].isalnum() else "") + spell(i) + (r"\b" if i[-1].isalnum() else "") for i in of), re.I)
    log: list[tuple[str, str, str]] = []

    def put(m: re.Match) -> str:
        label = of.get(m[0].lower()) or of.get(m[0].lower().translate(str.maketrans("‘’“”", "''\"\"")), "REDACTED")
        log.append((m[0], f"<{label}>", text[max(0, m.start() - context) : m.end() + context]))
        return f"<{label}>"

    return pattern.sub(put, text), log


def redact(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``redacted`` and ``redactions`` (text, placeholder, context). items: (key, text, label); a document's own items only."""
    own = items.groupBy(key).agg(F.collect_set(F.struct(F.col("text").alias("item"), "label")).alias("__items"))
    kinds, names = dict(docs.dtypes), docs.columns
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", redacted string, redactions array<struct<text: string, placeholder: string, context: string>>"

    def run(parts):
        for pdf in parts:
            got = [redact_one(t, [(x["item"], x["label"]) for x in i] if i is not None else None) for t, i in zip(pdf[text], pdf["__items"], strict=True)]
            out = pdf[names].copy()
            out["redacted"] = pd.Series([g[0] for g in got], index=out.index, dtype=object)
            out["redactions"] = pd.Series([[{"text": a, "placeholder": b, "context": c} for a, b, c in g[1]] for g in got], index=out.index, dtype=object)
            yield out

    return docs.join(own, key, "left").mapInPandas(run, schema)


def redact_patterns(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """redact() of what detect() finds, in one pass over the texts: nothing is shuffled and no text is read twice."""
    found = [(label, re.compile(p, re.I), NEEDS.get(label, "") if patterns is None else "") for label, p in (patterns or PATTERNS).items()]
    kinds, names = dict(docs.dtypes), docs.columns
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", redacted string, redactions array<struct<text: string, placeholder: string, context: string>>"

    def run(parts):
        for pdf in parts:
            got = []
            for t in pdf[text]:
                low = t.lower() if t else ""
                items = {(m[p.groups and 1], label) for label, p, need in found if need in low for m in p.finditer(t)} if t else ()
                got.append(redact_one(t, sorted(items)))
            out = pdf[names].copy()
            out["redacted"] = pd.Series([g[0] for g in got], index=out.index, dtype=object)
            out["redactions"] = pd.Series([[{"text": a, "placeholder": b, "context": c} for a, b, c in g[1]] for g in got], index=out.index, dtype=object)
            yield out

    return docs.mapInPandas(run, schema)


def mask(text: Column, items: Column, above: float = 0.5) -> Column:
    """text with each item (array of text, label, score) that scores above the bound as <LABEL>: longest first, at word bounds, case ignored; then mask_lines."""
    quoted = lambda t: F.regexp_replace(t, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    own = F.filter(items, lambda i: (i["score"] > above) & (F.length(i["text"]) > 0))
    longest = F.array_sort(own, lambda a, b: F.when(F.length(a["text"]) != F.length(b["text"]), F.length(b["text"]) - F.length(a["text"])).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))
    done = F.aggregate(longest, text, lambda t, i: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b"), quoted(i["text"]), F.lit(r"\b")), F.concat(F.lit("<"), i["label"], F.lit(">"))))
    return mask_lines(done)


def without_controls(rows: DataFrame, header: str, known: list[str]) -> DataFrame:
    """Tables (a header array and more) with the rows of document-control tables emptied: their headers say what they are."""
    from papyra.functions.records import control_table

    gone = control_table(F.col(header), known)
    return rows.withColumn("cleared", F.coalesce(gone, F.lit(False)))


def mask_lines(text: Column) -> Column:
    """Lines that hold only a placeholder go."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*<[A-Z_]+>\s*$")), "\n")

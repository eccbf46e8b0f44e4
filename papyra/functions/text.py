"""Text functions as columns; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; null for null texts, 0 where neither has a word."""
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(x) + F.size(y) - shared).cast("double")), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def concat_some(*cols: Column | str) -> Column:
    """Concatenation that skips nulls."""
    return F.concat(*(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols))


def blank_to(c: Column, default: str) -> Column:
    """Null and blank texts become the default."""
    return F.when(c.isNull() | (F.length(F.trim(c)) == 0), F.lit(default)).otherwise(c)


def pipe_list(c: Column) -> Column:
    """The parts of a pipe-joined text, trimmed, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[|]"), lambda x: F.trim(x)), lambda x: x != ""))


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, "\0", ""), r"\s+", " "))


def escape_html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def between_marks(c: Column, start: str, end: str) -> Column:
    """The text between the first start mark and the next end mark; null where either is missing."""
    rest = F.when(F.instr(c, start) > 0, F.call_function("substr", c, F.instr(c, start) + len(start)))
    return F.when(F.instr(rest, end) > 0, F.substring_index(rest, end, 1))


def column_number(letters: Column) -> Column:
    """Spreadsheet column letters as a number, A being 1."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def letters_number(cell: Column) -> tuple[Column, Column]:
    """(row, column) of a cell's name such as AB12."""
    return F.regexp_extract(cell, r"^([A-Z]+)([0-9]+)$", 2).try_cast("int"), column_number(F.regexp_extract(cell, r"^([A-Z]+)([0-9]+)$", 1))


def titled(c: Column) -> Column:
    """Each run of letters with a capital first; unlike initcap also after digits, apostrophes and dashes."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))), "")


def plain_text(c: Column) -> Column:
    """Without what is no printable ASCII character, white space or letter of a Latin alphabet."""
    return F.regexp_replace(c, "[^ -~\\n\\t\u00c0-\u017f]", "")


def without_nul(value: Column, kind: T.DataType) -> Column:
    """Texts without NUL characters, in nested arrays, structs and map values too; kind: the type of value."""
    if isinstance(kind, T.StringType):
        return F.translate(value, "\0", "")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_nul(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: without_nul(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(without_nul(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def html_list(title: str, items: Column) -> Column:
    return F.concat(F.lit(f"<b>{title}</b><br><ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), escape_html(x), F.lit("</li>"))), ""), F.lit("</ul>"))


def short_stem(name: Column, most: int = 20) -> Column:
    """The file's stem cut to ``most`` characters, with its suffix."""
    stem, ending = F.regexp_extract(name, r"^(.*?)([.][^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)([.][^.]*)?$", 2)
    return F.concat(F.substring(stem, 1, most), ending)


def sentence(*parts: tuple[str, Column]) -> Column:
    """'label value' for the values that are not blank, joined by commas, with a full stop."""
    named = F.filter(F.array(*(F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{label} "), F.trim(c))) for label, c in parts)), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, F.concat(F.array_join(named, ", "), F.lit(".")))


def around(c: Column, found: Column, width: int = 40) -> Column:
    """The first place of found with ``width`` characters on either side; null where it does not occur."""
    at = F.instr(c, found) if isinstance(found, str) else F.call_function("locate", found, c)
    low = F.greatest(F.lit(1), at - width)
    return F.when(at > 0, F.call_function("substr", c, low, at + F.length(found) + width - low))


def line_around(lines: Column, k: Column, width: int = 50) -> Column:
    """The k-th line (from 1) between at most ``width`` characters of the one before and the one after."""
    get = lambda i: F.coalesce(F.get(lines, i - 1), F.lit(""))
    return F.concat_ws("\n", F.call_function("right", get(k - 1), F.lit(width)), get(k), F.call_function("left", get(k + 1), F.lit(width)))


def token_count(c: Column) -> Column:
    """About how many tokens a text has: its words; a tokenizer is a column function given in its place."""
    return F.size(F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != ""))

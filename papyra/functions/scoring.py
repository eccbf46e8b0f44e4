"""Scores, scales and buckets as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length_of(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, b_length: Column | None = None) -> Column:
    """Cosine similarity of two arrays of numbers; null where a vector has no length. b_length: that of b, where it is known."""
    return F.try_divide(dot(a, b), length_of(a) * (length_of(b) if b_length is None else b_length))


def min_max(x: Column, low: Column, high: Column, default: float = 0.0) -> Column:
    """x between low and high as 0 to 100; the default, times 100, where they are equal or x is null."""
    return F.coalesce(F.try_divide(x - low, high - low), F.lit(default)) * 100


def blended(parts: list[tuple[Column, Column]], similarity: Column, acceptance: Column) -> Column:
    """Weighted sum, damped by up to 5 % as the lesser of similarity and acceptance falls; parts: (weight, value)."""
    total = sum((w * x for w, x in parts[1:]), parts[0][0] * parts[0][1])
    return total * (F.lit(0.95) + F.lit(0.05) * F.least(similarity, acceptance) / 100)


def right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin (edge, next edge] that x lies in, the first with its lower edge; null outside."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:], edges[2:], labels[1:], strict=False):
        out = out.when((x > low) & (x <= high), label)
    return out


#: Lower bound of each relevance label, and the upper bound that the literal form keeps.
RELEVANCE = ((91, 100, "Very High"), (76, 90, "High"), (51, 75, "Medium"), (26, 50, "Low"), (0, 25, "Very Low"))


def relevance(x: Column, literal: bool = False) -> Column:
    """The label of a score of 0 to 100. The literal form has closed integer bounds, so scores between them have none."""
    out = F.when(F.lit(False), "")
    for low, high, label in RELEVANCE:
        out = out.when(x.between(low, high), label) if literal else out.when(x > (low - 1 if low else -1), label)
    return out


def similarity_level(x: Column) -> Column:
    return F.when(x > 75, "High").when(x > 40, "Medium").otherwise("Low")


#: Grades and levels from the most to the least urgent.
GRADES, LEVELS = ("A", "B", "C", "D", "E"), ("Low", "Medium", "High")


def priority(grade: Column, level: Column) -> Column:
    """P1 to P15 by grade, then level; empty for others."""
    out = F.when(F.lit(False), "")
    for g, name in enumerate(GRADES):
        for v, lev in enumerate(LEVELS):
            out = out.when((grade == name) & (level == lev), f"P{g * len(LEVELS) + v + 1}")
    return out.otherwise("")


def grade(mean: Column) -> Column:
    out = F.when(F.lit(False), "")
    for bound, name in zip((80, 70, 60, 50), GRADES, strict=False):
        out = out.when(mean >= bound, name)
    return out.otherwise(GRADES[-1])


def accuracy(total: Column, errors: Column) -> Column:
    """Percent without error, two places; 0 where there is nothing."""
    return F.coalesce(F.round(F.try_divide((total - errors) * 100.0, total.cast("double")), 2), F.lit(0.0))


def distinct_accuracy(errors: Column, total: Column) -> Column:
    """Percent of words without one of the distinct errors (array), two places, 0 at least; 100 where there is no word."""
    share = F.try_divide(F.size(F.array_distinct(errors)) * 100.0, total.cast("double"))
    return F.coalesce(F.round(F.greatest(F.lit(0.0), 100.0 - share), 2), F.lit(100.0))


def weighted_accuracy(lines: Column, bad_lines: Column, words: Column, bad_words: Column) -> Column:
    """0.6 of the lines' accuracy and 0.4 of the words', two places; 0 for what there is none of."""
    one = lambda n, bad: F.coalesce(F.try_divide((n - bad) * 100.0, n.cast("double")), F.lit(0.0))
    return F.round(0.6 * one(lines, bad_lines) + 0.4 * one(words, bad_words), 2)


#: Least mean of each grade.
KPI_GRADES = ((80, "Very High"), (70, "High"), (60, "Medium"), (50, "Low"))


def kpi_grade(scores: Column) -> tuple[Column, Column]:
    """The mean of the scores of a map, and its grade."""
    values = F.map_values(scores)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda n, x: n + x), F.size(values).cast("double"))
    out = F.when(F.lit(False), "")
    for bound, name in KPI_GRADES:
        out = out.when(mean >= bound, name)
    return mean, F.when(mean.isNotNull(), out.otherwise("Very Low"))


def mean_score(score: Column) -> Column:
    """Mean of the scores that are there, two places; 0 where there are none. An aggregate."""
    return F.coalesce(F.round(F.avg(score), 2), F.lit(0.0))


def even_score(text: Column, criterion: str) -> Column:
    """A deterministic stand-in for a model's judgement: 0 to 100 by the text's digest, the same for equal texts."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{criterion}:"), text)), 1, 4)
    return (F.conv(digest, 16, 10).cast("int") % 101).cast("double")


def judged(rows: DataFrame, text: str, criteria: list[str], scorer: Callable[[Column, str], Column] = even_score) -> DataFrame:
    """rows with ``scores`` (criterion to score), their ``mean`` and its ``grade``. scorer: a column of the text and a criterion, such as a pandas UDF that asks a model."""
    scores = F.create_map(*(x for c in criteria for x in (F.lit(c), scorer(F.col(text), c))))
    out = rows.withColumn("scores", scores)
    mean, grade = kpi_grade(F.col("scores"))
    return out.withColumns({"mean": mean, "grade": grade})

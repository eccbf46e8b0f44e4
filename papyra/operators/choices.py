"""The best of a catalogue for each text by the token-set ratio, exactly and without a cap on the catalogue.

A ratio of 100 means that one side's tokens hold the other's. Then the rarest token of the smaller side is among the larger
side's, so those pairs come from a join on tokens, each side's rarest against the other's all. Texts that have no such choice meet the
catalogue in blocks. In a block the ratio of every choice has an upper bound from its tokens' and characters' counts, taken for
all choices in one array operation; choices are compared by falling bound until the bound is below the best ratio found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.fuzzy import token_set_of

TEXTS, CHOICES = 256, 2048


class Catalogue:
    """A block of choices with what bounds their ratios: tokens, lengths of joined tokens, counts of characters."""

    def __init__(self, choices: list[str]) -> None:
        self.choices = sorted(choices)
        self.tokens = [sorted(set(c.lower().split())) for c in self.choices]
        self.holders: dict[str, list[int]] = {}
        for k, own in enumerate(self.tokens):
            for t in own:
                self.holders.setdefault(t, []).append(k)
        self.chars = {c: k for k, c in enumerate(sorted({c for own in self.tokens for t in own for c in t}))}
        self.counts = np.array([self._count(own) for own in self.tokens], np.int32).reshape(len(self.choices), len(self.chars) + 1)
        self.size = np.array([len(" ".join(own)) for own in self.tokens], np.float64)

    def _count(self, tokens: list[str]) -> list[int]:
        """Of each known character, and last of the spaces between tokens."""
        out = [0] * (len(self.chars) + 1)
        for c, n in Counter("".join(tokens)).items():
            if c in self.chars:
                out[self.chars[c]] = n
        out[-1] = max(0, len(tokens) - 1)
        return out

    def bounds(self, tokens: list[str]) -> np.ndarray:
        """No less than the ratio of each choice: the common subsequence of the joined tokens has no more characters than both share, and
        against the shared tokens alone the ratio is twice their length over both lengths."""
        size = len(" ".join(tokens))
        shared = np.zeros(len(self.choices))
        for t in tokens:
            shared[self.holders.get(t, [])] += len(t) + 1
        shared = np.maximum(0, shared - 1)
        common = np.minimum(self.counts, np.array(self._count(tokens), np.int32)).sum(axis=1)
        whole = 200.0 * common / np.maximum(1, self.size + size)
        part = np.where(shared > 0, 200.0 * shared / np.maximum(1, shared + np.minimum(size, self.size)), 0.0)
        return np.maximum(whole, part)

    def best(self, text: str, least: float) -> tuple[float, str] | None:
        """The best ratio, of equal ones the first choice; nothing below ``least``."""
        tokens = sorted(set(text.lower().split()))
        bounds = self.bounds(tokens)
        found: tuple[float, int] | None = None
        for k in np.argsort(-bounds, kind="stable").tolist():
            if bounds[k] < (found[0] if found else least) - 1e-9:
                break
            value = token_set_of(text, self.choices[k])
            if value >= least and (found is None or (-value, k) < (-found[0], found[1])):
                found = value, k
        return (found[0], self.choices[found[1]]) if found else None


def _held(texts: DataFrame, choices: DataFrame) -> DataFrame:
    """(text, choice) where the tokens of one hold the other's; both: (name, tokens)."""
    a, b = (df.select(F.col("name").alias(n), F.col("tokens").alias(f"t_{n}")) for df, n in ((texts, "text"), (choices, "choice")))
    counts = a.select(F.explode("t_text").alias("token")).unionByName(b.select(F.explode("t_choice").alias("token"))).groupBy("token").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, n: str) -> DataFrame:
        return df.select(n, F.explode(f"t_{n}").alias("token")).join(counts, "token").groupBy(n).agg(F.min_by("token", F.struct("n", "token")).alias("token"))

    one = rarest(a, "text").join(b.select("choice", F.explode("t_choice").alias("token")), "token").select("text", "choice")
    two = rarest(b, "choice").join(a.select("text", F.explode("t_text").alias("token")), "token").select("text", "choice")
    both = one.unionByName(two).distinct().join(a, "text").join(b, "choice")
    shared = F.size(F.array_intersect("t_text", "t_choice"))
    return both.filter(shared == F.least(F.size("t_text"), F.size("t_choice"))).select("text", "choice")


def best_choices(rows: DataFrame, catalogue: DataFrame, text: str, choice: str, least: float = 0.0) -> DataFrame:
    """(text, choice, score): the best choice of each distinct text by token_set_ratio, of equal ones the first by name."""
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda t: t != "")))
    texts, names = (df.select(F.col(c).alias("name")).filter(F.col(c).isNotNull()).distinct().withColumn("tokens", tokens) for df, c in ((rows, text), (catalogue, choice)))
    whole = _held(texts.filter(F.size("tokens") > 0), names.filter(F.size("tokens") > 0)).groupBy("text").agg(F.min("choice").alias("choice")).withColumn("score", F.lit(100.0))
    left = texts.select(F.col("name").alias("text")).join(whole.select("text"), "text", "left_anti")
    blocks = max(1, -(-names.count() // CHOICES))
    parts = max(1, -(-left.count() // TEXTS))
    held = names.groupBy(F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("b")).agg(F.collect_list("name").alias("choices"))
    asked = left.groupBy(F.pmod(F.xxhash64("text"), F.lit(parts)).alias("p")).agg(F.collect_list("text").alias("texts"))
    met = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(held, "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, own, known in zip(pdf["b"], pdf["texts"], pdf["choices"], strict=True):
                block = Catalogue(list(known))
                found = [(t, *got[::-1]) for t in own if (got := block.best(t, least))]
                yield pd.DataFrame(found, columns=["text", "choice", "score"])

    near = met.select("b", "texts", "choices").mapInPandas(run, "text string, choice string, score double")
    w = Window.partitionBy("text").orderBy(F.col("score").desc(), "choice")
    near = near.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return whole.select("text", "choice", "score").unionByName(near).select(F.col("text").alias(text), F.col("choice").alias(choice), "score")

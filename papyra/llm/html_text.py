"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

Every block has binary features of the tags and names that it lies in and of its text; the chain joins
adjacent blocks. Weights are trained on labelled pages by stochastic gradients of the conditional
likelihood (forward-backward) with a step size for each weight, always in the same order, and pages are
decoded by Viterbi. Training uses ``PAGES`` labelled pages, whatever the table; the weights are
broadcast, and their number is bounded by the features of these pages.

A null or empty page, and one whose blocks are all outside the article, gives an empty text. Whole
pages are read, whatever their length. Repeated rows are read alike; an empty table gives an empty
table; columns besides the named ones are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import common
from papyra.llm.dom import Block, Element, blocks
from papyra.llm.labelled_pages import labelled_page

PAGES = 800
EPOCHS = 6
STEP = 0.3
SHRINK = 1e-4
MAIN = 1


class Inside:
    """The features of the elements that a block lies in, kept from block to block, so that a page costs its tags and not blocks times depth."""

    def __init__(self, known: dict[str, float] | None) -> None:
        self.known, self.here, self.count = known, None, {}

    def _of(self, e: Element) -> list[str]:
        out = [] if e.tag in ("html", "body") else [f"in:{e.tag}"]
        out += [f"name:{x}" for x in e.names]
        return out if self.known is None else [x for x in out if x in self.known]

    def move(self, to: Element | None) -> list[str]:
        new, old = [], self.here
        while to is not old:
            if to is None or (old is not None and old.depth >= to.depth):
                for x in self._of(old):
                    self.count[x] -= 1
                    if not self.count[x]:
                        del self.count[x]
                old = old.parent
            else:
                new.append(to)
                to = to.parent
        for e in reversed(new):
            for x in self._of(e):
                self.count[x] = self.count.get(x, 0) + 1
        if new:
            self.here = new[0]
        else:
            self.here = old
        return list(self.count)


def features(page: list[Block], known: dict[str, float] | None = None) -> list[list[str]]:
    """known: features of elements besides these may be left out, so that a block has no more of them than a model knows."""
    out = []
    n = len(page)
    inside = Inside(known)
    for k, b in enumerate(page):
        own = [] if b.element is None else [b.element] if b.element.parent is None else [b.element.parent, b.element]
        tags = b.element.tags if b.element else ()
        f = ["bias", *inside.move(b.element)]
        f.append("own:" + (tags[-1] if tags else "body"))
        f.append("up:" + ">".join(tags[-2:]))
        f.append("up with names:" + ">".join(".".join((e.tag, *e.names)) for e in own))
        if own:
            f += [f"own:{own[-1].tag}.{x}" for x in own[-1].names]
        words = b.text.count(" ") + 1
        f.append(f"words:{min(6, words.bit_length())}")
        f.append(f"links:{min(4, int(4 * b.links / max(1, len(b.text))))}")
        f.append(f"end:{b.text[-1] if b.text[-1] in '.!?:,;' else ''}")
        if b.text[0] in "©®":
            f.append("sign")
        f.append("commas" if b.text.count(",") > 1 else "plain")
        if k == 0 or k == n - 1:
            f.append("first" if k == 0 else "last")
        out.append(f)
    return out


def _log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


class Field:
    """Two labels. weights: of each feature for label MAIN against the other; chain: of each pair of adjacent labels."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.chain = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, page: list[list[str]]) -> list[float]:
        w = self.weights
        return [sum(w.get(x, 0.0) for x in f) for f in page]

    def decode(self, page: list[list[str]]) -> list[int]:
        """The best sequence of labels; ties go to the label outside."""
        if not page:
            return []
        c = self.chain
        a, b = 0.0, 0.0
        back = []
        for k, s in enumerate(self.scores(page)):
            if k:
                stay, move = a + c[0][0], b + c[1][0]
                enter, on = a + c[0][1], b + c[1][1]
                back.append((int(move > stay), int(on > enter)))
                a, b = max(stay, move), max(enter, on)
            b += s
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def marginals(self, page: list[list[str]]) -> tuple[list[float], list[list[list[float]]]]:
        """Chances of MAIN at each block, and of each pair of labels at each step."""
        s, c = self.scores(page), self.chain
        forth = [(0.0, s[0])]
        for x in s[1:]:
            a, b = forth[-1]
            forth.append((_log_add(a + c[0][0], b + c[1][0]), x + _log_add(a + c[0][1], b + c[1][1])))
        back = [(0.0, 0.0)]
        for x in reversed(s[1:]):
            a, b = back[-1]
            back.append((_log_add(c[0][0] + a, c[0][1] + x + b), _log_add(c[1][0] + a, c[1][1] + x + b)))
        back.reverse()
        z = _log_add(*forth[-1])
        one = [math.exp(f[1] + g[1] - z) for f, g in zip(forth, back, strict=True)]
        two = [[[math.exp(forth[k][i] + c[i][j] + (s[k + 1] if j else 0.0) + back[k + 1][j] - z) for j in (0, 1)] for i in (0, 1)] for k in range(len(s) - 1)]
        return one, two


def train(pages: list[tuple[str, list[bool]]], epochs: int = EPOCHS, step: float = STEP, shrink: float = SHRINK) -> Field:
    """pages: html and the label of each leaf block."""
    field = Field()
    seen = [(features(blocks(h)), [int(x) for x in labels]) for h, labels in pages]
    squares: dict[str, float] = {}
    chain_squares = [[1e-6] * 2 for _ in range(2)]
    for _ in range(epochs):
        for page, labels in seen:
            if not page:
                continue
            one, two = field.marginals(page)
            slope: dict[str, float] = {}
            for f, p, y in zip(page, one, labels, strict=True):
                for x in f:
                    slope[x] = slope.get(x, 0.0) + y - p
            for x, g in slope.items():
                w = field.weights.get(x, 0.0)
                g -= shrink * w
                squares[x] = squares.get(x, 1e-6) + g * g
                field.weights[x] = w + step * g / math.sqrt(squares[x])
            for i in (0, 1):
                for j in (0, 1):
                    g = sum((labels[k] == i and labels[k + 1] == j) - p[i][j] for k, p in enumerate(two))
                    chain_squares[i][j] += g * g
                    field.chain[i][j] += step * g / math.sqrt(chain_squares[i][j])
    return field


@lru_cache(maxsize=1)
def trained(pages: int = PAGES) -> Field:
    return train([labelled_page(seed) for seed in range(pages)])


def main_text(field: Field, page: str) -> str:
    own = blocks(page)
    return "\n\n".join(b.text for b, label in zip(own, field.decode(features(own, field.weights)), strict=True) if label == MAIN)


def extract(pages: DataFrame, field: Field, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """keep and the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(field)
    kinds = dict(pages.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(shared.value, x or "") for x in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return common.map_batches(pages.select(*keep, html), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(common.table(spark, sf_dir, "pages"), trained())
    return out.withColumn("n_chars", F.length("text").cast("long"))

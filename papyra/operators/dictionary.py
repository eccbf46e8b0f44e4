"""Many listed texts in many long ones, in one pass: an automaton over all listed texts at once.

The automaton is a table of next states, one row a state and one column a character that occurs in the list, and is
broadcast; its size is checked before it is built. Texts are read side by side, one character of each
at a time, as array operations; long ones are cut into stretches that overlap by the longest listed text.
Between word bounds a listed text stands only where all its words do, so a list is first joined to the words of the texts: what
no text can hold is in no automaton, and a list may be far larger than one. Beyond ``CELLS`` of the table what is left is taken in
blocks, each of which is one pass.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.session import shared_folder

#: Cells of a table of next states, at four bytes: 64 MB.
CELLS = 1 << 24
STRETCH = 1024
#: Characters that are read side by side.
BATCH = 1 << 22
#: Runs of what is_word() takes, and how many different ones a task holds before it passes them on.
WORD, WORDS = re.compile(r"\w+"), 1 << 18
#: A word is frequent in a list if it stands in more than so many of its texts, and in more than one of ``FREQUENT``: there are that many at most.
OFTEN, FREQUENT = 16, 10_000


def folded(text: str, fold: bool) -> str:
    """text in lower case, character by character, so that places stay what they are."""
    if not fold:
        return text
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def is_word(codes: np.ndarray) -> np.ndarray:
    """Whether each character is a letter, a digit or an underscore."""
    own, back = np.unique(codes, return_inverse=True)
    return np.array([(c := chr(x)) == "_" or c.isalnum() for x in own.tolist()], bool)[back] if len(own) else np.zeros(0, bool)


class Automaton:
    """Finds all places of all listed texts. ``fold``: whatever the case; ``bounded``: only between word bounds."""

    def __init__(self, items: list[str], fold: bool = True, bounded: bool = True) -> None:
        self.items, self.fold, self.bounded = items, fold, bounded
        words: dict[str, int] = {}
        for k, item in enumerate(items):
            if item:
                words.setdefault(folded(item, fold), k)
        letters = sorted({c for w in words for c in w})
        self.codes = np.array([ord(c) for c in letters], np.uint32)
        place = {c: k for k, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        self.item = [-1]
        self.longest = max(map(len, words), default=1)
        for word, k in words.items():
            at = 0
            for c in word:
                at = children[at].setdefault(place[c], len(children))
                if at == len(children):
                    children.append({})
                    self.item.append(-1)
            self.item[at] = k
        self._table(children, len(letters))
        self.item = np.array(self.item)
        self.length = np.array([len(i) for i in items] or [0])

    def _table(self, children: list[dict[int, int]], width: int) -> None:
        """Next states, and for each state the longest listed text that ends in it besides its own."""
        n = len(children)
        self.next = np.zeros((n, width + 1), np.int32)  # the last column is any other character
        self.shorter = np.zeros(n, np.int32)
        fail = np.zeros(n, np.int32)
        waiting = deque([0])
        while waiting:
            s = waiting.popleft()
            if s:
                self.next[s] = self.next[fail[s]]
                self.shorter[s] = fail[s] if self.item[fail[s]] >= 0 else self.shorter[fail[s]]
            for c, t in children[s].items():
                fail[t] = self.next[fail[s], c] if s else 0
                self.next[s, c] = t
                waiting.append(t)
        self.ends = np.array([k >= 0 for k in self.item]) | (self.shorter > 0)

    def find(self, texts: list[str | None]) -> pd.DataFrame:
        """(text, start, end, item), numbers all, of every place, by text, start and, longest first, end."""
        parts, at, size = [], 0, 0
        for k in range(len(texts) + 1):
            if k == len(texts) or size >= BATCH:
                parts.append(self._find(texts[at:k], at))
                at, size = k, 0
            if k < len(texts):
                size += len(texts[k] or "")
        found = pd.concat(parts, ignore_index=True)
        return found.iloc[np.lexsort((-found["end"], found["start"], found["text"]))].reset_index(drop=True)

    def _find(self, texts: list[str | None], base: int) -> pd.DataFrame:
        raw = [np.frombuffer(folded(t or "", self.fold).encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *raw])
        offset = np.cumsum(sizes) - sizes
        if not len(flat) or not len(self.codes):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "start", "end", "item")})
        near = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
        letters = np.where(self.codes[near] == flat, near, len(self.codes)).astype(np.int32)
        # stretches: what is theirs begins at ``own`` of a text, what is read before it by the longest text less one
        count = -(-sizes // STRETCH)
        of = np.repeat(np.arange(len(texts)), count)
        own = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
        begin = np.maximum(0, own - (self.longest - 1))
        length = np.minimum(sizes[of], own + STRETCH) - begin
        order = np.argsort(-length, kind="stable")
        of, own, begin, length = of[order], own[order], begin[order], length[order]
        first = offset[of] + begin
        state = np.zeros(len(of), np.int32)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = len(of)
        for t in range(int(length[0])):
            while live and length[live - 1] <= t:
                live -= 1
            state[:live] = self.next[state[:live], letters[first[:live] + t]]
            met = np.flatnonzero(self.ends[state[:live]])
            if len(met):
                met = met[begin[met] + t >= own[met]]
                hits.append((of[met], begin[met] + t + 1, state[met]))
        text, end, state = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in hits)]) for k in range(3))
        out = []
        while len(text):
            named = self.item[state] >= 0
            out.append((text[named], end[named], self.item[state[named]]))
            state = self.shorter[state]
            more = state > 0
            text, end, state = text[more], end[more], state[more]
        text, end, item = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]).astype(np.int64) for k in range(3))
        start = end - self.length[item]
        if self.bounded and len(text):
            word = np.append(is_word(flat), False)
            a, b = offset[text] + start, offset[text] + end
            before = (start > 0) & word[a - 1] & word[a]
            after = (end < sizes[text]) & word[b - 1] & word[b]
            keep = ~before & ~after
            text, start, end, item = text[keep], start[keep], end[keep], item[keep]
        return pd.DataFrame({"text": text + base, "start": start, "end": end, "item": item})


def apart(found: pd.DataFrame) -> pd.DataFrame:
    """Of find()'s places those that a reader replaces: from the left, the longest at a place, none that overlaps with one before."""
    keep, text, past = [], -1, 0
    for k, (t, a, b) in enumerate(zip(found["text"].tolist(), found["start"].tolist(), found["end"].tolist(), strict=True)):
        if t != text:
            text, past = t, 0
        if a >= past:
            keep.append(k)
            past = b
    return found.iloc[keep]


def present(docs: DataFrame, texts: list[str], items: DataFrame, item: str, fold: bool, bounded: bool) -> DataFrame:
    """(item): the distinct listed texts, without those of which a word is no word of any text; a join, so a list may have any size.

    A place between word bounds has whole words of the text only, so nothing that stands anywhere is left out. Of each listed text
    the longest word is joined that is not frequent in the list. Listed texts without a word stay, and so do all where bounds do not count.
    """
    own = items.select(F.col(item).alias("item")).filter(F.length(item) > 0).distinct()
    if bounded:

        def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pd.DataFrame({"word": [w for x in pdf["item"] for w in set(WORD.findall(folded(x, fold)))]}, dtype=object)

        counts = own.mapInPandas(each, "word string").groupBy("word").agg(F.count("*").alias("n"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        often = frozenset(r[0] for r in counts.filter(F.col("n") > max(OFTEN, total // FREQUENT)).select("word").collect())

        def longest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pdf.assign(word=[max(WORD.findall(folded(x, fold)), key=lambda w: (w not in often, len(w)), default=None) for x in pdf["item"]])

        def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            met: set[str] = set()
            for pdf in parts:
                for column in texts:
                    for text in pdf[column]:
                        if text:
                            met.update(WORD.findall(folded(text, fold)))
                        if len(met) >= WORDS:
                            yield pd.DataFrame({"word": list(met)})
                            met.clear()
            yield pd.DataFrame({"word": list(met)}, dtype=object)

        named = own.mapInPandas(longest, "item string, word string")
        held = docs.select(*texts).mapInPandas(words, "word string").distinct()
        own = named.join(held.hint("merge"), "word", "left_semi").select("item").unionByName(named.filter("word is null").select("item"))
    path = shared_folder(docs.sparkSession, "listed")
    own.write.parquet(path)
    return docs.sparkSession.read.schema("item string").parquet(path)


def needed(own: DataFrame, fold: bool, cells: int = 0) -> int:
    """How many blocks the listed texts (item) take."""
    total = own.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
    letters = own.select(F.explode(F.split(F.lower("item") if fold else F.col("item"), ""))).distinct().count()
    return max(1, -(-(total + 1) * (letters + 1) // (cells or CELLS)))


def block(own: DataFrame, blocks: int, k: int) -> DataFrame:
    return own.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)


def automata(own: DataFrame, blocks: int, fold: bool, bounded: bool) -> Iterator[tuple[int, Automaton]]:
    """The number and the automaton of each block of the listed texts (item); a block is what is collected, CELLS at most."""
    for k in range(blocks):
        rows = [r[0] for r in block(own, blocks, k).orderBy("item").collect()]
        if rows:
            yield k, Automaton(rows, fold, bounded)


def mentions(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, fold: bool = True, bounded: bool = True, cells: int = 0) -> DataFrame:
    """(key, item, n): how often each listed text stands in each text, overlapping places too. With ``fold`` items that differ in case only count as the first of them."""
    kinds, out = dict(docs.dtypes), None
    schema = f"`{key}` {kinds[key]}, item string, n long"
    own = present(docs, [text], items, item, fold, bounded)
    for _, automaton in automata(own, needed(own, fold, cells), fold, bounded):
        shared = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                found = shared.value.find(pdf[text].tolist())
                n = found.groupby(["text", "item"], sort=False).size()
                at = n.index.get_level_values(0), n.index.get_level_values(1)
                yield pd.DataFrame({key: pdf[key].to_numpy()[at[0]], "item": np.array(shared.value.items, dtype=object)[at[1]], "n": n.to_numpy()})

        part = docs.select(key, text).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def redact_listed(docs: DataFrame, items: DataFrame, texts: list[str], item: str = "item", label: str = "label", context: int = 40, cells: int = 0) -> DataFrame:
    """docs with listed items (item, label) in each of the columns ``texts`` as <LABEL>, and ``redactions`` (field, text, placeholder, context).

    Columns besides a document's text are its metadata (title, author, file name), masked by the same pass. Longest items go first, case
    is ignored, at word bounds. Where what the texts may hold takes more than one block, each block finds its places and a document's
    places meet before it is masked; with ``cells`` given, such a list is refused.
    """
    listed = items.groupBy(F.lower(item).alias("item")).agg(F.min(label).alias("label"))
    own = present(docs, texts, listed, "item", True, True)
    blocks = needed(own, True, cells)
    if cells and blocks > 1:
        raise ValueError("the list is larger than one automaton; split it or raise cells")
    spark, kinds, names = docs.sparkSession, dict(docs.dtypes), docs.columns
    labelled = own.join(listed, "item").select("item", "label")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", redactions array<struct<field: string, text: string, placeholder: string, context: string>>"

    def masked(pdf: pd.DataFrame, places: dict[str, Iterator[tuple[int, list[tuple[int, int, str]]]]]) -> pd.DataFrame:
        """A batch with its places, by column and row, as placeholders."""
        pdf = pdf.copy()
        log: list[list[dict]] = [[] for _ in range(len(pdf))]
        for column in texts:
            values = pdf[column].tolist()
            new = list(values)
            for at, found in places[column]:
                value, out, past = values[at], [], 0
                for a, b, mark in found:
                    out += [value[past:a], mark]
                    past = b
                    log[at].append({"field": column, "text": value[a:b], "placeholder": mark, "context": value[max(0, a - context) : b + context]})
                new[at] = "".join([*out, value[past:]])
            pdf[column] = pd.Series(new, index=pdf.index, dtype=object)
        pdf["redactions"] = pd.Series(log, index=pdf.index, dtype=object)
        return pdf

    built = ((a, [f"<{labels[i]}>" for i in a.items]) for k, a in automata(own, blocks, True, True) for labels in (dict(block(labelled, blocks, k).collect()),))
    if blocks == 1:
        one = next(built, None)
        if one is None:
            return docs.withColumn("redactions", F.from_json(F.lit("[]"), schema.rsplit("redactions ", 1)[1]))
        shared = spark.sparkContext.broadcast(one)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton, marks = shared.value
            for pdf in parts:
                by = {c: apart(automaton.find(pdf[c].tolist())).groupby("text") for c in texts}
                yield masked(pdf, {c: ((at, [(a, b, marks[k]) for a, b, k in zip(x["start"].tolist(), x["end"].tolist(), x["item"].tolist(), strict=True)]) for at, x in g) for c, g in by.items()})

        return docs.mapInPandas(run, schema)

    path = shared_folder(spark, "redacted")
    docs.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    found = None
    for one in built:
        shared = spark.sparkContext.broadcast(one)

        def find(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton, marks = shared.value
            for pdf in parts:
                for c in texts:
                    x = automaton.find(pdf[c].tolist())
                    yield pd.DataFrame({"__id": pdf["__id"].to_numpy()[x["text"]], "field": c, "start": x["start"], "end": x["end"], "mark": np.array(marks, dtype=object)[x["item"]]})

        part = kept.select("__id", *texts).mapInPandas(find, "__id long, field string, start long, end long, mark string")
        found = part if found is None else found.unionByName(part)
    met = found.groupBy("__id").agg(F.collect_list(F.struct("field", "start", "end", "mark")).alias("__places"))

    def together(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(x["field"], at, x["start"], x["end"], x["mark"]) for at, own in enumerate(pdf["__places"]) if own is not None for x in own]
            rows.sort(key=lambda x: (x[0], x[1], x[2], -x[3]))
            by = {}
            for c in texts:
                x = apart(pd.DataFrame([r[1:] for r in rows if r[0] == c], columns=["text", "start", "end", "mark"]))
                by[c] = ((at, list(zip(g["start"].tolist(), g["end"].tolist(), g["mark"].tolist(), strict=True))) for at, g in x.groupby("text"))
            yield masked(pdf[names], by)

    return kept.join(met.hint("merge"), "__id", "left").mapInPandas(together, schema)

"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every labelled text of the training part, per language, in the
Python workers and adds the counts up in Spark. The log-probability matrix has one row for each
language and ``len(ORDERS) * BUCKETS`` columns, whatever the corpus, and is broadcast: 0.8 MB a
language in float32. Texts are scored in batches: for each language the matrix row is gathered at all
n-gram buckets of a batch and added up between document bounds.

Texts are lower-cased and scored whole. A null text, and one without a letter, is ``und`` with score
0, as is every text where nothing was learned (an empty table, or no labelled row). Rows with a null
label, or a null key, teach nothing. Ties go to the language that sorts first. Repeated rows count as
often as they stand; columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import common

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
UND = "und"
#: Characters of a batch that are hashed at a time.
SLICE_BYTES = 1 << 20


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram at every place of the joined texts; where each text starts.

    Each text is followed by spaces; the places among them whose n-gram would reach into the next text have
    one and the same bucket, so a text's n-grams do not hang on its neighbours.
    """
    pad = " " * max(ORDERS)
    joined = "".join(t.lower() + pad for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(t.lower()) + len(pad) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    out, h = [], np.zeros(len(codes), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            h = h[:-1]
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1 :] + np.uint64(1)
        if order in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS + ORDERS.index(order) * BUCKETS
            bucket = np.append(bucket, np.zeros(order - 1, np.int64))
            bucket[(ends[:, None] - 1 - np.arange(order - 1)[None, :]).reshape(-1)] = ORDERS.index(order) * BUCKETS
            out.append(bucket)
    return out, ends - lengths


def count(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """(lang, bucket, n): n-gram counts of each language over all rows; bucket -1 counts the rows."""
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string"), text)
    schema = "lang string, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.slices(batch, SLICE_BYTES):
                of: dict[str, list[str]] = {}
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    of.setdefault(lang, []).append(t)
                for lang, texts in of.items():
                    own = counts.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS + 1, np.int64))
                    for bucket in grams(texts)[0]:
                        own[:-1] += np.bincount(bucket, minlength=len(own) - 1)
                    own[-1] += len(texts)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            bucket = np.where(at == len(own) - 1, -1, at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(bucket), pa.array(own[at])], schema=common.arrow_schema(schema))

    return common.map_stream(labelled, run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


#: Most labels of a model; at 0.8 MB each that bounds what is broadcast, and what a worker counts.
MOST_LABELS = 200


def train(docs: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the log-probability matrix; its size follows the number of languages alone."""
    if docs.select(label).filter(F.col(label).isNotNull()).distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages, each of which takes 0.8 MB of the model that is broadcast")
    rows = count(docs, text, label).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), len(ORDERS) * BUCKETS + 1))
    if names:
        of = np.array([place[x] for x in rows.column("lang").to_pylist()])
        counts[of, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    grams_, rows_ = counts[:, :-1].reshape(len(names), len(ORDERS), BUCKETS), counts[:, -1]
    logs = np.log(grams_ + smoothing) - np.log(grams_.sum(axis=2, keepdims=True) + smoothing * BUCKETS)
    return names, np.log(rows_ / max(1.0, rows_.sum())), logs.reshape(len(names), len(ORDERS) * BUCKETS).astype(np.float32)


def score(texts: list[str], prior: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Posterior probabilities, one row a text."""
    buckets, starts = grams(texts)
    total = np.tile(prior, (len(texts), 1))
    for bucket in buckets:
        for lang in range(len(prior)):
            total[:, lang] += np.add.reduceat(logs[lang][bucket], starts, dtype=np.float64)
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], text: str = "text", added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep, with the language and its score under the names added, for every row; only the text is looked at."""
    names, prior, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((prior, logs))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{added[0]}` string, `{added[1]}` double"
    own_text = [] if text in keep else [F.col(text).alias("__text")]
    at = keep.index(text) if text in keep else len(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(at).to_pylist()]
        own = [i for i, t in enumerate(texts) if names and any(map(str.isalpha, t))]
        lang, p = [UND] * len(texts), [0.0] * len(texts)
        if own:
            scored = score([texts[i] for i in own], *shared.value)
            for i, row, best in zip(own, scored, scored.argmax(axis=1).tolist(), strict=True):
                lang[i], p[i] = names[best], float(row[best])
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(lang), pa.array(p)], names=[*keep, *added])

    return common.map_batches(docs.select(*keep, *own_text), run, schema, SLICE_BYTES)


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """From the documents that are not held out."""
    return train(docs.filter(~held_out()))


def accept(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is recognised with probability ``least``; all their columns stay as they are."""
    lang, score_ = common.fresh(docs, "__lang", "__score")
    kept = predict(docs, learn(docs), docs.columns, added=(lang, score_))
    return kept.filter((F.col(lang) != UND) & (F.col(score_) >= least)).select(*docs.columns)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

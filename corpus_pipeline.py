"""Documents to training tokens: language ID, near-dedup, repeated passages, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return
the columns of documents; the last returns each kept document's token ids, the text they decode to and
their number.

Odd input. A null, empty or letterless text goes in the first stage, as its language is none. A null key
never names a group of near copies; such rows stay unless they hold a benchmark item, and rows that
share a key are one document: they are kept, or go, together in near_dedup (those of a smallest key
stay) and decontamination, and do not cut each other's text at equal places. Of ties, equal texts among
them, the smallest doc_id stays. Long texts are taken whole. An empty table gives an empty one. Columns
besides doc_id and text are passed on as they are, whatever their names, by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import byte_bpe, common, decontaminate, language, similar, suffix_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without a letter, or of an uncertain language, go."""
    return language.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash links and of five-word shingle similarity 0.8, that with the smallest doc_id."""
    return similar.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that stand earlier in the corpus."""
    return suffix_dedup.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit) and the text that they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.encode(docs, ranks, pattern, decoded=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"), F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passages", passages),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: Suffix arrays, SimHash and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again, the last but one is then dropped."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs

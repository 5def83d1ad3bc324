"""A corpus pipeline of five stages: toxicity, quality, near-duplicates, decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of `documents`, so that the result
can be written and read again as the next one's docs; the last returns the pieces of the packed sequences. Rows are judged
each by its own text, whatever their doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkstrata.llm import decontaminate, minhash_dedup, packing, quality, toxicity
from inkstrata.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity operator predicts toxic go, in the pass that scores them."""
    return toxicity.keep_clean(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier predicts poor go, in the pass that scores them."""
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8 or more) stays: that with the least doc_id."""
    return minhash_dedup.keep_one(docs, percent=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage, thirteen words or a whole shorter item, go, however long the text is."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), size=13)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Classifiers and packing are not expressible in SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

"""The corpus pipeline: five stages over documents, each on all that the one before has kept.

Every stage but the last returns the columns of documents; the last returns the pieces of packed sequences. Null
and empty texts, null ids and repeated rows have the results that the operators' docstrings state; a stage over no
rows returns none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gondola.llm import langid, packing, pii, simhash, toxicity
from gondola.llm.common import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a factorization machine, fitted on the labels of those at hand, finds toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letters, or that no language model of the corpus explains."""
    return langid.drop_foreign(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each component of texts with a similarity of 0.8 or more in five-word shingles."""
    return simhash.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind in brackets, and n_chars counted anew."""
    return pii.mask_pii(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), seq_len=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("language id", drop_foreign),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Fitted models, XXH64 and the vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; each stage's result is written once, to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

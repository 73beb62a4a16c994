"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing over the documents of a folder.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
documents, extra ones included, whatever their names; the last one returns a row a piece of a packed sequence.

In every stage: a null text is empty; empty and very long texts, and rows with null doc_id, are rows like others (an empty
text isn't toxic, is equal to other empty ones, is like nothing, is taken by no mix as it has no words). Repeated rows: both
may be toxic, one of them stays after exact dedup. Ties go to the smallest doc_id, null after all others. An empty table
gives an empty table; without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medlark.llm import exact_dedup, mixing, order_minhash, packing, tokens, toxicity
from medlark.llm.common import read_table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled rows among them, predicts to be toxic go."""
    return toxicity.clean_documents(spark, docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays."""
    return exact_dedup.kept_documents(spark, docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document of smallest doc_id stays."""
    return order_minhash.kept_documents(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.copies(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences."""
    return packing.pack(spark, docs, tokens.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the learnt model, nor alignment, nor random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of documents. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relgraph.llm import mixing, packing, quality, simhash
from relgraph.llm.common import materialise, table

#: Shares of expected tokens that the corpus shall have. Every document that looks clean stays whole (the anchor), so toxic ones are
#: what gives way; the classifier stage has removed junk, of which no share is asked.
TARGETS = {"clean": 0.985, "toxic": 0.015}
ANCHOR = "clean"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier does not reject. A null text is judged as an empty one; nulls in other columns,
    repeated rows and columns of any name pass through; no documents, no rows; no labels, nothing is rejected."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of equal or near-duplicate texts.

    Null texts are empty and equal to one another; a null doc_id stays only if its group has no other; ties and repeats leave one
    row; columns of any name keep their values; no documents, no rows."""
    return simhash.drop_near_duplicates(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their fitted rates, at most once each. Null and empty texts have no tokens, and rates like any other;
    repeated rows are drawn alike; columns of any name keep their values; no documents, no rows."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), targets=TARGETS, anchor=ANCHOR, most=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a training sequence. A null or empty text is one piece, its end; repeated
    rows are packed as often as they stand; other columns than doc_id and text are not read; no documents, no rows."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix_to_targets),
    ("best-fit packing", pack_sequences),
]

#: No stage is expressible in SQL (a fitted classifier, MinHash, a fitted mixture, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs

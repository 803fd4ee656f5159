"""A corpus from documents: good ones, each text once, one of each near-duplicate class, packed.

Every stage takes null, empty and very long texts, repeated rows and columns of any
name: null is the empty text, repeated rows are rows, and only the columns doc_id and
text are looked at. An empty table goes through to an empty result. A null identifier
is judged by its text, never wins over others among copies, and is no near copy.

Counts as part of the subpackage ``marketspark.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketspark.llm import exact_dedup, minhash, packing, quality
from marketspark.llm.common import materialise
from marketspark.llm.queries import table, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z), the document with the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id."""
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row per piece of a document."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("packing", pack)]

#: A fitted model, near-duplicate classes and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over ``documents``: quality rules, near-duplicates, repeated passages, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.llm import mixing, packing, quality, simhash, substring
from mercato.llm.common import materialize, table
from mercato.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    return simhash.first_of_each(docs, shingle_words=3, max_bits=3).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the second and later occurrences of a passage."""
    return substring.cut_repeats(docs, threshold=0.8, shingle_words=5, min_words=20).select(*COLUMNS)


#: Toxic documents go.  The target of ``low`` is far above its share, so that with ``max_rate`` 1 all other documents stay once.
MIX = mixing.Mix(weights={"high": 0.60, "low": 0.40, "toxic": 0.0}, anchor="high", max_rate=1.0)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the label domains to their target weights."""
    labels = mixing.domains_of(table(spark, sf_dir, "labels"))
    return mixing.sampled(docs, labels, MIX).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_to_targets", mix_to_targets),
    ("pack", pack),
]

#: Encoding, near-duplicate components and fitted rates have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

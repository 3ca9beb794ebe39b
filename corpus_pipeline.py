"""The corpus pipeline: from raw documents to packed training sequences.

Stages, each over everything that the one before it kept:

1. ``language_id``: documents whose language cannot be told go;
2. ``near_duplicates``: of each group (five-word shingles, Jaccard 0.8 or more,
   links followed through) the document with the smallest id stays;
3. ``repeated_passages``: every 200-byte string that also stands elsewhere is
   cut out of the texts (a document may end up empty, it stays a document);
4. ``packing``: what is left, tokenized, in sequences of at most 4096 tokens.

All but the last return the columns of ``documents``.  An empty table gives an
empty result.  SQL cannot express the fitted classifier or the tokenizer; the
stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from raresift.llm.common import materialize, read
from raresift.llm.jaccard import keep_one
from raresift.llm.langid import keep_identified
from raresift.llm.packing import pack_documents
from raresift.llm.suffix import remove_repeats

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identifiable language."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, materialised in between."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to packed training sequences, in four stages.

Each stage is written as Parquet to the session's shared folder and read again, so a lost
executor never costs more than the stage at hand.

All stages: an empty table gives an empty one; further columns pass through, whatever their
names (but packing returns columns of its own); very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import packing, quality, shingles, substrings
from inkveil.llm.common import scratch, staged, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 10).

    Null texts count as empty and are judged like any text; repeated rows share their fate.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    SimHash fingerprints, and minimum hashes for what is too far apart for these, give the pairs to verify.

    The one with the smallest doc_id stays, of repeated rows one.  Null texts, empty ones and
    those of white space alone are equal.  Rows without a doc_id go if a row with one is alike.
    """
    return shingles.keep_first(docs)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller doc_id has (operator 4).

    Texts without such a passage, null and empty ones included, stay as they are; a document
    of which nothing is left goes.  Equal doc_ids are not earlier than each other.
    """
    return substrings.keep_first_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences (operator 9): a null or empty text is its end token alone; each repeated row has its place."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", unlike),
    ("substring dedup", first_passages),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):  # holds what stages leave to each other; the inner one what a stage stages itself
        for name, stage in STAGES:
            with scratch(spark):
                out = stage(spark, docs, sf_dir)
                docs = staged(out, name.lower().replace(" ", "-"), lasting=1 + (stage is packed))
    return docs

"""A training-corpus pipeline: each stage works on all that the one before it kept.

All stages return whole rows with all columns of their input, whatever those are named, but
for the last. A NULL text is an empty one. Rows without an id or with a repeated one are
rows like others: the stages number rows themselves. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditgrain.llm.byte_bpe import bpe_round_trip
from creditgrain.llm.common import table
from creditgrain.llm.decontamination import clean
from creditgrain.llm.exact_dedup import one_of_each_text
from creditgrain.llm.pairwise_quality import accepted
from creditgrain.llm.parity_join import one_of_each
from creditgrain.session import discard, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts, by their scores alone: equal texts go or stay together.

    Without labels of both kinds nothing can be learned and all documents stay.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id (NULL is the smallest; of one id the last as stored).

    Empty texts are equal to one another.
    """
    return one_of_each_text(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the row with the smallest id (NULL last; then as stored).

    Texts without words are similar to nothing and stay.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Items without an id count, items without words don't."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_round_trip(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("byte_bpe", tokens),
]
#: The first stage is a fitted classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs

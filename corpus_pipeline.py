"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; run()
writes every result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dealforge.llm import mixing, neardup, packing, pii, quality
from dealforge.llm.common import delete, read_table, scratch_space, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, unchanged.

    Null and empty texts have too few words and go; null languages are compared with
    one another; equal rows share a verdict; an empty table stays empty; long texts
    are judged whole; further columns pass through under any names.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, 80 %), unchanged: that of the least id.

    A null id counts as larger than others; of rows with one id and text one stays;
    texts without words are alone; an empty table stays empty.
    """
    return neardup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with sanitised texts and their n_chars.

    Null texts stay null, texts without personal data or disclosing terms unchanged;
    equal rows stay equal; an empty table stays empty.
    """
    return pii.mask_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, at most three times.

    A null source is a source; blank texts are not taken; rows without an id are
    taken by their text; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 4096 tokens.

    A null text is empty and has its end token alone; repeated documents are packed
    as often as they come; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: The stages hash words and tokenize, which SQL cannot express; tests/llm compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself, and its input, is deleted when its result is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch_space(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs

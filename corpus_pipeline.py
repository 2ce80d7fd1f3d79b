"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import decontaminate, packing, quality, similar, suffix_dedup
from tallygrid.llm.common import drop_folder, shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, found by SimHash ball hashing and checked: five-word shingle sets at
    least 0.8 similar."""
    return similar.without_similar(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand earlier."""
    return suffix_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their bins."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: Quality scores, fingerprints and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again; what a stage has read goes once it is done.

    A null text counts as an empty one, and is an empty one from the repeats on. Texts without words are scored like
    others and are copies of each other in near_duplicates. Of equal doc_ids with different texts each stays on its
    own; rows that repeat doc_id and text stay or go together, and a null doc_id is a value like others but comes first.
    Ties are broken by doc_id, then by a hash of doc_id and text. Other columns of documents go along until packing,
    whatever their names. Empty tables give an empty result with the same columns; without labels nothing is rejected.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            drop_folder(spark, before)
        before = at
    return docs

"""A training corpus from ``documents``: identified languages, no near-duplicates, no repeated passages, mixed, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.llm import bpe, langid, mixing, simhash, suffix
from pathlight.llm.common import id_remainder
from pathlight.llm.queries import tokenizer
from pathlight.plans.lineage import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; learned from the labels of four fifths of ``docs``.

    Null texts, and texts without a letter, are not identified and go. Cases as in ``langid.keep_identified``.
    """
    contents = langid.learn(docs.where(id_remainder(F.col("doc_id"), 5) != 0))
    return langid.keep_identified(docs, contents)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by SimHash and similarity 0.8 of five-word shingles.

    Of equal texts the smallest id stays, a null id only if there is no other; cases as in ``simhash.keep_one``.
    """
    return simhash.keep_one(docs, shingle=5, similarity=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without the 200-byte strings that repeat.

    Every row stays, null texts as they are and texts of which nothing is left empty; as in ``suffix.remove_repeats``.
    """
    return suffix.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without a word are taken never. Cases as in ``mixing.apply_mix``."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with their number and digests: the last stage. Cases as in ``bpe.digests``."""
    return bpe.digests(docs, *tokenizer(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: Compression, suffix refinement, hash sampling and BPE have no SQL. Tests hold the operators against plain versions one by
#: one and the run against its stages applied in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

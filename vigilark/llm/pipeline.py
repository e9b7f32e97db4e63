"""The stages of the corpus pipeline: quality rules, language ID, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the
shared folder and reads them again as the next stage's docs. All but the last return the columns of docs, whatever
else they hold; the last adds what the mix takes of each document (size, source_size, target, taken, epochs, which
replace columns of these names) and drops those of which it takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, quality, simhash, similar
from .common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, trained on labelled documents of its own input, rejects go."""
    return langid.keep(docs, langid.learnt(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the byte-position index of SimHash, and MinHash bands beyond its reach, propose, five-word similarity of 0.8 or more decides."""
    return simhash.keep_one(docs, similar.similar)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken of each."""
    return mixing.mix_sources(docs).where(F.col("taken") > 0)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: The near-duplicate and language stages need hashes and a trained model, which SQL has no counterpart of.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

"""Corpus pipeline: the stages applied in order to `documents`, each one written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import decontam, langid, packing, simhash, substring
from voxelloom.llm.queries import table
from voxelloom.llm.setup import ready, stored


#: Fixed value. Held-out halves: 2 of 4,817 documents of sf0.1 and 2 of 480 of sf0.01 score less; letter noise and nine unlearned
#: languages reach 0.43 with the model of sf0.01 and 0.53 with that of sf0.001.
MIN_SCORE = 0.54


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told with a score of MIN_SCORE or more; the model learns from the labelled ones among them."""
    ready(spark)
    return langid.clean(docs, langid.fit(docs), min_score=MIN_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-copies: three-word SimHash fingerprints within three bits, by chains."""
    ready(spark)
    return simhash.clean(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that an earlier document holds too; n_chars follows."""
    ready(spark)
    return substring.clean(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by `benchmark`, unchanged."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words for what is left."""
    ready(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_text", repeated_text),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: A learned language model and the packing of bins have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

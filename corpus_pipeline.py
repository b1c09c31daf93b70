"""The training-data pipeline: five stages over the documents table, each by one operator.

Each stage takes all rows that its predecessor kept and returns the columns of ``documents``; the
last returns packed pieces. SQL cannot express the packing, so ``ORACLE_SQL`` is None and the tests
hold every stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from canopyframe.llm.queries import TOKENIZER
from canopyframe.session import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality_rules.accepted(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least five share."""
    out = line_dedup.drop_shared_lines(docs, min_docs=5, min_chars=40)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs, k=3, percent=90)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to even out their sources."""
    return mixing.replicate(docs, mixing.temperature_rates(docs, exponent=0.7))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048."""
    return packing.pack(docs, TOKENIZER, size=2048)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", one_per_group),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written to the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

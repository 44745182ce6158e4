"""A corpus from raw documents to packed sequences of tokens, in five stages.

Each stage takes and gives a table of documents, the last one gives pieces placed in sequences. A
NULL in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns
are handled as the operators say: documents without text are dropped by the first stage, as no
language can be told; columns that the table has beyond those used are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.exact_dedup import exact_dedup
from emberlog.llm.jaccard_join import one_of_each
from emberlog.llm.language_id import keep_identified
from emberlog.llm.mixing import mix
from emberlog.llm.packing import pack
from emberlog.llm.support import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence."""
    return keep_identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; A-Z count as a-z."""
    return exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return one_of_each(docs, size=5, num=8, den=10)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one of a scarce source may come once for each epoch."""
    return mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: Language models and packing are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on what its predecessor has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)

"""The corpus pipeline: documents in, cleaned and encoded documents out.

Every stage takes all that its predecessor kept.  ``run`` writes each stage's result in
the shared checkpoint folder and reads it again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import decontaminate, exact_dedup, line_quality, simhash
from loam.llm.common import held_out, saved
from loam.llm.queries import bpe_digests
from loam.sources.readers import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below its threshold go.

    It learns from the same three of four folds of labels as the registered query.
    """
    labels = read_table(spark, sf_dir, "labels")
    model = line_quality.fit(docs, labels.where(~held_out("doc_id", 4)))
    return docs.where(line_quality.score(model, F.col("text")) >= line_quality.THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item contaminates go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), any_case=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of the ids and of the bytes decoded from them."""
    return bpe_digests(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near dedup", near),
          ("benchmark decontamination", benchmark_free), ("byte bpe", encoded)]

# The fitted classifier, SimHash and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

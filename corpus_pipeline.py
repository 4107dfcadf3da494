"""The corpus pipeline: documents go in, packed documents come out.

Each stage reads all rows that its predecessor kept and returns the columns of ``documents``; the last one returns the packing.
``run`` writes every stage as Parquet below ``spark.checkpoint.dir`` and reads it again, so that a lost executor costs one stage.

1. quality: rows that the compression classifier, learned from ``labels``, predicts bad go.
2. language: rows without a language, or with none that stands out, go.
3. near duplicates: the row with the smallest doc_id of each class stays.
4. decontamination: rows that hold a ``benchmark`` item go.
5. packing: every row gets its length bucket, batch and place.

Null and empty texts do not pass the first stage.  Rows that share a doc_id are judged each by their own text.  An empty table
passes all stages as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontaminate, langid, minhash, packing, quality
from tracemill.llm.common import Run


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learn(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn(docs))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_benchmark_items),
    ("packing", packed),
]

ORACLE_SQL = None  # the trained stages have no SQL counterpart; tests hold every stage against plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    written = Run(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written.land(stage(spark, docs, sf_dir), name)
    return docs

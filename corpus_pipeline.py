"""Corpus pipeline: toxic and low-quality documents go, one document of each
group of near copies stays, documents that hold a benchmark passage go, and
what remains is packed into sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept and returns rows with the columns of ``documents``; the last
one returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexiscope.llm import decontam, jaccard, packing, quality, toxicity
from lexiscope.llm.common import read
from lexiscope.llm.queries import QUALITY_KEPT, TOXIC_FROM, learnt_from, tokenizer_path
from lexiscope.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, learnt_from(read(spark, sf_dir, "labels"), 3, 1))
    return toxicity.score(docs, model, out="_toxicity").where(f"_toxicity < {TOXIC_FROM}").drop("_toxicity")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, learnt_from(read(spark, sf_dir, "labels"), 5, 0))
    return quality.score(docs, model, out="_quality").where(f"_quality >= {QUALITY_KEPT}").drop("_quality")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near copies", one_of_each),
          ("decontamination", without_benchmark), ("packing", packed)]

# models, tokenizer and similarity search are beyond SQL; tests compare the
# stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's rows are written to the shared checkpoint
    folder and read back as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

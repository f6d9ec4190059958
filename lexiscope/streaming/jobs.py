"""Streaming jobs over a folder of JSON-lines files.

* ``score_stream``: texts ``(id, text)`` -> answers ``(id, label)`` with a
  fitted feature pipeline and classifier; stateless, append mode.
* ``running_metrics``: answers joined to a static truth table, running
  conditional counts per (facet, value) - a streaming aggregate in complete
  mode - and the metrics that are sums (c@1, F1, F0.5u, Brier, confusion).
  AUC needs the full score order and is left to the batch job; ids with no
  answer yet are simply not counted (the batch job scores them as 0.5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators import metrics as M


def text_stream(spark: SparkSession, folder: str, schema: str = "id STRING, text STRING",
                max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def answer_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return (spark.readStream.schema("id STRING, label DOUBLE").option("maxFilesPerTrigger", max_files)
            .json(folder))


def score_stream(texts: DataFrame, feats, clf, out_dir: str, checkpoint: str, once: bool = True):
    """Each micro-batch is scored as a batch job is (its terms meet the whole
    vocabulary in a join) and written to a folder of its own, which a repeated
    batch overwrites."""
    from lexiscope.operators.models import score

    def answer(batch: DataFrame, number: int) -> None:
        score(feats, clf, batch).write.mode("overwrite").json(f"{out_dir}/batch={number}")

    q = texts.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if once else q.trigger(processingTime="30 seconds")
    return q.start()


def running_metrics(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Streaming DataFrame of running metrics per (facet, value)."""
    t = truth.select(F.col("id").cast("string").alias("id"), F.col("label").cast("double").alias("t"),
                     *[c for c in truth.columns if c in M.FACETS])
    j = answers.select(F.col("id").cast("string").alias("id"), F.col("label").alias("p")).join(t, "id")
    counts = M.binary_counts(M.with_facets(j.drop("id")), ["facet", "value"])
    return counts.selectExpr("facet", "value", "n", *M._METRICS, *M.CONFUSION_COLUMNS)


def start_running_metrics(answers: DataFrame, truth: DataFrame, query_name: str, checkpoint: str,
                          once: bool = True):
    """Complete-mode memory sink (small: one row per facet value)."""
    q = (running_metrics(answers, truth).writeStream.outputMode("complete").format("memory")
         .queryName(query_name).option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if once else q.trigger(processingTime="30 seconds")
    return q.start()

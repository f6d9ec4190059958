"""What the two hashed linear classifiers share: the bounded labelled sample
they are fitted on and the scoring pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import sample_by_hash, small_batches


def labelled_features(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, per_class: int,
                      features: Callable[[str | None], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(label, distinct feature indices) of documents with a label: about
    ``per_class`` rows of each label, chosen from the labels by a hash of
    ``key``. Labels other than 0 and 1 and null keys are not learnt from. The
    sample is bounded, so it is broadcast to the documents instead of moving
    their texts, and is all that reaches the driver; the order is by hash, so
    that training does not depend on the partitioning."""
    small_batches(docs.sparkSession)
    clean = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(
        "y in (0, 1) and k is not null")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["x"] = [np.unique(features(t)).astype(np.int32).tobytes() for t in b.t]
            yield b[["h", "y", "x"]]

    sample = F.broadcast(sample_by_hash(clean, "k", per_class, "y"))
    got = (docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(sample, "k")
           .withColumn("h", F.xxhash64(F.col("k"), F.lit(5)))
           .mapInPandas(extract, "h long, y int, x binary").toPandas())
    got = got.sort_values(["h", "y", "x"], kind="stable")
    return [(int(y), np.frombuffer(x, np.int32)) for y, x in zip(got.y, got.x)]


def scored(df: DataFrame, text: str, score: Callable[[str | None], float],
           out: str = "score") -> DataFrame:
    """``df`` with one more column ``out``. A column of that name that is
    already there is replaced. Texts are scored whole, batch by batch."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    small_batches(df.sparkSession)
    base = df.drop(out) if out in df.columns else df
    schema = StructType([*base.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = np.array([score(t) for t in b[text]], float)
            yield b

    return base.mapInPandas(run, schema)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))

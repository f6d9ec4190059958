"""Access to the driver's parquet tables.

Only a path join: every caller selects the columns it needs right after the
read, so Catalyst prunes the parquet scan (``ReadSchema``) and pushes filters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan of a driver table."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows over all cores when the scan yields fewer partitions than
    the cluster has (one big row group → one task). On a cluster reading many
    files the scan is already wide and nothing is added. Round-robin (Spark
    sorts before it, so a retried task sees the same rows); no hash
    partitioning is claimed, so later joins plan their own exchanges."""
    sc = df.sparkSession.sparkContext
    want = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)

"""Dictionary lookups of the reference as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def facet_ids(df: DataFrame, col: str, unknown: str = "unknown") -> DataFrame:
    """Sorted distinct values of ``col`` numbered 0..n-1 plus ``unknown`` = n
    (one entry for ``unknown``, also where the data hold that value).
    The numbering window runs over the distinct values only (a facet's
    vocabulary), after a shuffle-side distinct."""
    d = df.select(F.col(col).alias("value")).where(F.col("value") != unknown).distinct()
    ids = d.withColumn("fid", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))
    n = ids.agg(F.count(F.lit(1)).cast("int").alias("fid")).select(F.lit(unknown).alias("value"), "fid")
    return ids.unionByName(n)


def encode_facet(df: DataFrame, ids: DataFrame, col: str, out: str = "fid",
                 unknown: str = "unknown") -> DataFrame:
    """Look values up; unseen ones get the id of ``unknown``."""
    unk = ids.where(F.col("value") == unknown).select(F.col("fid").alias("_unk"))
    j = df.join(ids.withColumnRenamed("fid", "_fid"), df[col] == ids["value"], "left").drop("value")
    j = j.crossJoin(F.broadcast(unk))  # one row
    return j.withColumn(out, F.coalesce(F.col("_fid"), F.col("_unk"))).drop("_fid", "_unk")

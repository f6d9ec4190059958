"""Descriptive aggregations. Each statistic is one grouped
aggregate over one scan; several columns are unpivoted with ``stack`` so
they share the scan instead of re-reading the frame per statistic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.operators.sampling import hash_key


def profile(df: DataFrame, by: str = "split") -> DataFrame:
    """Per ``by`` value: rows, and per column its non-null count and type
    -> ``(split, column, dtype, non_null, rows)``."""
    cols = [c for c in df.columns if c != by]
    agg = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"),
                             *[F.count(F.col(c)).alias(f"nn_{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    args = ", ".join(f"'{c}', '{types[c]}', nn_{i}" for i, c in enumerate(cols))
    return agg.selectExpr(by, "rows", f"stack({len(cols)}, {args}) AS (col_name, dtype, non_null)")


def value_counts(df: DataFrame, cols: list[str], by: str = "split") -> DataFrame:
    """``(split, column, value, n)`` for every listed column in one pass."""
    args = ", ".join(f"'{c}', CAST({c} AS STRING)" for c in cols)
    long = df.selectExpr(by, f"stack({len(cols)}, {args}) AS (col_name, value)")
    return long.groupBy(by, "col_name", "value").agg(F.count(F.lit(1)).alias("n"))


def value_shares(df: DataFrame, cols: list[str], by: str = "split") -> DataFrame:
    """D3: D2 as fractions of the rows of the split. The window runs on the
    aggregated counts (values per column), not on the rows."""
    c = value_counts(df, cols, by)
    w = Window.partitionBy(by, "col_name")
    return c.withColumn("share", F.col("n") / F.sum("n").over(w))


def counts_within(df: DataFrame, outer: str, inner: str, by: str = "split") -> DataFrame:
    """Counts of ``inner`` values within each ``outer`` value."""
    return df.groupBy(by, outer, inner).agg(F.count(F.lit(1)).alias("n"))


def label_by_split(df: DataFrame, label: str = "label", by: str = "split", values=(0, 1)) -> DataFrame:
    """rows = split, one column per label value (values listed, so the
    pivot needs no extra pass to find them)."""
    p = df.groupBy(by).pivot(label, list(values)).count()
    return p.select(by, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(f"label_{v}") for v in values])


def length_stats(df: DataFrame, col: str = "word_len", by: list[str] = ("split",)) -> DataFrame:
    """Min, max and the integer part of the mean of ``col`` per group."""
    return df.groupBy(*by).agg(F.min(col).alias("min_len"), F.max(col).alias("max_len"),
                               F.floor(F.avg(col)).cast("long").alias("mean_len"))


def length_stats_by_class(df: DataFrame, col: str = "word_len", by: str = "split",
                          cls: str = "label") -> DataFrame:
    """D7 for every split and for every (split, class) in one pass
    (grouping sets via rollup, grand total dropped)."""
    r = df.rollup(by, cls).agg(F.min(col).alias("min_len"), F.max(col).alias("max_len"),
                               F.floor(F.avg(col)).cast("long").alias("mean_len"),
                               F.grouping(by).alias("_g"))
    return r.where(F.col("_g") == 0).drop("_g")


def sample_document(df: DataFrame, cls: str = "label", id_col: str = "id", seed=42) -> DataFrame:
    """One record per class - the one first in hash order (an aggregate,
    no sort)."""
    h = hash_key(id_col, seed)
    return df.groupBy(cls).agg(F.min_by(F.col(id_col), F.struct(h, F.col(id_col))).alias(id_col))


def pred_label_counts(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """Counts of predicted and of true labels -> ``(kind, label, n)``."""
    long = df.selectExpr(f"stack(2, 'pred', CAST({pred} AS INT), 'true', CAST({truth} AS INT)) AS (kind, label)")
    return long.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))

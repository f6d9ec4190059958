"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights, a component being a term. The
rows that are searched lie in blocks of at most BLOCK rows; a block keeps, per
term, the postings of the rows that hold it (the whole column where more than
a quarter of the rows do). A query goes through its own terms and scatters its
weight times the postings into a dense array of scores, one for each row of
the block; a partition selects the best k of the array, with all ties at its
border, and the blocks' selections are merged. Every row meets every query, in
cells of BLOCK rows by BLOCK queries that are formed by hash, so no cell
depends on how the values are distributed.

Defined results: weights are ``floor(scale * x)`` of the component as double;
scores are 64-bit integers. Vectors that are null, empty or hold null or
non-finite components, and rows with a null id, take no part; of rows that
share an id the smallest vector counts; only vectors of one length are
compared; the zero vector takes part; equal scores go to the smaller id; fewer
than k candidates are all returned; an empty table gives no rows; other columns
are ignored. A component whose weight, or a score that, exceeds 64 bits is an
error of the input and wraps as Spark's own integers do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import materialized

BLOCK = 1 << 14
DENSE = 0.25


def weighted(df: DataFrame, key: str, vector: str, query: Column, scale: int) -> DataFrame:
    """(id, v, q): integer weights of the vectors that take part, a row an id."""
    v = F.col(vector).cast("array<double>")
    good = (F.col(key).isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    return (df.where(good).select(F.col(key).cast("long").alias("id"),
                                  F.transform(v, lambda x: F.floor(x * scale)).alias("v"),
                                  F.coalesce(query, F.lit(False)).alias("q"))
            .groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")))


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(rows, -1)


def postings(x: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term the rows that hold it and their weights; rows are None where
    the weights are those of all rows."""
    out = []
    for column in np.ascontiguousarray(x.T):
        rows = np.flatnonzero(column)
        out.append((None, column) if len(rows) > DENSE * len(column) else (rows, column[rows]))
    return out


def accumulate(terms: np.ndarray, weights: np.ndarray, lists: list, scores: np.ndarray) -> None:
    """Scores of all rows of a block for one query, a term at a time."""
    scores[:] = 0
    for t, w in zip(terms.tolist(), weights):
        rows, held = lists[t]
        if rows is None:
            scores += held * w
        else:
            scores[rows] += held * w


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows but ``own``, ties to the smaller id. A partition finds
    the k+1-st score; all rows that reach it are ordered exactly."""
    at = np.arange(len(ids))
    if len(ids) > k + 1:
        edge = np.partition(scores, len(ids) - k - 1)[len(ids) - k - 1]
        at = np.flatnonzero(scores >= edge)
    at = at[ids[at] != own]
    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return ids[at], scores[at]


def cell(k: int):
    """Best k rows of a block for each query of another."""
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "ids": [], "scores": []}
        if rows.num_rows and asked.num_rows:
            ids = rows["id"].to_numpy()
            lists = postings(matrix(rows["v"], len(ids)))
            scores = np.zeros(len(ids), np.int64)
            for own, query in zip(asked["qid"].to_pylist(), matrix(asked["qv"], asked.num_rows)):
                terms = np.flatnonzero(query)
                accumulate(terms, query[terms], lists, scores)
                found, reached = best(scores, ids, own, k)
                if len(found):
                    out["query_id"].append(own)
                    out["ids"].append(found)
                    out["scores"].append(reached)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())),
                                               ("scores", pa.list_(pa.int64()))]))
    return run


def search(df: DataFrame, query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``query`` marks, its
    k other rows of highest integer inner product."""
    spark = df.sparkSession
    vectors = materialized(weighted(df, key, vector, query, scale))
    sizes = vectors.select(F.size("v").alias("dim"), "q").groupBy("dim").agg(
        F.count("*").alias("n"), F.count_if("q").alias("nq"))
    # as many blocks as there are tasks, more where a block would be too large
    least = 2 * spark.sparkContext.defaultParallelism
    grid = sizes.select("dim", F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(least)).cast("int").alias("dn"),
                        F.ceil(F.col("nq") / BLOCK).cast("int").alias("qn")).where("qn > 0")
    placed = vectors.withColumn("dim", F.size("v")).join(grid, "dim")   # one row for each length
    h = F.xxhash64("id")
    rows = placed.select("dim", F.pmod(h, F.col("dn")).alias("dp"),
                         F.explode(F.expr("sequence(0, qn - 1)")).alias("qp"), "id", "v")
    asked = placed.where("q").select(F.col("dim").alias("q_dim"), F.pmod(h, F.col("qn")).cast("int").alias("q_qp"),
                                     F.explode(F.expr("sequence(0L, dn - 1L)")).alias("q_dp"),
                                     F.col("id").alias("qid"), F.col("v").alias("qv"))
    found = (rows.groupBy("dim", "dp", "qp").cogroup(asked.groupBy("q_dim", "q_dp", "q_qp"))
             .applyInArrow(cell(k), "query_id long, ids array<long>, scores array<long>"))
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

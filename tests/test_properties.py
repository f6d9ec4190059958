"""Property checks from the test strategy: sum pool = mean pool x n, split
sizes add up, exact take never exceeds a quota, graph edges only between
nodes of the same document."""

import random

import pytest
from pyspark.sql import functions as F

from lexiscope.operators import graph as G
from lexiscope.operators import sampling as SM


def test_sum_pool_is_mean_times_count(spark):
    rnd = random.Random(11)
    rows = [(d, f"n{k}", [rnd.uniform(-1, 1) for _ in range(5)]) for d in range(6) for k in range(rnd.randint(1, 9))]
    nv = spark.createDataFrame(rows, "doc_id long, node string, vec array<double>")
    s = {r.doc_id: r.vec for r in G.pool(nv, "sum").collect()}
    m = {r.doc_id: r.vec for r in G.pool(nv, "mean").collect()}
    mx = {r.doc_id: r.vec for r in G.pool(nv, "max").collect()}
    cnt = {r.doc_id: r["count"] for r in nv.groupBy("doc_id").count().collect()}
    for d in s:
        for a, b in zip(s[d], m[d]):
            assert a == pytest.approx(b * cnt[d], abs=1e-9)
        for j, v in enumerate(mx[d]):
            assert v == pytest.approx(max(r[2][j] for r in rows if r[0] == d))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_sizes_add_up(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(20, 400)
    k = rnd.randint(2, 5)
    df = spark.createDataFrame([(i, rnd.randrange(k)) for i in range(n)], "id long, label int")
    ratio = rnd.choice([0.2, 0.3, 0.25])
    s = SM.stratified_split(df, "label", ratio)
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    import math
    assert c.get("train", 0) + c.get("test", 0) == n
    assert c.get("test", 0) == math.ceil(ratio * n)
    # per class, the train share is within one row of proportional
    per = s.groupBy("label").agg(F.sum((F.col("split") == "train").cast("int")).alias("tr"),
                                 F.count(F.lit(1)).alias("cnt")).collect()
    n_train = n - math.ceil(ratio * n)
    for r in per:
        assert abs(r.tr - r.cnt * n_train / n) < 1.0 + 1e-9


def test_take_never_exceeds_quota(spark):
    rows = [(i, ["a", "b", "c"][i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string")
    q = spark.createDataFrame([("a", 10), ("b", 500), ("c", 0)], "g string, quota long")
    got = {r.g: r["count"] for r in SM.take_per_group(df, ["g"], q).groupBy("g").count().collect()}
    assert got == {"a": 10, "b": 300}


def test_edges_within_document_nodes(spark):
    from lexiscope.sources import fixtures as X
    toks = X.tokens(spark, "/root/testdata/sf0.001")
    nodes, edges = G.build_graph(toks)
    bad = (edges.select("doc_id", F.col("src").alias("node")).unionByName(edges.select("doc_id", F.col("dst").alias("node")))
           .join(nodes.select("doc_id", "node"), ["doc_id", "node"], "left_anti"))
    assert bad.count() == 0

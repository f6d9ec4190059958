"""Order keys, prefix sums and the exact per-group take against brute force."""

import random
import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiscope.operators import sampling as SM
from lexiscope.operators.prefix import double_order_key, prefix_below


def test_double_order_key_is_ieee_bits(spark):
    vals = [0.0, -0.0, 1.0, -1.0, 0.5, 0.1, 1e-310, -1e-310, 2.0 ** -1022, 1e300, -1e300, 3.0, 0.49999999999999994]
    rnd = random.Random(3)
    vals += [rnd.uniform(-5, 5) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select("x", double_order_key("x").alias("k")).collect()
    for r in got:
        bits = struct.unpack(">q", struct.pack(">d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits)
    ordered = sorted(got, key=lambda r: r.k)
    assert [r.x for r in ordered] == sorted(vals, key=lambda v: (v, 0))


def test_prefix_below_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.getrandbits(63) * rnd.choice([1, -1]), rnd.randint(0, 9)) for _ in range(400)]
    # distinct (g, key)
    seen, uniq = set(), []
    for g, k, v in rows:
        if (g, k) not in seen:
            seen.add((g, k))
            uniq.append((g, k, v))
    df = spark.createDataFrame(uniq, "g string, k long, v long")
    got = {(r.g, r.k): r.v_below for r in prefix_below(df, ["g"], "k", ["v"]).collect()}
    for g, k, _ in uniq:
        assert got[(g, k)] == sum(v for g2, k2, v in uniq if g2 == g and k2 < k)


@pytest.mark.parametrize("quota", [0, 1, 7, 150, 10_000])
def test_take_per_group_equals_window(spark, quota):
    rnd = random.Random(quota)
    rows = [(i, rnd.choice(["x", "y", "y", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = sorted(r.id for r in SM.take_per_group(df, ["g"], quota).collect())
    w = Window.partitionBy("g").orderBy(SM.hash_key("id"), "id")
    want = sorted(r.id for r in df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota).collect())
    assert got == want


def test_split_sizes_and_balance(spark):
    rows = [(i, 1 if i % 5 else 0, f"m{i % 3}") for i in range(503)]
    df = spark.createDataFrame(rows, "id long, label int, model string")
    s = SM.stratified_split(df, "label", 0.2)
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c["test"] == 101 and c["train"] == 402  # ceil(0.2 * 503)
    b = SM.balance_by_label(df).groupBy("label").count().collect()
    assert len({r["count"] for r in b}) == 1
    one = spark.createDataFrame([(1, 1), (2, 1)], "id long, label int")
    assert SM.balance_by_label(one).count() == 2  # a single label is left unchanged
    bm = SM.balance_by_label_model(df).groupBy("label", "model").count().collect()
    for lab in (0, 1):
        assert len({r["count"] for r in bm if r.label == lab}) == 1


def test_leave_out_conserves_rows(spark):
    df = spark.createDataFrame([(i, ["train", "val", "test"][i % 3], ["de", "en"][i % 2]) for i in range(60)],
                               "id long, split string, genre string")
    out = SM.leave_out(df, ["de"])
    assert out.count() == 60
    assert out.where("genre = 'de' AND split = 'train'").count() == 0
    assert out.where("split = 'test'").count() == 20


def test_split_sends_no_group_to_one_task(spark):
    from lexiscope.operators.sampling import stratified_split
    df = spark.range(100).selectExpr("id", "CAST(id % 2 AS INT) AS label", "repeat('x', 50) AS text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as for tables that are not small
    try:
        plan = stratified_split(df, "label", 0.2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    by_label = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(label#" in line and ", id#" not in line]
    assert by_label and not any("text#" in below for below in by_label), plan


def test_corpus_loaders_shuffle_no_text(spark):
    """The word lengths are taken where the texts are read, below every exchange."""
    import __spark_entry__ as E
    for name in ("load_corpus", "load_corpus_domain"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        top = plan.split("Join", 1)[0]
        assert "text#" not in top and "word_len#" in top, plan

"""Literal-row cases for rules that the generated tables do not exercise."""

import math

import pytest
from pyspark.sql import functions as F


def test_encode_facet_with_the_value_unknown(spark):
    from lexiscope.operators.lookups import encode_facet, facet_ids
    df = spark.createDataFrame([(1, "b"), (2, "unknown"), (3, "a"), (4, None)], "id int, genre string")
    ids = facet_ids(df, "genre")
    assert sorted(tuple(r) for r in ids.collect()) == [("a", 0), ("b", 1), ("unknown", 2)]
    got = {r.id: r.fid for r in encode_facet(df, ids, "genre").collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 2}


def test_cross_entropy_does_not_underflow(spark):
    from lexiscope.operators.metrics import cross_entropy
    df = spark.createDataFrame([([800.0, 0.0], 1), ([0.0, 0.0], 0)], "logits array<double>, label int")
    assert cross_entropy(df).first()[0] == pytest.approx((800 + math.log(2)) / 2)


def test_take_percent_sizes(spark):
    from lexiscope.operators.sampling import take_percent
    df = spark.range(100).select(F.col("id").cast("string").alias("id"))
    assert take_percent(df, 29.0).count() == int(100 * (29 / 100)) == 28


def test_token_vectors_use_every_embedding(spark):
    from lexiscope.sources import fixtures
    sf = "/root/testdata/sf0.1"
    ids = fixtures.token_ids(spark, sf).select("vec_id").distinct()
    assert ids.agg(F.max("vec_id")).first()[0] > 499

"""Invariants for the Spark ML queries (rows-only in the driver check)."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_calibrated_probabilities_in_range(spark):
    from lexiscope.operators import models as MD
    from lexiscope.plans.q_sampling import partitions
    p = partitions(spark, SF).select("id", "text", "label", "split").checkpoint()
    tr, te = p.where("split = 'train'"), p.where("split = 'test'")
    feats, clf = MD.fit_text_classifier(tr, "nb", calibrated=True, folds=3)
    out = MD.predict_proba(feats, clf, te).select("prob").collect()
    assert out and all(0.0 <= r.prob <= 1.0 for r in out)


def test_model_reload_equal(spark):
    import __spark_entry__ as E
    rows = E.queries()["model_persist"](spark, SF).collect()
    assert rows and all(r.same for r in rows)


def test_softmax_rows_sum_to_one(spark):
    from lexiscope.functions.scalar import softmax
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0],)], "a array<double>")
    for r in df.select(F.aggregate(softmax(F.col("a")), F.lit(0.0), lambda s, x: s + x).alias("s")).collect():
        assert abs(r.s - 1.0) < 1e-12

"""Solvers that keep the coefficients of the rows, not the weights of the columns."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from lexiscope.operators import models as MD


def frame(spark, classes, size, n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        at = sorted(rng.choice(20, 6, replace=False).tolist())
        x = (rng.random(6) + [(k % classes) * (i % classes == 0) for i in range(6)]).tolist()
        at = [i * (size // 20) for i in at]
        rows.append((k, k % classes, at, x, SparseVector(size, at, x)))
    schema = StructType([StructField("id", LongType()), StructField("label", IntegerType()), StructField("indices", ArrayType(IntegerType())),
                         StructField("values", ArrayType(DoubleType())), StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema).coalesce(2)


@pytest.mark.parametrize("name", ["linear_svc", "sgd"])
def test_memory_does_not_follow_the_columns(spark, name):
    """One array over 2 billion columns would take 16 GB."""
    df = frame(spark, 2, 2_000_000_000)
    args = {"max_iter": 3} if name == "sgd" else {}
    wide = MD.classifier(name, folds=3, **args).fit(df)
    assert wide.weights.count() <= 20 and wide.transform(df).where("prob BETWEEN 0 AND 1").count() == 60
    narrow = MD.classifier(name, folds=3, **args).fit(frame(spark, 2, 20))
    assert np.allclose(sorted(r.prob for r in wide.transform(df).collect()),
                       sorted(r.prob for r in narrow.transform(frame(spark, 2, 20)).collect()), atol=1e-6)


def test_multinomial_regression_is_that_of_spark_ml(spark):
    df = frame(spark, 3, 20).cache()
    want = LogisticRegression(regParam=1 / 60, standardization=False, maxIter=2000, tol=1e-12, family="multinomial").fit(df)
    got = MD.LinearClassifier("logreg", classes=3, tol=1e-9).fit(df).transform(df).collect()
    wanted = {r.id: np.array(r.p) for r in want.transform(df).select("id", vector_to_array("probability").alias("p")).collect()}
    for r in got:
        e = np.exp(np.array(r.margins) - max(r.margins))
        assert np.allclose(e / e.sum(), wanted[r.id], atol=1e-4)


@pytest.mark.parametrize("classes", [2, 3])
def test_naive_bayes_is_that_of_spark_ml(spark, classes):
    df = frame(spark, classes, 20).cache()
    want = NaiveBayes(smoothing=1.0).fit(df).transform(df)
    want = {r.id: (r.p, r.prediction) for r in want.select("id", vector_to_array("probability").alias("p"), "prediction").collect()}
    clf = MD.classifier("nb", calibrated=False) if classes == 2 else MD.LinearClassifier("nb", classes=classes)
    for r in clf.fit(df).transform(df).collect():
        assert r.prediction == want[r.id][1]
        if classes == 2:
            assert abs(r.prob - want[r.id][0][1]) < 1e-9


def test_null_labels_are_refused_where_classes_are_counted(spark):
    df = frame(spark, 2, 20).withColumn("label", F.when(F.col("id") > 3, F.col("label")))
    with pytest.raises(PySparkException, match="Labels MUST NOT be Null"):
        MD.classifier("nb", calibrated=False).fit(df)

"""Models of the same rows share their terms and tiles; a pass leaves nothing
on the driver."""

import numpy as np
import pytest
from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

from lexiscope.operators import models as MD
from lexiscope.operators import solvers as SV
from lexiscope.operators.terms import TermVectorizer


def _texts(spark):
    return spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17:02d}" for j in range(1, 9)), k % 3) for k in range(60)],
                                 "id long, text string, label int").repartition(3)


def test_models_of_shared_tiles_are_the_same(spark):
    df = _texts(spark)
    feats = TermVectorizer().fit(df)
    x = feats.transform(df)
    data = MD.class_training(x, 3)
    for name in ("linear_svc", "logreg", "nb"):
        own, shared = MD.fit_multiclass(df, name, 3), MD.fit_multiclass(df, name, 3, feats, x, data)
        a, b = ({r.id: r.prediction for r in m.transform(df).collect()} for m in (own, shared))
        assert a == b and len(a) == 60, name
    data.release()
    nulls = MD.class_training(x.withColumn("label", F.when(F.col("id") > 0, F.col("label"))), 3)
    with pytest.raises(Exception, match="Null or NaN"):
        MD.fit_multiclass(df, "logreg", 3, feats, x, nulls)


def test_terms_are_fitted_once_for_all_models(spark, monkeypatch):
    import __spark_entry__ as E
    fits = []
    fit = TermVectorizer._fit
    monkeypatch.setattr(TermVectorizer, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    assert E.queries()["baseline_multiclass"](spark, "/root/testdata/sf0.001").count() == 4
    assert len(fits) == 1


def test_a_pass_leaves_no_broadcast_behind(spark, monkeypatch):
    gone = []
    destroy = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(1) or destroy(self, *a))
    rows = spark.createDataFrame([(k % 2, -1, [k % 5], [1.0]) for k in range(40)],
                                 "y int, fold int, indices array<int>, values array<double>")
    data = SV.Training(rows, [0, 1])
    data.product(np.ones((2, 40)))
    data.weights(np.ones((2, 40)))
    assert len(gone) == 2
    assert data.y.itemsize == data.use.itemsize == 1
    data.release()

"""Classifiers over the whole vocabulary: features term by term, solvers
against plain numpy, saved and reloaded models."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lexiscope.operators import features as FE
from lexiscope.operators import models as MD
from lexiscope.operators import solvers
from lexiscope.operators.terms import TermVectorizer, terms_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    from lexiscope.plans.q_models import _splits
    tr, te = _splits(spark, SF)
    model = TermVectorizer().fit(tr)
    return tr, te, model, model.transform(tr), model.transform(te)


@pytest.fixture(scope="module")
def plain(data):
    """(rows, X with the intercept's ones, y) of the training rows."""
    x, columns = data[3], data[2].size + 1
    rows = solvers.labelled(x, "label", F.lit(-1)).persist()
    got = rows.toPandas()
    m = np.zeros((len(got), columns))
    m[:, -1] = 1
    for i, (at, v) in enumerate(zip(got.indices, got["values"])):
        m[i, at] = v
    return rows, m, np.where(got.y == 1, 1.0, -1.0)


def test_features_are_the_tfidf_weights_of_all_terms(spark, data):
    tr, _, model, x, _ = data
    tokens = terms_of(tr, "id", "text")
    assert model.size == tokens.select("term").distinct().count()
    each = tokens.withColumn("tf", F.explode(F.expr("sequence(1, cast(tf as int))"))).select("id", "term")
    want = FE.tfidf(each, doc="id", n_docs=tr.count())
    named = x.select("id", F.explode(F.arrays_zip("indices", "values")).alias("t")).select(
        "id", F.col("t.indices").alias("idx"), F.col("t.values").alias("got")).join(model.vocabulary, "idx")
    both = named.join(want, ["id", "term"], "full").selectExpr("abs(got - weight) AS d").toPandas()
    assert both.d.notna().all() and both.d.max() < 1e-12
    order = [r.term for r in model.vocabulary.orderBy("idx").collect()]
    assert order == sorted(order, key=lambda t: t.encode()) and len(order) == model.size
    vector = x.select("features", "indices", "values").first()
    assert vector[0].indices.tolist() == vector[1] and vector[0].values.tolist() == vector[2]


def test_texts_without_known_terms_have_empty_vectors(spark, data):
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "the of and", 1), (4, "qqqzzz", 0), (4, "qqqzzz", 0)],
                               "id long, text string, indices int")
    out = data[2].transform(df.withColumnRenamed("indices", "label"))
    assert out.count() == 5 and {r.features.numNonzeros() for r in out.collect()} == {0}
    assert MD.classifier("linear_svc").fit(data[3]).transform(out).count() == 5
    assert data[2].transform(df.limit(0).withColumnRenamed("indices", "label")).count() == 0


@pytest.mark.parametrize("loss, penalised", [("squared_hinge", True), ("logistic", False)])
def test_newton_finds_the_optimum(plain, loss, penalised):
    rows, x, y = plain
    w, info = solvers.newton(rows, x.shape[1], [1], loss=loss, penalise_intercept=penalised, tol=1e-6)
    weight = np.ones(x.shape[1])
    weight[-1] = 1.0 if penalised else 1e-9
    v = np.zeros(x.shape[1])
    for _ in range(60):     # full Newton steps, solved in the space of the rows
        _, first, second = solvers.loss_terms(loss, y * (x @ v))
        g = weight * v + x.T @ (first * y)
        s = np.sqrt(second + 1e-300)[:, None] * x
        step = g / weight - (s.T @ np.linalg.solve(np.eye(len(y)) + (s / weight) @ s.T, s @ (g / weight))) / weight
        v = v - step
    assert info["norms"][-1, 0] <= 1e-6 * info["norms"][0, 0]
    assert np.abs(v - w[0]).max() < 1e-4
    value = 0.5 * (weight * v * v).sum() + solvers.loss_terms(loss, y * (x @ v))[0].sum()
    assert abs(info["objective"][0] - value) < 1e-6 * value


def test_models_in_step_are_those_fitted_alone(spark, data):
    x, columns = data[3], data[2].size + 1
    fold = MD.fold_of("id", 3)
    together, _ = solvers.newton(solvers.labelled(x, "label", fold).persist(), columns, [1] * 3, tol=1e-8)
    for k in range(3):
        alone, _ = solvers.newton(solvers.labelled(x.where(fold != k), "label", F.lit(-1)), columns, [1], tol=1e-8)
        assert np.abs(together[k] - alone[0]).max() < 1e-5


def test_sums_by_shuffle_equal_those_of_the_driver(plain, monkeypatch):
    rows, x, _ = plain
    direct, _ = solvers.newton(rows.repartition(3), x.shape[1], [1])
    monkeypatch.setattr(solvers, "DIRECT", 0)
    shuffled, _ = solvers.newton(rows.repartition(3), x.shape[1], [1])
    assert np.allclose(direct, shuffled, atol=1e-6)


def hinge(w, x, y, alpha):
    return np.maximum(0, 1 - y * (x @ w)).mean() + alpha / 2 * (w[:-1] @ w[:-1])


def plain_sgd(x, y, alpha, epochs, seed=42):
    w, t = np.zeros(x.shape[1]), 0
    for k in range(epochs):
        for i in np.random.default_rng((seed, k)).permutation(len(y)):
            eta = 1 / (alpha * (1 / (np.sqrt(1 / np.sqrt(alpha)) * alpha) + t))
            t += 1
            margin = y[i] * (x[i] @ w)
            w[:-1] *= 1 - eta * alpha
            if margin < 1:
                w += eta * y[i] * x[i]
    return w


def test_sgd_on_one_partition_is_the_plain_loop(plain):
    rows, x, y = plain
    w, info = solvers.sgd(rows.coalesce(1), x.shape[1], [1], tol=-np.inf, max_iter=6)
    assert info["rounds"] == 6 and np.allclose(w[0], plain_sgd(x, y, 1e-4, 6), atol=1e-9)


def test_sgd_over_partitions_reaches_the_objective_of_the_plain_loop(plain):
    rows, x, y = plain
    w, _ = solvers.sgd(rows.repartition(4), x.shape[1], [1], alpha=0.05, tol=-np.inf, max_iter=60)
    loop = plain_sgd(x, y, 0.05, 60)
    assert hinge(w[0], x, y, 0.05) <= 1.01 * hinge(loop, x, y, 0.05)


def test_sgd_stops_by_its_tolerance(plain):
    rows, x, _ = plain
    assert solvers.sgd(rows, x.shape[1], [1])[1]["rounds"] < 60


def test_sigmoids_maximise_the_likelihood_of_smoothed_targets(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=400)
    y = (m + rng.normal(size=400) > 0.3).astype(int)
    df = spark.createDataFrame([(int(i % 2), float(a), int(b)) for i, (a, b) in enumerate(zip(m, y))],
                               "fold int, m double, y int")
    for k, (a, b) in enumerate(MD.sigmoids(df, 2)):
        mk, yk = m[k::2], y[k::2]
        t = np.where(yk == 1, (yk.sum() + 1) / (yk.sum() + 2), 1 / (len(yk) - yk.sum() + 2))
        gap = 1 / (1 + np.exp(-(a * mk + b))) - t
        assert abs(gap.sum()) < 1e-6 and abs((gap * mk).sum()) < 1e-6


@pytest.mark.parametrize("name, calibrated", [("linear_svc", True), ("sgd", True), ("logreg", False), ("nb", True)])
def test_saved_models_predict_the_same(spark, data, tmp_path, name, calibrated):
    _, te, feats, x, y = data
    clf = MD.classifier(name, calibrated, folds=3).fit(x)
    path = f"{tmp_path}/model"
    PipelineModel([feats, clf]).write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = {r.id: r.prob for r in MD.predict_proba(feats, clf, te).collect()}
    b = {r.id: r.prob for r in MD.predict_proba(loaded.stages[0], loaded.stages[1], te).collect()}
    assert a == b and all(0 <= p <= 1 for p in a.values())


def test_one_vs_rest_in_step(spark, data):
    x = data[3].withColumn("label", (F.col("id") % 3).cast("int"))
    out = MD.LinearClassifier("linear_svc", classes=3).fit(x).transform(x)
    assert out.where("prediction = label").count() == out.count()      # separable

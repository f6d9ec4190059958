"""Epoch training of the MLP: gradient, averaging, early stop, resume."""

import numpy as np
import pytest

from lexiscope.operators import metrics as M
from lexiscope.operators import mlp, solvers


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    names = ["train", "train", "train", "val", "test"]
    return spark.createDataFrame([(names[i % 5], int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))],
                                 "split string, label int, vec array<double>")


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    layers, x, y = [4, 6, 5, 3], rng.normal(size=(9, 4)), rng.integers(0, 3, 9)
    w = mlp.initial(layers, 2)
    loss, g = mlp.gradient(x, y, w, layers, 0.0, rng)
    for k, e in enumerate(1e-6 * np.eye(len(w))):
        assert abs((mlp.gradient(x, y, w + e, layers, 0.0, rng)[0] - loss) / 1e-6 - g[k]) < 1e-4
    assert abs(loss + mlp.log_probabilities(x, w, layers)[np.arange(9), y].mean()) < 1e-12


def test_learns_what_a_linear_model_cannot_and_stops(rows):
    m = mlp.train(rows.coalesce(1), [32, 16], epochs=60, patience=5, lr=1e-2)
    assert len(m.metrics) < 61 and m.best == len(m.metrics) - 1 - 5
    losses = [r["val_loss"] for r in m.metrics]
    assert losses[m.best] == min(losses)
    assert m.metrics[m.best]["test_accuracy"] > 0.8


def test_averaged_partitions_and_shuffled_sums(rows, monkeypatch):
    m = mlp.train(rows.repartition(3), [16], epochs=4, lr=1e-2)
    monkeypatch.setattr(solvers, "DIRECT", 0)
    again = mlp.train(rows.repartition(3), [16], epochs=4, lr=1e-2)
    assert np.allclose(m.flat, again.flat, atol=1e-9) and m.metrics[-1]["train_loss"] < m.metrics[0]["train_loss"]


def test_a_resumed_fit_is_the_one_that_was_not_interrupted(rows, tmp_path):
    one = rows.coalesce(1)
    whole = mlp.train(one, [16], epochs=5, dropout=0.3, lr=1e-2)
    mlp.train(one, [16], epochs=2, dropout=0.3, lr=1e-2, folder=f"{tmp_path}/state")
    rest = mlp.train(one, [16], epochs=5, dropout=0.3, lr=1e-2, folder=f"{tmp_path}/state")
    assert np.array_equal(whole.flat, rest.flat) and whole.metrics == rest.metrics


def test_measures_are_those_of_the_predictions(spark, rows):
    m = mlp.train(rows, [16], epochs=3, lr=1e-2, dropout=0.5)
    got = m.transform(rows.where("split = 'test'"))
    pred = got.selectExpr("label", "prediction AS pred")
    assert abs(M.accuracy(pred).first()[0] - m.metrics[m.best]["test_accuracy"]) < 1e-12
    assert abs(M.f1_macro(pred).first()[0] - m.metrics[m.best]["test_f1_macro"]) < 1e-12
    assert m.transform(rows.limit(0)).count() == 0
    table = m.table(spark, "x")
    assert table.count() == len(m.metrics) * 9
    best = {r.metric: r for r in M.best_steps(table).collect()}
    assert best["val_accuracy"].best_value == max(r["val_accuracy"] for r in m.metrics)

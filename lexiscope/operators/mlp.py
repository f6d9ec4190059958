"""Multi-layer perceptron trained in epochs, with early stopping.

Rows are ``(split, label, vec)`` with splits train, val and test. An epoch is
one pass over the rows: every partition starts from the same weights and Adam
moments, goes through its training rows in mini-batches (softmax cross entropy,
ReLU, dropout), and the weights and moments reached are averaged by training
rows. The same pass measures the weights it started from on all splits, so the
metrics of an epoch come with the next pass.

Training stops when the validation loss has not fallen below its best for
``patience`` epochs; the weights of the best epoch are kept. After each epoch
the state and the metrics are written to ``folder`` (a shared folder), from
which ``train`` resumes if called again.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators import solvers

SPLITS = ("train", "val", "test")


def initial(layers: list[int], seed: int) -> np.ndarray:
    """Weights and biases as one array: uniform in +-1/sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(layers, layers[1:]):
        out += [rng.uniform(-1, 1, a * b) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return np.concatenate(out)


def parted(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def log_probabilities(x: np.ndarray, flat: np.ndarray, layers: list[int]) -> np.ndarray:
    for k, (w, b) in enumerate(parted(flat, layers)):
        x = x @ w + b
        if k < len(layers) - 2:
            x = np.maximum(x, 0.0)
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, layers: list[int], dropout: float,
             rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Mean cross entropy of a mini-batch and its gradient."""
    parts, inputs, masks = parted(flat, layers), [x], []
    for k, (w, b) in enumerate(parts):
        x = inputs[-1] @ w + b
        if k < len(parts) - 1:
            keep = (x > 0) * (rng.random(x.shape) >= dropout) / (1.0 - dropout)
            masks.append(keep)
            x = x * keep
        inputs.append(x)
    logits = inputs.pop()
    logits = logits - logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = -np.log(np.maximum(p[at, y], 1e-300)).mean()
    p[at, y] -= 1.0
    back, out = p / len(y), []
    for k in range(len(parts) - 1, -1, -1):
        out = [(inputs[k].T @ back).ravel(), back.sum(axis=0), *out]
        if k:
            back = (back @ parts[k][0].T) * masks[k - 1]
    return loss, np.concatenate(out)


def adam(flat, m, v, t, g, lr, decay):
    g = g + decay * flat
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return flat - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8), m, v


def rows_of(batch: pa.RecordBatch, s: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return ((x - s["mean"]) / s["std"], batch.column("label").to_numpy(zero_copy_only=False),
            batch.column("split").to_numpy(zero_copy_only=False))


def _epoch(batches: Iterator[pa.RecordBatch], s: dict) -> np.ndarray | None:
    """(1 x n) sums: weights, moments and steps reached times the training
    rows, the training rows, then per split the loss and the confusion counts
    of the weights at the start."""
    layers, classes = s["layers"], s["layers"][-1]
    flat, m, v, t, n = s["flat"], s["m"], s["v"], s["t"], 0
    rng = np.random.default_rng((s["seed"], s["epoch"]))
    measured, seen = np.zeros((len(SPLITS), 1 + classes * classes)), False
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, split = rows_of(batch, s)
        seen, lp = True, log_probabilities(x, s["flat"], layers)
        loss, cell = -lp[np.arange(len(y)), y], y * classes + lp.argmax(axis=1)
        for k in range(len(SPLITS)):
            measured[k, 0] += loss[split == k].sum()
            measured[k, 1:] += np.bincount(cell[split == k], minlength=classes * classes)
        own = rng.permutation(np.flatnonzero(split == 0))
        for a in range(0, len(own) if s["learn"] else 0, s["batch"]):
            part = own[a:a + s["batch"]]
            t += 1
            _, g = gradient(x[part], y[part], flat, layers, s["dropout"], rng)
            flat, m, v = adam(flat, m, v, t, g, s["lr"], s["decay"])
        n += len(own)
    if not seen:
        return None
    return np.concatenate([flat * n, m * n, v * n, [t * n, n], measured.ravel()])[None, :]


def report(measured: np.ndarray, classes: int) -> dict[str, float]:
    """Loss, accuracy and macro F1 of each split that has rows."""
    out = {}
    for name, row in zip(SPLITS, measured):
        c = row[1:].reshape(classes, classes)
        if (n := c.sum()) == 0:
            continue
        held = (c.sum(axis=0) + c.sum(axis=1)) > 0
        f1 = 2 * np.diag(c) / np.maximum(c.sum(axis=0) + c.sum(axis=1), 1)
        out |= {f"{name}_loss": row[0] / n, f"{name}_accuracy": np.trace(c) / n, f"{name}_f1_macro": f1[held].mean()}
    return {k: float(v) for k, v in out.items()}


class MlpModel:
    """Weights of the best epoch; ``metrics`` are those of every epoch."""

    def __init__(self, layers, flat, mean, std, metrics, best):
        self.layers, self.flat, self.mean, self.std, self.metrics, self.best = layers, flat, mean, std, metrics, best

    def transform(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """All columns, the class probabilities and ``prediction``."""
        shared = df.sparkSession.sparkContext.broadcast((self.layers, self.flat, self.mean, self.std))

        @F.pandas_udf("array<double>")
        def of(vectors: pd.Series) -> pd.Series:
            layers, flat, mean, std = shared.value
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.exp(log_probabilities((np.stack(vectors.to_numpy()) - mean) / std, flat, layers))))

        out = df.withColumn("probability", of(vec))
        return out.withColumn("prediction", F.array_position("probability", F.array_max("probability")).cast("int") - 1)

    def table(self, spark: SparkSession, run: str) -> DataFrame:
        """``(run, step, metric, value)``: one row for each epoch and metric."""
        return spark.createDataFrame([(run, k, name, float(x)) for k, row in enumerate(self.metrics)
                                      for name, x in sorted(row.items())],
                                     "run string, step int, metric string, value double")


def _save(spark: SparkSession, folder: str, s: dict, history: dict) -> None:
    data = io.BytesIO()
    np.savez(data, flat=s["flat"], m=s["m"], v=s["v"], t=s["t"], kept=history["kept"],
             scalars=[history["best"], history["least"], history["calm"]])
    names = sorted(history["metrics"][-1]) if history["metrics"] else []
    rows = [(bytearray(data.getvalue()), names, [[float(r[n]) for n in names] for r in history["metrics"]])]
    (spark.createDataFrame(rows, "state binary, names array<string>, metrics array<array<double>>").coalesce(1)
     .write.mode("overwrite").parquet(os.path.join(folder, f"epoch={s['epoch']}")))


def _resume(spark: SparkSession, folder: str, s: dict, history: dict) -> None:
    """The state after the last epoch that was written whole."""
    try:
        last = spark.read.parquet(folder).orderBy(F.desc("epoch")).first()
    except AnalysisException:       # nothing written yet
        return
    if last is not None:
        data = np.load(io.BytesIO(bytes(last.state)))
        s.update(flat=data["flat"], m=data["m"], v=data["v"], t=int(data["t"]), epoch=int(last.epoch))
        best, least, calm = data["scalars"]
        history.update(kept=data["kept"], best=int(best), least=float(least), calm=int(calm),
                       metrics=[dict(zip(last.names, r)) for r in last.metrics])


def train(df: DataFrame, hidden: list[int], classes: int = 2, epochs: int = 300, patience: int = 10,
          batch: int = 64, lr: float = 1e-3, dropout: float = 0.0, decay: float = 0.0, standardise: bool = True,
          seed: int = 42, folder: str | None = None, label: str = "label", vec: str = "vec") -> MlpModel:
    """Fit on the rows whose ``split`` is train, stop by those of val, measure
    all. ``epochs`` is the most that are run."""
    spark = df.sparkSession
    number = F.coalesce(*[F.when(F.col("split") == n, k) for k, n in enumerate(SPLITS)])
    rows = df.select(number.cast("int").alias("split"), F.col(label).cast("int").alias("label"),
                     F.col(vec).cast("array<double>").alias("vec")).persist()
    dim = rows.select(F.size("vec")).first()[0]         # one row: the width
    mean, std = np.zeros(dim), np.ones(dim)
    if standardise:
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer
        r = rows.where("split = 0").select(array_to_vector("vec").alias("x")).agg(
            Summarizer.mean(F.col("x")), Summarizer.std(F.col("x"))).first()
        mean, std = r[0].toArray(), np.where(r[1].toArray() > 0, r[1].toArray(), 1.0)
    layers = [dim, *hidden, classes]
    flat = initial(layers, seed)
    s = {"flat": flat, "m": np.zeros_like(flat), "v": np.zeros_like(flat), "t": 0, "epoch": 0, "layers": layers,
         "mean": mean, "std": std, "batch": batch, "lr": lr, "dropout": dropout, "decay": decay, "seed": seed,
         "learn": True}
    history = {"kept": flat, "best": 0, "least": np.inf, "calm": 0, "metrics": []}
    if folder:
        _resume(spark, folder, s, history)
    parts = rows.select(F.spark_partition_id()).distinct().count()
    by_shuffle, p = 3 * 8 * len(flat) * parts > solvers.DIRECT, len(flat)
    while True:
        s["learn"] = s["epoch"] < epochs
        got = solvers.array_sum(rows, _epoch, s, 1, by_shuffle)[0]
        row = report(got[3 * p + 2:].reshape(len(SPLITS), -1), classes)
        # an epoch measured before a resume is not measured again
        if len(history["metrics"]) <= s["epoch"]:
            history["metrics"].append(row)
            loss = row.get("val_loss", row.get("train_loss", np.inf))
            if loss < history["least"]:
                history.update(least=loss, best=s["epoch"], kept=s["flat"], calm=0)
            else:
                history["calm"] += 1
        if not s["learn"] or history["calm"] >= patience:
            break
        n = max(got[3 * p + 1], 1)
        s.update(flat=got[:p] / n, m=got[p:2 * p] / n, v=got[2 * p:3 * p] / n, t=int(got[3 * p] / n),
                 epoch=s["epoch"] + 1)
        if folder:
            _save(spark, folder, s, history)
    rows.unpersist()
    return MlpModel(layers, history["kept"], mean, std, history["metrics"], history["best"])

"""Quality: Naive Bayes support vectors.

Every n-gram indicator is scaled by the log-count ratio of its rates in the
two classes; a linear model with hinge loss over the scaled, length-normalised
indicators is fitted by dual coordinate descent, one dual variable per
training row. A logistic curve fitted on a part of the sample that the
machine did not see turns the margin into a probability.

Defined results: a null, empty or wordless text has the bias as its margin;
without training rows of both labels the score is the share of label 1 (0
without rows); repeated rows are scored alike; other columns pass through (a
column named like the output is replaced).
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame

from lexiscope.llm.features import ngram_indicators
from lexiscope.llm.linear import labelled_features, scored, sigmoid

BITS = 18
SAMPLE_PER_CLASS = 3000
EPOCHS = 10
COST = 1.0
SMOOTHING = 1.0
HELD_PART = 5  # one row in so many fits the logistic curve


@dataclasses.dataclass
class QualityModel:
    bits: int
    ratio: np.ndarray   # log-count ratios (float32)
    weight: np.ndarray  # weights of the scaled indicators (float32)
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def margin(self, i: np.ndarray) -> float:
        r = self.ratio[i].astype(float)
        norm = np.sqrt((r * r).sum())
        return self.bias + (float((r * self.weight[i]).sum()) / norm if norm > 0 else 0.0)

    def probability(self, i: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(sigmoid(self.slope * self.margin(i) + self.offset))

    def score(self, text: str | None) -> float:
        return self.probability(ngram_indicators(text, self.bits))


def log_count_ratio(examples: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """log of (rate of the indicator in class 1 / in class 0), smoothed."""
    counts = np.full((2, size), SMOOTHING)
    for y, i in examples:
        counts[y, i] += 1
    rates = counts / counts.sum(axis=1, keepdims=True)
    return np.log(rates[1] / rates[0])


def dual_descent(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int, cost: float,
                 epochs: int) -> tuple[np.ndarray, float]:
    """Hinge loss with L2 term by dual coordinate descent: rows are (label,
    indices, values of unit length). Returns weights and bias."""
    w, bias = np.zeros(size), 0.0
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, i, x = rows[k]
            sign = 1.0 if y else -1.0
            grad = sign * (float(w[i] @ x) + bias) - 1.0
            new = min(max(dual[k] - grad / 2.0, 0.0), cost)  # |x|^2 + bias^2 = 2
            if new != dual[k]:
                w[i] += (new - dual[k]) * sign * x
                bias += (new - dual[k]) * sign
                dual[k] = new
    return w, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton steps on smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def train(examples: list[tuple[int, np.ndarray]], bits: int = BITS, cost: float = COST,
          epochs: int = EPOCHS) -> QualityModel:
    """Fit on (label, distinct indices) pairs. The sample has the classes in
    equal parts where it can; the curve therefore speaks of equal classes."""
    size = 1 << bits
    labels = {y for y, _ in examples}
    if len(labels) < 2:
        empty = np.zeros(size, np.float32)
        return QualityModel(bits, empty, empty, 0.0, 1.0, 0.0, float(max(labels, default=0)))
    held = [e for k, e in enumerate(examples) if k % HELD_PART == 0]
    used = [e for k, e in enumerate(examples) if k % HELD_PART]
    if len({y for y, _ in used}) < 2 or len({y for y, _ in held}) < 2:
        held = used = examples
    ratio = log_count_ratio(used, size).astype(np.float32)
    rows = []
    for y, i in used:
        x = ratio[i].astype(float)
        norm = np.sqrt((x * x).sum())
        rows.append((y, i, x / norm if norm > 0 else x))
    w, bias = dual_descent(rows, size, cost, epochs)
    m = QualityModel(bits, ratio, w.astype(np.float32), bias, 1.0, 0.0)
    slope, offset = logistic_curve(np.array([m.margin(i) for _, i in held]),
                                   np.array([y for y, _ in held]))
    m.slope, m.offset = slope, offset
    return m


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
        bits: int = BITS, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Fit on a bounded sample of the documents that have a label: about
    ``per_class`` rows of each label, by a hash of ``key``."""
    return train(labelled_features(docs, labels, text, label, key, per_class,
                                   lambda t: ngram_indicators(t, bits)), bits)


def score(df: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1."""
    return scored(df, text, model.score, out)

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Every coordinate has its own learning rate, and the L1 term keeps a weight at
exactly 0 until its evidence is worth it; the model is the short list of the
remaining weights and travels to the tasks in their closure (at most 2**bits
entries).

Defined results: a null, empty or wordless text has the bias alone as its
evidence; without any training row the score is 0; repeated rows are scored
alike; other columns pass through (a column named like the output is replaced).
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame

from lexiscope.llm.features import skipgram_features
from lexiscope.llm.linear import labelled_features, scored, sigmoid

BITS = 18
SAMPLE_PER_CLASS = 3000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 0.1


@dataclasses.dataclass
class Ftrl:
    """State of the per-coordinate optimiser over ``size`` features; the last
    coordinate is the bias."""
    size: int
    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2

    def __post_init__(self):
        self.z = np.zeros(self.size)
        self.n = np.zeros(self.size)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, i: np.ndarray, y: int) -> float:
        """One example with indicator features ``i``; returns its probability
        before the update."""
        w = self.weights(i)
        p = float(sigmoid(w.sum()))
        g = p - y
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g
        return p


@dataclasses.dataclass
class ToxicityModel:
    bits: int
    dense: np.ndarray  # float32 weights by index, mostly 0
    bias: float
    trained: bool

    def score(self, text: str | None) -> float:
        if not self.trained:
            return 0.0
        i = skipgram_features(text, self.bits)
        i = i[self.dense[i] != 0]
        return float(sigmoid(self.bias + self.dense[np.unique(i)].sum(dtype=float)))


def train(examples: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS,
          **rates) -> ToxicityModel:
    """Fit on (label, distinct indices) pairs, in a seeded order per epoch. The
    rarer label's examples are repeated until both labels weigh about the same."""
    ones = [e for e in examples if e[0] == 1]
    zeros = [e for e in examples if e[0] != 1]
    few, many = sorted((ones, zeros), key=len)
    examples = many + few * max(1, round(len(many) / max(1, len(few))))
    f = Ftrl((1 << bits) + 1, **rates)
    bias = np.array([1 << bits])
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            y, i = examples[k]
            f.step(np.concatenate([i, bias]), y)
    w = f.weights(np.arange(f.size))
    return ToxicityModel(bits, w[:-1].astype(np.float32), float(w[-1]), bool(examples))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
        bits: int = BITS, per_class: int = SAMPLE_PER_CLASS, epochs: int = EPOCHS) -> ToxicityModel:
    """Fit on a bounded sample of the documents that have a label: about
    ``per_class`` rows of each label, by a hash of ``key``."""
    return train(labelled_features(docs, labels, text, label, key, per_class,
                                   lambda t: skipgram_features(t, bits)), bits, epochs)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1."""
    return scored(df, text, model.score, out)

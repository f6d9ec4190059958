"""Classifiers on TF-IDF rows of the whole vocabulary.

``fit_text_classifier(train, name)`` returns the feature model and a
classifier; with calibration (k folds: fit on k-1, sigmoid on the margins of
the held-out one, average the k probabilities) the folds' linear models are
fitted in step by the solvers of ``lexiscope.operators.solvers``, the boosted
trees of all classes by ``lexiscope.operators.trees``. Everything fits over partitions; weights stay tables. Fitted models can be saved and
loaded, calibrated ones with all their folds.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.scalar import decide
from lexiscope.operators import solvers
from lexiscope.operators.sampling import hash_key
from lexiscope.operators.terms import TermVectorizer
from lexiscope.operators.trees import BoostedTrees

MAX_ITER = 20

# the reference's parameters (its libraries' defaults)
LINEAR = {
    "linear_svc": {"loss": "squared_hinge", "c": 1.0, "penalise_intercept": True, "tol": 1e-4, "max_iter": 1000},
    "logreg": {"loss": "logistic", "c": 1.0, "penalise_intercept": False, "tol": 1e-4, "max_iter": 100},
    "sgd": {"alpha": 1e-4, "tol": 1e-3, "patience": 5, "max_iter": 1000},
    "nb": {"smoothing": 1.0},
}


def base_estimator(name: str, n_classes: int = 2, features: str = "features", label: str = "label",
                   rows: int | None = None):
    """H9 registry of Spark ML's classifiers by name. ``rows`` are the training
    rows, from which the penalty of C = 1 follows."""
    penalty = 0.01 if rows is None else 1.0 / max(rows, 1)
    if name == "linear_svc":
        est = LinearSVC(regParam=penalty, maxIter=MAX_ITER if rows is None else 1000)
    elif name == "logreg":
        est = LogisticRegression(regParam=penalty, elasticNetParam=0.0, standardization=False,
                                 maxIter=MAX_ITER if rows is None else 1000,
                                 family="multinomial" if n_classes > 2 else "binomial")
    elif name == "nb":
        est = NaiveBayes(modelType="multinomial", smoothing=1.0)
    elif name == "gbt":
        est = GBTClassifier(maxIter=10, maxDepth=3, seed=42)
    elif name == "random_forest":
        est = RandomForestClassifier(numTrees=100, seed=42)
    else:
        raise ValueError(f"unknown model {name!r}")
    est = est.setFeaturesCol(features).setLabelCol(label)
    if n_classes > 2 and name in ("linear_svc", "gbt"):
        est = OneVsRest(classifier=est, featuresCol=features, labelCol=label)
    return est


def fold_of(key: str, folds: int) -> F.Column:
    return F.pmod(F.xxhash64(hash_key(key, "fold")), F.lit(folds)).cast("int")


def sigmoids(scored: DataFrame, folds: int, max_iter: int = 100, tol: float = 1e-10) -> list[tuple[float, float]]:
    """Per fold the sigmoid 1 / (1 + exp(-(a m + b))) of its held-out margins:
    logistic regression on ``(fold, m, y)`` with Platt's smoothed targets, by
    Newton steps that are halved until the loss falls. A step is one grouped
    sum over the rows for all folds."""
    counts = {r.fold: (r.p, r.n) for r in scored.groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()}
    high = [(counts.get(k, (0, 0))[0] + 1.0) / (counts.get(k, (0, 0))[0] + 2.0) for k in range(folds)]
    low = [1.0 / (counts.get(k, (0, 0))[1] - counts.get(k, (0, 0))[0] + 2.0) for k in range(folds)]

    def of(values) -> F.Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("fold") + 1)

    rows = scored.select("fold", "m", F.when(F.col("y") == 1, of(high)).otherwise(of(low)).alias("t"))

    def sums(a, b):
        z = of(a) * F.col("m") + of(b)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        gap, curve = p - F.col("t"), p * (1.0 - p)
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("t") * z
        got = rows.groupBy("fold").agg(F.sum(loss), F.sum(gap * F.col("m")), F.sum(gap), F.sum(curve * F.col("m") ** 2),
                                       F.sum(curve * F.col("m")), F.sum(curve)).collect()
        out = np.zeros((folds, 6))
        for r in got:
            out[r[0]] = r[1:]
        return out

    odds = [(counts.get(k, (0, 0))[0] + 1.0) / (counts.get(k, (0, 0))[1] - counts.get(k, (0, 0))[0] + 1.0)
            for k in range(folds)]
    a, b = np.zeros(folds), np.log(odds)
    now, size = sums(a, b), np.ones(folds)
    for _ in range(max_iter):
        _, ga, gb, haa, hab, hbb = now.T
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        ok = (np.maximum(np.abs(ga), np.abs(gb)) > tol * np.maximum(1.0, now[:, 0])) & (det > 0)
        if not ok.any():
            break
        safe = np.where(det > 0, det, 1.0)
        da, db = -(hbb * ga - hab * gb) / safe, -(haa * gb - hab * ga) / safe
        step = np.where(ok, size, 0.0)
        then = sums(a + step * da, b + step * db)
        better = ok & (then[:, 0] <= now[:, 0])
        a, b = np.where(better, a + step * da, a), np.where(better, b + step * db, b)
        now = np.where(better[:, None], then, now)
        size = np.where(better, 1.0, size / 2)
        if not (ok & (size > 1e-8)).any():
            break
    return [(float(x), float(y)) for x, y in zip(a, b)]


class LinearClassifier(Estimator):
    """H1 to H4 by name (``LINEAR``), binary: classes 0 and 1. With ``folds``
    the models of all folds are fitted in step and calibrated (H6); with
    ``classes`` one model for each class: against the rest, or (``logreg``,
    ``nb``) of one multinomial model. ``args`` replace the reference's
    parameters. Models of several classes that are fitted on the same rows may
    share their tiles (``data``, see ``class_training``)."""

    def __init__(self, name: str, folds: int = 0, classes: int = 0, idCol: str = "id", labelCol: str = "label",
                 data: solvers.Training | None = None, **args):
        super().__init__()
        self.data = data
        self.name, self.folds, self.classes, self.id, self.label = name, folds, classes, idCol, labelCol
        self.args = {**LINEAR[name], **args}

    def _fit(self, df: DataFrame) -> "LinearClassifierModel":
        fold = fold_of(self.id, self.folds) if self.folds else F.lit(-1)
        rows = solvers.labelled(df, self.label, fold)
        if self.name == "nb" or self.classes and self.name == "logreg":
            rows = rows.withColumn("y", F.coalesce("y", F.raise_error(F.lit("Labels MUST NOT be Null or NaN")).cast("int")))
        if self.name == "nb":
            return self._count(df, rows)
        targets = list(range(self.classes)) if self.classes else [1] * max(self.folds, 1)
        data = self.data or solvers.Training(rows, targets)
        if self.data and self.name == "logreg" and pd.isna(data.label).any():
            raise ValueError("Labels MUST NOT be Null or NaN")
        if self.name == "sgd":
            a, b, _ = solvers.sgd_rows(data, **self.args)
            m = data.product(a) if self.folds else None
        else:
            args = {k: v for k, v in self.args.items() if k != "loss"}
            joint = bool(self.classes) and self.name == "logreg"
            losses = solvers.Softmax(data) if joint else solvers.Losses(data, self.args["loss"])
            w, _ = solvers.newton_rows(data, losses, joint=joint, **args)
            a, b, m = w.a, w.b, w.m
        if not self.data:
            data.release()
        curves = None
        if self.folds:
            # each row by the model that it was held out from
            at = np.flatnonzero(data.fold >= 0)
            own = pa.table({"fold": pa.array(data.fold[at], pa.int32()), "y": pa.array(data.label[at] == 1).cast(pa.int32()),
                            "m": (m + b[:, None])[data.fold[at].astype(int), at]})
            curves = sigmoids(df.sparkSession.createDataFrame(own), self.folds)
        return LinearClassifierModel(data.weights(a), b, curves, self.classes)

    def _count(self, df: DataFrame, rows: DataFrame) -> "LinearClassifierModel":
        """H4: naive Bayes; two classes as one model of their log odds."""
        size = df.select("features").first()[0].size        # one row: the number of columns
        each = [(c, -2) for c in range(self.classes)] or [(c, k) for k in (range(self.folds) if self.folds else [-2]) for c in (0, 1)]
        weights, b = solvers.naive_bayes(rows, size, each, **self.args)
        if self.classes:
            return LinearClassifierModel(weights, b, None, self.classes)
        weights = weights.select("idx", F.array(*[F.col("w")[2 * k + 1] - F.col("w")[2 * k] for k in range(len(each) // 2)]).alias("w"))
        b, curves = b[1::2] - b[::2], None
        if self.folds:
            own = solvers.margins(df, weights, b).select(
                fold_of(self.id, self.folds).alias("fold"), F.col(self.label).cast("int").alias("y"), "margins")
            held = own.select("fold", "y", _logistic(F.element_at("margins", F.col("fold") + 1)).alias("m")).persist()
            curves = sigmoids(held, self.folds)
            held.unpersist()
        return LinearClassifierModel(weights, b, curves, 0, "probability")


def _logistic(z) -> F.Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


class LinearClassifierModel(Model, MLWritable, MLReadable):
    """``margins`` of the models, ``prob`` of class 1 (the average of the
    calibrated probabilities; the logistic function of the margin where there
    is no calibration) and ``prediction``. Weights are a table ``(idx, w)``.
    The sigmoids are of the margins or (``of``) of their probability."""

    def __init__(self, weights=None, intercepts=(), curves=None, classes: int = 0, of: str = "margin"):
        super().__init__()
        self.weights, self.intercepts, self.curves, self.classes, self.of = weights, intercepts, curves, classes, of

    def _transform(self, df: DataFrame) -> DataFrame:
        out = solvers.margins(df, self.weights, self.intercepts)
        if self.classes:
            return out.withColumn("prediction", (F.array_position(
                "margins", F.array_max("margins")) - 1).cast("double"))
        if self.curves:
            of = _logistic if self.of == "probability" else (lambda z: z)
            each = [_logistic(of(F.col("margins")[k]) * a + b) for k, (a, b) in enumerate(self.curves)]
        else:
            each = [_logistic(F.col("margins")[0])]
        return (out.withColumn("prob", sum(each[1:], each[0]) / float(len(each)))
                .withColumn("prediction", (F.col("prob") > 0.5).cast("double")))

    def write(self) -> MLWriter:
        return _LinearWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LinearReader(cls)


class _LinearWriter(MLWriter):
    """The table of weights; all else in the metadata."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "curves": m.curves, "classes": m.classes, "of": m.of, "intercepts": [float(b) for b in m.intercepts]})
        m.weights.write.parquet(os.path.join(path, "weights"))


class _LinearReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        m = self.cls(self.sparkSession.read.parquet(os.path.join(path, "weights")), meta["intercepts"],
                     meta["curves"] and [tuple(c) for c in meta["curves"]], meta["classes"], meta["of"])
        m._resetUid(meta["uid"])
        return m


def margin_col(model_out: DataFrame, raw: str = "rawPrediction") -> F.Column:
    """Decision value for class 1 of a binary model."""
    return vector_to_array(F.col(raw))[1]


class CalibratedClassifier(Estimator, HasFeaturesCol, HasLabelCol):
    """H6: k-fold sigmoid calibration. Folds come from a hash of the id
    within each class; the Platt fit uses the smoothed targets
    ``(N+ + 1)/(N+ + 2)`` and ``1/(N- + 2)`` as weights on duplicated rows."""

    @keyword_only
    def __init__(self, base=None, folds: int = 5, idCol: str = "id", featuresCol="features", labelCol="label",
                 use_probability: bool = False):
        super().__init__()
        self._base, self._folds, self._id, self._useprob = base, folds, idCol, use_probability
        self._set(featuresCol=featuresCol, labelCol=labelCol)

    def _score(self, m, df):
        out = m.transform(df)
        if self._useprob:
            return out.select("*", vector_to_array(F.col("probability"))[1].alias("_m"))
        return out.select("*", margin_col(out).alias("_m"))

    def _fit(self, df: DataFrame):
        lab = self.getLabelCol()
        d = df.withColumn("_fold", fold_of(self._id, self._folds))
        models, held = [], None
        for k in range(self._folds):
            models.append(self._base.copy().fit(d.where(F.col("_fold") != k)))
            s = self._score(models[-1], d.where(F.col("_fold") == k)).select(
                F.lit(k).alias("fold"), F.col(lab).cast("int").alias("y"), F.col("_m").alias("m"))
            held = s if held is None else held.unionByName(s)
        held = held.persist()
        pairs = [(m, *curve) for m, curve in zip(models, sigmoids(held, self._folds))]
        held.unpersist()
        return CalibratedModel(pairs, self._useprob)


class CalibratedModel(Model, MLWritable, MLReadable):
    """Average of the k calibrated probabilities -> ``prob`` (class 1)."""

    def __init__(self, pairs=(), use_probability=False):
        super().__init__()
        self.pairs, self._useprob = pairs, use_probability

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = df.columns
        acc = df
        names = []
        for i, (m, a, b) in enumerate(self.pairs):
            out = m.transform(acc)
            mv = vector_to_array(F.col("probability"))[1] if self._useprob else margin_col(out)
            z = mv * a + b
            acc = out.select(*acc.columns, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias(f"_p{i}"))
            names.append(f"_p{i}")
        mean = sum(F.col(n) for n in names) / float(len(names))
        return acc.select(*cols, mean.alias("prob"))


    def write(self) -> MLWriter:
        return _CalibratedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CalibratedReader(cls)


class _CalibratedWriter(MLWriter):
    """The folds' models as nested stages, the sigmoids in the metadata."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "curves": [[a, b] for _, a, b in m.pairs], "use_probability": m._useprob})
        for k, (base, _, _) in enumerate(m.pairs):
            base.write().save(os.path.join(path, "folds", str(k)))


class _CalibratedReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        pairs = [(DefaultParamsReader.loadParamsInstance(os.path.join(path, "folds", str(k)), self.sparkSession), a, b)
                 for k, (a, b) in enumerate(meta["curves"])]
        m = self.cls(pairs, meta["use_probability"])
        m._resetUid(meta["uid"])
        return m


def classifier(name: str, calibrated: bool = True, folds: int = 5, **args) -> Estimator:
    """H9: a binary text classifier by name, with the reference's parameters
    unless ``args`` replace them."""
    if name in LINEAR:
        return LinearClassifier(name, folds=folds if calibrated else 0, **args)
    base = base_estimator(name)
    base = base.copy({base.getParam(k): v for k, v in args.items()})
    return CalibratedClassifier(base=base, folds=folds, use_probability=True) if calibrated else base


def fit_text_classifier(train: DataFrame, name: str, calibrated: bool = True, folds: int = 5, **args):
    """H1-H4: TF-IDF features over all terms + classifier (+ calibration).
    Returns ``(feature_model, classifier_model)``."""
    feats = TermVectorizer().fit(train)
    return feats, classifier(name, calibrated, folds, **args).fit(feats.transform(train))


def with_probability(out: DataFrame) -> DataFrame:
    """Class-1 probability ``prob`` of a classifier's output."""
    if "prob" not in out.columns and "probability" in out.columns:
        out = out.withColumn("prob", vector_to_array(F.col("probability"))[1])
    elif "prob" not in out.columns:  # margin-only model: logistic link
        out = out.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin_col(out))))
    return out


def predict_proba(feats, clf, df: DataFrame) -> DataFrame:
    """Class-1 probability ``prob`` per row (one job, no per-row loop)."""
    return with_probability(clf.transform(feats.transform(df)))


def score(feats, clf, df: DataFrame, margin: float = 0.05) -> DataFrame:
    """H8: ``(id, label)`` answers with the undecided band mapped to 0.5."""
    return predict_proba(feats, clf, df).select("id", decide(F.col("prob"), margin).alias("label"))


def class_training(x: DataFrame, n_classes: int, label: str = "label") -> solvers.Training:
    """Tiles of rows that several models of ``n_classes`` classes are fitted on."""
    return solvers.Training(solvers.labelled(x, label, F.lit(-1)), list(range(n_classes)))


def fit_multiclass(train: DataFrame, name: str, n_classes: int = 6, feats=None, x: DataFrame | None = None,
                   data: solvers.Training | None = None):
    """H5 / H7: TF-IDF over all terms + a model of several classes: SVM and SGD
    one-vs-rest (all classes in step), multinomial regression, naive Bayes or
    trees. ``feats``, ``x`` and ``data`` are the terms, the rows and the tiles of
    ``train``, where they are known."""
    feats = feats or TermVectorizer().fit(train)
    x = (feats.transform(train) if x is None else x).select("label", "features", "indices", "values")
    if name in LINEAR:
        return PipelineModel([feats, LinearClassifier(name, classes=n_classes, data=data).fit(x)])
    if name == "gbt":
        return PipelineModel([feats, BoostedTrees().fit(x)])
    x = x.select("label", "features").persist()
    clf = base_estimator(name, n_classes, rows=x.count()).fit(x)
    x.unpersist()
    return PipelineModel([feats, clf])


def fit_embedding_classifier(df: DataFrame, kind: str = "logreg", vec: str = "vec", label: str = "label"):
    """Standardise (mean, std) then logistic regression / linear SVM /
    random forest (100 trees) / MLP 256-128 on document embeddings."""
    from pyspark.ml.functions import array_to_vector
    d = df.withColumn("_raw", array_to_vector(F.col(vec)))
    dim = len(d.select(vec).first()[0])  # one row: the embedding width
    sc = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    if kind == "mlp":
        clf = MultilayerPerceptronClassifier(layers=[dim, 256, 128, 2], maxIter=MAX_ITER, seed=42)
    else:
        clf = base_estimator({"logreg": "logreg", "svm": "linear_svc", "rf": "random_forest"}[kind], rows=d.count())
    clf = clf.setLabelCol(label)
    return Pipeline(stages=[sc, clf]).fit(d), "_raw"


def fit_pooled_mlp(df: DataFrame, hidden=(200, 200), vec: str = "vec", label: str = "label"):
    """MLP with two hidden layers on mean-pooled node vectors."""
    from pyspark.ml.functions import array_to_vector
    d = df.withColumn("features", array_to_vector(F.col(vec)))
    dim = len(d.select(vec).first()[0])
    mlp = MultilayerPerceptronClassifier(layers=[dim, *hidden, 2], maxIter=MAX_ITER, seed=42, labelCol=label)
    return mlp.fit(d)

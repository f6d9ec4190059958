"""Spark ML model queries. Results depend on iterative
optimisers, so these are rows-only checks (no oracle SQL); the invariants
(probabilities in [0, 1], reload gives equal predictions) are in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.operators import metrics as M
from lexiscope.operators import mlp
from lexiscope.operators import models as MD
from lexiscope.operators.terms import TermVectorizer
from lexiscope.plans.catalog import register
from lexiscope.session import checkpointed
from lexiscope.plans.q_sampling import partitions
from lexiscope.sources import fixtures as X
from lexiscope.sources import files as IO


def _splits(spark, sf_dir):
    """Train / test corpus; the split table is checkpointed (to the shared
    checkpoint folder) so iterative fits do not recompute the split plan."""
    p = checkpointed(partitions(spark, sf_dir).select("id", "text", "label", "split"))
    return p.where(F.col("split") == "train"), p.where(F.col("split") == "test")


def _baseline(name, calibrated=True):
    def q(spark, sf_dir):
        tr, te = _splits(spark, sf_dir)
        feats, clf = MD.fit_text_classifier(tr, name, calibrated=calibrated)
        return MD.score(feats, clf, te)
    q.__name__ = f"q_baseline_{name}"
    return q


register("baseline_linear_svc")(_baseline("linear_svc"))   # H1 (+ H6)
register("baseline_logreg")(_baseline("logreg"))            # H2
register("baseline_sgd")(_baseline("sgd"))                  # H3
register("baseline_nb")(_baseline("nb"))                    # H4


@register("calibrated_classifier")
def q_calibrated_classifier(spark, sf_dir):
    """H6: 5-fold sigmoid-calibrated linear SVM probabilities (unrounded)."""
    tr, te = _splits(spark, sf_dir)
    feats, clf = MD.fit_text_classifier(tr, "linear_svc", calibrated=True, folds=5)
    return MD.predict_proba(feats, clf, te).select("id", "prob")


def _task2(spark, sf_dir):
    from lexiscope.operators.sampling import stratified_split
    c = X.task2_corpus(spark, sf_dir).select("id", "text", "label")
    s = checkpointed(stratified_split(c, "label", 0.3))
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


@register("baseline_gbt")
def q_baseline_gbt(spark, sf_dir):
    """H5: gradient-boosted trees one-vs-rest on the 6-class task."""
    tr, te = _task2(spark, sf_dir)
    m = MD.fit_multiclass(tr, "gbt", 6)
    return m.transform(te).select("id", "label", F.col("prediction").cast("int").alias("pred"))


@register("baseline_multiclass")
def q_baseline_multiclass(spark, sf_dir):
    """H7: linear SVM and SGD (one-vs-rest), multinomial logistic regression
    and naive Bayes on the 6-class task -> per model accuracy and macro F1 on
    the test split."""
    tr, te = _task2(spark, sf_dir)
    # the terms, rows and tiles are the same for all models
    feats = TermVectorizer().fit(tr)
    x, y = feats.transform(tr), feats.transform(te)
    data = MD.class_training(x, 6)
    out = None
    for name in ("linear_svc", "logreg", "sgd", "nb"):
        m = MD.fit_multiclass(tr, name, 6, feats, x, data)
        p = m.stages[-1].transform(y).select("label", F.col("prediction").cast("int").alias("pred"))
        r = M.accuracy(p).crossJoin(M.f1_macro(p)).select(F.lit(name).alias("model"), "accuracy", "f1_macro")
        out = r if out is None else out.unionByName(r)
    data.release()
    return out


@register("score_baseline")
def q_score_baseline(spark, sf_dir):
    """H8 + A11: fit the calibrated default model (SGD), save the features and
    the classifier, load them back and score the test split -> (id, label)
    answers."""
    tr, te = _splits(spark, sf_dir)
    feats, clf = MD.fit_text_classifier(tr, "sgd")
    path = IO.scratch_path(spark, "model")
    from pyspark.ml import PipelineModel
    pm = PipelineModel([feats, clf])
    IO.save_model(pm, path)
    loaded = IO.load_model(path)
    return MD.score(loaded.stages[0], loaded.stages[1], te)


@register("model_persist")
def q_model_persist(spark, sf_dir):
    """Probabilities of a saved-and-reloaded calibrated model (nested
    stages) next to the original's (equal by construction; ``same`` is checked
    in tests)."""
    tr, te = _splits(spark, sf_dir)
    feats, clf = MD.fit_text_classifier(tr, "nb")
    from pyspark.ml import PipelineModel
    pm = PipelineModel([feats, clf])
    path = IO.scratch_path(spark, "model")
    IO.save_model(pm, path)
    a = MD.predict_proba(feats, clf, te).select("id", F.col("prob").alias("p1"))
    lm = IO.load_model(path)
    b = MD.predict_proba(lm.stages[0], lm.stages[1], te).select("id", F.col("prob").alias("p2"))
    return a.join(b, "id").select("id", "p1", "p2", (F.abs(F.col("p1") - F.col("p2")) < 1e-12).alias("same"))


@register("train_val_test_report")
def q_train_val_test_report(spark, sf_dir):
    """H9 + H13: models chosen by name, fitted on four fifths of the training
    rows, reported on those, on the validation fifth and on the test rows ->
    (model, split, metric, value)."""
    from lexiscope.operators.sampling import stratified_split
    tr, te = _splits(spark, sf_dir)
    tr = checkpointed(stratified_split(tr.drop("split"), "label", 0.2, names=("train", "val")))
    tr, va = tr.where("split = 'train'"), tr.where("split = 'val'")
    feats = TermVectorizer().fit(tr)
    sets = [(split, feats.transform(df)) for split, df in (("train", tr), ("val", va), ("test", te))]
    out = None
    for name in ("nb", "logreg"):
        clf = MD.classifier(name, calibrated=False).fit(sets[0][1])
        for split, df in sets:
            p = MD.with_probability(clf.transform(df)).select("label", (F.col("prob") > 0.5).cast("int").alias("pred"))
            r = M.accuracy(p).crossJoin(M.f1_macro(p)).selectExpr(
                f"'{name}' AS model", f"'{split}' AS split", "stack(2, 'accuracy', accuracy, 'f1_macro', f1_macro) AS (metric, value)")
            out = r if out is None else out.unionByName(r)
    return out


def graph_embeddings(spark, sf_dir, hops: int = 1):
    """Propagate node vectors over the document graph, mean-pool per
    document, attach the label -> (doc_id, vec, label)."""
    from lexiscope.operators.docvectors import propagated_pools
    from lexiscope.plans.q_graph import vector_stream
    pooled = vector_stream(spark, sf_dir, propagated_pools(hops, ["mean"]), "doc_id long, mean array<double>")
    pooled = pooled.withColumnRenamed("mean", "vec")
    lab = X.corpus(spark, sf_dir).select(F.col("id").alias("doc_id"), "label")
    return pooled.join(lab, "doc_id")


@register("graph_embedding_table")
def q_graph_embedding_table(spark, sf_dir):
    """Classifier input - pooled graph embedding + label per document."""
    return graph_embeddings(spark, sf_dir)


@register("graph_embedding_classifier")
def q_graph_embedding_classifier(spark, sf_dir):
    """Standardised graph embeddings + logistic regression; accuracy and
    macro F1 on a hash split."""
    from lexiscope.operators.sampling import stratified_split
    e = checkpointed(graph_embeddings(spark, sf_dir).withColumnRenamed("doc_id", "id"))
    s = checkpointed(stratified_split(e, "label", 0.2))
    tr, te = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    m, raw = MD.fit_embedding_classifier(tr, "logreg")
    from pyspark.ml.functions import array_to_vector
    p = m.transform(te.withColumn(raw, array_to_vector(F.col("vec")))).select(
        "label", F.col("prediction").cast("int").alias("pred"))
    return M.accuracy(p).crossJoin(M.f1_macro(p))


def _three_way(e):
    """``split`` train / val / test (60, 20, 20 percent of each label)."""
    from lexiscope.operators.sampling import stratified_split
    s = checkpointed(stratified_split(e, "label", 0.2, names=("rest", "test")))
    inner = stratified_split(s.where("split = 'rest'").drop("split"), "label", 0.25, names=("train", "val"))
    return checkpointed(inner.unionByName(s.where("split = 'test'")))


def _pooled(spark, sf_dir):
    """Mean node vector and label per document, with splits."""
    from lexiscope.plans.q_graph import pooled_vecs
    pooled = pooled_vecs(spark, sf_dir, "mean")
    lab = X.corpus(spark, sf_dir).select(F.col("id").alias("doc_id"), "label")
    # a split reads its rows several times: the vectors are written first
    return _three_way(checkpointed(pooled.join(lab, "doc_id").withColumnRenamed("doc_id", "id")))


def _fit_pooled(spark, rows):
    return mlp.train(rows, [200, 200], epochs=100, patience=15, batch=64, lr=1e-3, dropout=0.5, decay=1e-4,
                     folder=IO.scratch_path(spark, "epochs"))


@register("pooled_mlp")
def q_pooled_mlp(spark, sf_dir):
    """MLP (2 x 200 hidden) on mean-pooled node vectors, trained in
    epochs with early stopping -> predictions for the test documents."""
    rows = _pooled(spark, sf_dir)
    out = _fit_pooled(spark, rows).transform(rows.where("split = 'test'"))
    return out.select(F.col("id").alias("doc_id"), "label", F.col("prediction").alias("pred"))


@register("training_epochs")
def q_training_epochs(spark, sf_dir):
    """H13 + I16: the epochs of the H11 fit: per metric (loss, accuracy and
    macro F1 on train, val and test) the best value and its first epoch, the
    last epoch and its value."""
    model = _fit_pooled(spark, _pooled(spark, sf_dir))
    table = model.table(spark, "pooled_mlp")
    best = M.best_steps(table.where(~F.col("metric").endswith("loss")))
    loss = M.best_steps(table.where(F.col("metric").endswith("loss")).withColumn("value", -F.col("value")))
    loss = loss.withColumn("best_value", -F.col("best_value")).withColumn("last_value", -F.col("last_value"))
    return best.unionByName(loss).withColumn("kept_step", F.lit(model.best))


@register("graph_embedding_classifiers")
def q_graph_embedding_classifiers(spark, sf_dir):
    """Logistic regression, linear SVM, random forest and MLP (256-128)
    on standardised graph embeddings -> accuracy and macro F1 on test."""
    from pyspark.ml.functions import array_to_vector
    e = graph_embeddings(spark, sf_dir).withColumnRenamed("doc_id", "id")
    rows = _three_way(checkpointed(e))
    tr, te = rows.where("split <> 'test'"), rows.where("split = 'test'")
    out = None
    for kind in ("logreg", "svm", "rf", "mlp"):
        if kind == "mlp":
            p = mlp.train(rows, [256, 128], epochs=100, patience=10, batch=200, lr=1e-3, decay=1e-4).transform(te)
        else:
            m, raw = MD.fit_embedding_classifier(tr, kind)
            p = m.transform(te.withColumn(raw, array_to_vector(F.col("vec"))))
        p = p.select("label", F.col("prediction").cast("int").alias("pred"))
        r = M.accuracy(p).crossJoin(M.f1_macro(p)).select(F.lit(kind).alias("model"), "accuracy", "f1_macro")
        out = r if out is None else out.unionByName(r)
    return out


@register("score_corpus_graph")
def q_score_corpus_graph(spark, sf_dir):
    """A head fitted on the graph embeddings of the training documents,
    saved and loaded again, scores the documents it has not seen ->
    probability -> undecided band -> (id, label) answers."""
    from lexiscope.functions.scalar import decide
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rows = _three_way(checkpointed(graph_embeddings(spark, sf_dir).withColumnRenamed("doc_id", "id")))
    m, raw = MD.fit_embedding_classifier(rows.where("split = 'train'"), "logreg")
    path = IO.scratch_path(spark, "head")
    IO.save_model(m, path)
    unseen = rows.where("split <> 'train'").withColumn(raw, array_to_vector(F.col("vec")))
    out = IO.load_model(path).transform(unseen)
    return out.select("id", decide(vector_to_array(F.col("probability"))[1]).alias("label"))


@register("model_registry")
def q_model_registry(spark, sf_dir):
    """H9: a list of {algo, args} entries run in turn; each classifier is
    looked up by name and scored on the test split -> (model, args, accuracy)."""
    runs = [{"algo": "nb", "args": {}}, {"algo": "logreg", "args": {"c": 0.1}},
            {"algo": "sgd", "args": {"max_iter": 10}}]
    tr, te = _splits(spark, sf_dir)
    feats = TermVectorizer().fit(tr)
    x, y = feats.transform(tr), feats.transform(te)
    out = None
    for r in runs:
        m = MD.classifier(r["algo"], calibrated=False, **r["args"]).fit(x)
        p = m.transform(y).select("label", F.col("prediction").cast("int").alias("pred"))
        row = M.accuracy(p).select(F.lit(r["algo"]).alias("model"), F.lit(str(r["args"])).alias("args"), "accuracy")
        out = row if out is None else out.unionByName(row)
    return out

"""The streaming evaluator agrees with the batch counts once all files are in."""

import os
import tempfile

from pyspark.sql import functions as F

from lexiscope.operators import metrics as M
from lexiscope.sources import fixtures as X
from lexiscope.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def test_running_metrics_match_batch(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src = os.path.join(base, "in")
    ans = X.answers(spark, SF)
    # three files arriving one after the other
    for k in range(3):
        ans.where(F.col("id") % 3 == k).select(F.col("id").cast("string").alias("id"), "label") \
           .coalesce(1).write.json(os.path.join(src, f"part{k}"))
    stream = S.answer_stream(spark, os.path.join(src, "*"), max_files=1)
    q = S.start_running_metrics(stream, X.truth(spark, SF), "running_eval", os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = {(r.facet, r.value): r for r in spark.table("running_eval").collect()}
    j = M.with_facets(X.truth(spark, SF).select(F.col("id"), F.col("label").alias("t"), "source", "model", "genre")
                      .join(ans.select("id", F.col("label").alias("p")), "id").drop("id"))
    want = {(r.facet, r.value): r for r in M.binary_counts(j, ["facet", "value"]).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k].n, got[k].conf_11, got[k].conf_00) == (r.n, r.conf_11, r.conf_00)


def test_score_stream_matches_batch(spark):
    from lexiscope.operators import models as MD
    from lexiscope.plans.q_sampling import partitions
    from lexiscope.session import checkpointed
    base = tempfile.mkdtemp(prefix="score-", dir="/tmp")
    p = checkpointed(partitions(spark, SF).select("id", "text", "label", "split"))
    tr, te = p.where("split = 'train'"), p.where("split = 'test'")
    feats, clf = MD.fit_text_classifier(tr, "nb", calibrated=False)
    te.select(F.col("id").cast("string").alias("id"), "text").write.json(os.path.join(base, "in"))
    q = S.score_stream(S.text_stream(spark, os.path.join(base, "in")), feats, clf,
                       os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = {r.id: r.label for r in spark.read.schema("id STRING, label DOUBLE").json(os.path.join(base, "out")).collect()}
    want = {str(r.id): r.label for r in MD.score(feats, clf, te).collect()}
    assert got == want

"""TF-IDF: broadcast and shuffle-join paths agree; weights are L2-normalised."""

import math

from pyspark.sql import functions as F

from lexiscope.operators import features as FE


def test_tfidf_normalised(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (3, "c"), (3, "c")]
    toks = spark.createDataFrame(rows, "doc_id long, term string")
    got = {(r.doc_id, r.term): r.weight for r in FE.tfidf(toks, n_docs=3).collect()}
    for d in (1, 2, 3):
        assert abs(math.sqrt(sum(w * w for (dd, _), w in got.items() if dd == d)) - 1.0) < 1e-12
    # smooth idf by hand for doc 1: tf(a)=2, tf(b)=1, df(a)=2, df(b)=2, n=3
    idf = math.log(4 / 3) + 1
    wa, wb = 2 * idf, 1 * idf
    assert abs(got[(1, "a")] - wa / math.hypot(wa, wb)) < 1e-12


def test_vocab_top_k_and_alphabetical_index(spark):
    rows = [(d, t) for d in range(4) for t in ["x", "y"]] + [(0, "z"), (1, "z"), (0, "w")]
    toks = spark.createDataFrame(rows, "doc_id long, term string")
    v = FE.vocab(toks, 4, min_df=1, max_df=0.9, max_features=2).orderBy("idx").collect()
    # x and y are in every document (df 4 > 0.9 * 4): dropped; z (tf 2) beats w (tf 1)
    assert [(r.term, r.idx) for r in v] == [("w", 0), ("z", 1)]

"""Text hand cases (FIXTURES §3.3), graph cases (§3.4), answer files (§3.2)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators import graph as G
from lexiscope.sources import files as IO


def _apply(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_text_hand_cases(spark):
    vals = ["", "   ", "a  b", "<b>x</b>", "don't", "Café  Ñandú", "a_b"]
    assert _apply(spark, T.word_len, vals) == [0, 0, 2, 1, 1, 2, 1]
    assert _apply(spark, T.norm_blank, vals) == ["", "", "a b", "<b>x</b>", "don't", "Café Ñandú", "a_b"]
    assert _apply(spark, T.norm_html, ["<b>x</b> y", "a < b"]) == ["x y", "a < b"]
    assert _apply(spark, T.norm_apostrophe, ["don't", "rock`n"]) == ["dont", "rockn"]
    assert _apply(spark, T.norm_contractions, ["i'm  here", "", "can't stop"]) == ["i am here", "", "cannot stop"]
    assert _apply(spark, T.text_normalize, ["Don't <b>STOP</b>  now"]) == ["do not stop now"]
    assert _apply(spark, T.norm_special, ['x, (y) "z"!']) == ["x y z"]
    assert _apply(spark, T.norm_stopwords, ["The cat is on the mat ."]) == ["cat mat ."]
    toks = spark.createDataFrame([("Héllo, wörld_1 ok!",)], "x string").select(T.tokenize(F.col("x"))).first()[0]
    assert toks == ["héllo", ",", "wörld_1", "ok", "!"]


def _graph(spark, rows, directed=True):
    raw = spark.createDataFrame(rows, "doc_id long, sent_id int, i int, tok string")
    return G.build_graph(G.surface_annotate(raw), directed)


def test_graph_last_wins_and_subset(spark):
    rows = [(1, 0, 0, "x"), (1, 0, 1, "the"), (1, 0, 2, "x"), (1, 1, 0, "x"), (1, 1, 1, "the")]
    nodes, edges = _graph(spark, rows)
    ns = {r.node for r in nodes.collect()}
    for e in edges.collect():
        assert e.src in ns and e.dst in ns
    e = {(r.src, r.dst): (r.dep, r.dist) for r in edges.collect()}
    # x -> the appears in both sentences; the second sentence's attributes win
    assert e[("x_NOUN", "the_DET")] == ("det", 1.0)
    assert ("ROOT_0", "x_NOUN") in e


def test_graph_fallback_and_self_loop(spark):
    rows = [(1, 0, 0, "x"), (1, 0, 1, "x"), (2, 0, 0, "y")]
    nodes, edges = _graph(spark, rows)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    fn, fe = G.with_fallback(docs, nodes, edges)
    st = {r.doc_id: (r.n_nodes, r.n_edges) for r in G.graph_stats(fn, fe).collect()}
    assert st[3] == (2, 1)  # no tokens at all -> fallback graph
    assert st[1][1] == 2  # ROOT_0 -> x and the self-loop x -> x
    sym = G.symmetrize(edges.where("doc_id = 1")).collect()
    assert sum(1 for r in sym if r.src == r.dst) == 1


def test_token_with_underscore(spark):
    nodes, _ = _graph(spark, [(1, 0, 0, "a_b"), (1, 0, 1, "c")])
    tok = spark.createDataFrame([(1, 1, "a", 7)], "doc_id long, pos int, token string, vec_id long")
    vecs = spark.createDataFrame([(7, [1.0, 2.0])], "vec_id long, vec array<double>")
    nv = {r.node: r for r in G.node_vectors(nodes, tok, vecs, 2).collect()}
    assert nv["a_b_NOUN"].matched and nv["a_b_NOUN"].vec == [1.0, 2.0]  # word = text before the first '_'
    assert not nv["c_NOUN"].matched and nv["c_NOUN"].vec == [0.0, 0.0]


def _write(lines):
    d = tempfile.mkdtemp(prefix="answers-", dir="/tmp")
    p = os.path.join(d, "a.jsonl")
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_answer_file_rules(spark):
    p = _write(['{"id": "a", "label": 0.7}', "", '{"id": "b", "label": [true, false]}',
                '{"id": "c", "label": [false, true], "model": "m"}', '{"id": "a", "label": 0.2}'])
    got = {r.id: (r.label, r.model) for r in IO.load_answers(spark, p).collect()}
    assert got == {"a": (0.2, None), "b": (0.0, None), "c": (1.0, "m")}


@pytest.mark.parametrize("line", ['{"id": "x", "label": [true, true]}', '{"id": "x", "label": true}',
                                  '{"id": "x", "label": "0.7"}', '{"id": "x"}'])
def test_answer_file_errors(spark, line):
    with pytest.raises(Exception):
        IO.load_answers(spark, _write([line])).collect()


def test_evaluation_json_shape(spark):
    import json
    df = spark.createDataFrame([("all", "all", 3, None, 0.5, 0.6, None, 0.1, 0.3, 1, 0, 2, 0),
                                ("genre", "en", 3, None, 0.5, 0.6, None, 0.1, 0.3, 1, 0, 2, 0)],
                               "facet string, value string, n long, roc_auc double, brier double, c_at_1 double, "
                               "f1 double, f05u double, mean_score double, conf_00 long, conf_01 long, "
                               "conf_10 long, conf_11 long")
    d = json.loads(IO.evaluation_json(df).first()[0])
    assert d["roc-auc"] is None and d["c@1"] == 0.6 and d["confusion"] == [[1, 0], [2, 0]]
    assert d["_eval-genre"]["en"]["mean"] == 0.3

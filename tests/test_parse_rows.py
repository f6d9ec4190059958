"""Graphs of documents as rows: equal to those of the token table, and nothing
but the texts is shuffled."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lexiscope.operators import graph as G
from lexiscope.sources import fixtures as X

# gaps, a head outside the sentence, a node twice with other attributes, an
# empty sentence between, an unusable document, a null id
TOKENS = [(1, 0, 0, "a", "a", "DET", "ROOT", 0), (1, 0, 1, "B", "b", "NOUN", "dep", 0), (1, 0, 2, "b", "b", "NOUN", "obj", 0),
          (1, 2, 0, "a", "a", "DET", "ROOT", 0), (1, 2, 1, "b", "b", "NOUN", "det", 0),
          (2, 0, 3, "x", "x", "X", "dep", 7), (2, 0, 5, "y_z", "y", "X", "dep", 3), (2, 0, 7, "x", "x", "X", "dep", 9),
          (3, 0, 0, "q", "q", "X", "ROOT", 0), (None, 0, 0, "n", "n", "X", "ROOT", 0)]


def _tables(spark):
    t = spark.createDataFrame(TOKENS, "doc_id long, sent_id int, i int, text string, lemma string, pos string, dep string, head_i int")
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "doc_id long")
    sents = (t.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct(*t.columns[2:]))).alias("a"))
             .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "a"))).alias("sents")))
    d = docs.groupBy("doc_id").agg(F.count("*").alias("copies"))
    parses = d.join(sents.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "left").select(
        "doc_id", "copies", F.coalesce("sents", F.array().cast(sents.schema["sents"].dataType)).alias("sents"))
    return t, docs, parses


def _rows(df, *cols):
    return sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))


def test_rows_of_documents_equal_the_token_table(spark):
    t, docs, parses = _tables(spark)
    info = G.token_info(t)
    assert _rows(G.parse_info(parses), *info.columns) == _rows(info, *info.columns)
    edges = G.token_edges(info)
    assert _rows(G.parse_edges(parses), *edges.columns) == _rows(edges, *edges.columns)
    for directed in (True, False):
        n, e = G.build_graph(t, directed)
        g = G.parse_graph(parses, directed)
        assert _rows(G.rows_of(g, "nodes"), *n.columns) == _rows(n, *n.columns)
        assert _rows(G.rows_of(g, "edges"), *e.columns) == _rows(e, *e.columns)
        fn, fe = G.with_fallback(docs, n, e)
        f = G.parse_graph_with_fallback(parses, directed)
        assert _rows(G.rows_of(f, "nodes"), *n.columns) == _rows(fn, *n.columns)
        assert _rows(G.rows_of(f, "edges"), *e.columns) == _rows(fe, *e.columns)
    n, e = G.build_graph(t)
    st = G.graph_stats_with_fallback(docs, n, e)
    assert _rows(G.parse_stats(parses), *st.columns) == _rows(st, *st.columns)
    r = G.relation_frequency(e)
    assert _rows(G.parse_relation_frequency(G.with_graph(parses)), *r.columns) == _rows(r, *r.columns)


def test_texts_of_one_id_are_one_document(spark, tmp_path):
    rows = [(1, "a b\nc"), (1, "x b d\n\ne f"), (2, None), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t = X.tokens(spark, str(tmp_path))
    info = G.token_info(t)
    got = X.parses(spark, str(tmp_path))
    assert _rows(G.parse_info(got), *info.columns) == _rows(info, *info.columns)
    assert {r.doc_id: r.copies for r in got.collect()} == {1: 2, 2: 2, 3: 1}


@pytest.mark.parametrize("name", ["graph_edges", "compose_graph", "fallback_graph", "graph_stats"])
def test_only_the_texts_are_shuffled(spark, name):
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "SortAggregate" not in plan
    below = plan.split("collect_list")[-1]
    assert plan.count("partial_collect_list") == 1 and "Generate" not in below

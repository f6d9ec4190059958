"""Vectors streamed by blocks equal those of the joined rows, also with copies
of documents and of vectors, nulls and heads outside their sentence."""

from pyspark.sql import functions as F

from lexiscope.operators import docvectors as DV
from lexiscope.operators import graph as G


def _tables(spark):
    nodes = {1: ["ROOT_0", "a_X", "b_X", "b_Y", "c_d_X"], 2: ["ROOT_0", "a_X"], 3: ["DUMMY_NOUN", "FILLER_VERB"], None: ["DUMMY_NOUN"]}
    edges = {1: [("ROOT_0", "a_X"), ("a_X", "b_X"), ("b_X", "a_X"), ("", "b_Y"), ("b_X", "b_X")], 2: [("ROOT_0", "a_X")],
             3: [("DUMMY_NOUN", "FILLER_VERB")], None: [("DUMMY_NOUN", "DUMMY_NOUN")]}
    ids = {1: [(0, "", 1), (0, "", 1), (1, "a", 2), (2, "A", 3), (3, "b", 4), (4, "c", 9), (600, "a", 1)], 2: [(0, "", 5), (1, "a", 2)],
           3: [], None: [(0, "", 1), (1, "dummy", 2)]}
    g = spark.createDataFrame(
        [(k, [(n, "P") for n in nodes[k]], [(s, t, "dep", 1.0) for s, t in edges[k]], ids[k]) for k in nodes],
        "doc_id long, nodes array<struct<node: string, pos_tag: string>>, "
        "edges array<struct<src: string, dst: string, dep: string, dist: double>>, "
        "ids array<struct<pos: int, token: string, vec_id: long>>")
    v = spark.createDataFrame([(1, [1.0, 2.0]), (1, [0.5, 0.0]), (2, [4.0, -1.0]), (3, [0.0, 3.0]), (4, None), (5, [7.0, 7.0])],
                              "vec_id long, vec array<float>")
    toks = g.select("doc_id", F.explode("ids").alias("x")).select("doc_id", "x.*")
    return g, v, G.node_vectors(G.rows_of(g, "nodes"), toks, v, 2), G.rows_of(g, "edges")


def _rows(df):
    return sorted(str([[round(y, 9) for y in x] if isinstance(x, list) else x for x in r]) for r in df.collect())


def test_streams_equal_joined_rows(spark):
    g, v, nv, edges = _tables(spark)
    zeros = F.array_repeat(F.lit(0.0), 2)
    pair = "doc_id long, vec array<double>"
    for n_blocks in (1, 3):
        rows = DV.stream(g, v, 2, n_blocks, DV.node_rows, "doc_id long, node string, pos_tag string, vec array<double>")
        assert _rows(rows.select("doc_id", "node", "pos_tag", F.coalesce("vec", zeros), F.col("vec").isNotNull())) == _rows(nv)
        for how in ("mean", "max", "sum"):
            assert _rows(DV.stream(g, v, 2, n_blocks, DV.pooled(how), pair)) == _rows(G.pool(nv, how)), how
        at = nv.where("doc_id is not null")
        got = DV.stream(g, v, 2, n_blocks, DV.attended([0.5, -0.25]), pair).where("doc_id is not null")
        assert _rows(got) == _rows(G.attention_pool(at, [0.5, -0.25]))
        for hops in (1, 2):
            for directed in (True, False):
                want = G.propagate(nv.select("doc_id", "node", "vec"), edges, hops, directed)
                new = DV.stream(g, v, 2, n_blocks, DV.propagated(hops, directed), "doc_id long, node string, vec array<double>")
                assert _rows(new) == _rows(want), (hops, directed)


def test_no_vector_of_a_node_is_shuffled(spark):
    import __spark_entry__ as E
    for name in ("graph_pool", "gcn_propagate"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("MapInArrow")[0], plan


def test_documents_go_to_their_blocks_as_texts(spark):
    """Below the exchange by block a row holds a text, not a graph; the
    pooled vectors are written before they are split."""
    import __spark_entry__ as E
    plan = E.queries()["gcn_propagate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression", 1)
    assert "ROOT_0" in above and "ROOT_0" not in below, plan


def test_pooled_vectors_are_split_from_a_written_table(spark, monkeypatch):
    from lexiscope.plans import q_models
    seen = []
    monkeypatch.setattr(q_models, "_three_way", seen.append)
    q_models._pooled(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()

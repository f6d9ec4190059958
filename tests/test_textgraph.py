"""Graphs made of texts in Arrow batches equal those of the parsed rows."""

import pytest

from lexiscope.operators import graph as G
from lexiscope.operators import textgraph as TG
from lexiscope.sources import fixtures as X

# several texts of one id, no text, empty lines, digits and marks of other
# scripts, a character that is younger than the JVM's tables, a null id
ROWS = [(1, "a b\nc"), (1, "x b d\n\ne f"), (2, None), (2, None), (3, ""), (4, "Hello, WORLD_1 9 _ é ٣ the of\r\nand\n\n  i"),
        (None, "n n"), (None, "m"), (5, "x"), (6, "a a a\na b a"), (7, "b a\nc"), (7, "b\nc d c d"), (7, "z a"),
        (8, "ΑΣ İ ǅ 𝒳 ࡰx y\x85z\xa0w")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("size", [4, TG.PIECE_BYTES])
def test_graphs_of_texts_equal_those_of_parses(spark, folder, directed, size, monkeypatch):
    monkeypatch.setattr(TG, "PIECE_BYTES", size)
    texts, parses = X.grouped_texts(spark, folder), X.parses(spark, folder)
    for make in (G.parse_graph, G.parse_graph_with_fallback):
        got, want = make(texts, directed), make(parses, directed)
        for column in ("nodes", "edges"):
            assert _rows(G.rows_of(got, column)) == _rows(G.rows_of(want, column)), (make.__name__, column)
    assert _rows(G.parse_stats(texts)) == _rows(G.parse_stats(parses))


@pytest.mark.parametrize("name", ["graph_stats", "fallback_graph", "dep_edge_vector"])
def test_graphs_are_made_of_batches_of_texts(spark, folder, name):
    import __spark_entry__ as E
    plan = E.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan, plan


def test_edges_carry_their_whole_vector(spark, folder):
    import __spark_entry__ as E
    got = E.queries()["dep_edge_vector"](spark, folder).collect()
    assert {(r.doc_id, r.src, r.dst) for r in got} == {
        (r.doc_id, r.src, r.dst) for r in E.queries()["fallback_graph"](spark, folder).collect()}
    for r in got:
        assert r.vec == [round(((r.k * 7919 + j * 104729 + 62) % 1000) / 1000 - 0.5, 6) for j in range(32)]
        assert r.esum == pytest.approx(sum(r.vec), abs=1e-6)

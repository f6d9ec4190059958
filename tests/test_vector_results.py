"""Vector queries return the vectors, not only sums of them."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, column, width", [
    ("node_vectors_full", "vec", 64), ("pos_feature_concat_full", "vec", 96), ("dep_edge_vector_full", "vec", 32),
    ("project_vectors", "vec", 256)])
def test_whole_vectors(spark, name, column, width):
    got = E.queries()[name](spark, SF)
    assert {r[0] for r in got.selectExpr(f"size({column})").distinct().collect()} == {width}


def test_propagated_vectors_have_a_column_for_each_component(spark):
    got = E.queries()["gcn_propagate_full"](spark, SF)
    assert got.columns == ["doc_id", "node", *[f"v{j}" for j in range(64)]]

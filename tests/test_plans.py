"""Physical-plan checks: column pruning reaches the scan, and the token
self-join is a shuffle join (never a broadcast of the token table)."""

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_never_reads_text(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["evaluate_by_facet"](spark, SF))
    scans = [ln for ln in p.split("\n") if "FileScan parquet" in ln and "documents" in ln]
    assert scans and all("text:string" not in ln for ln in scans)
    assert any("ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in ln for ln in scans)


def test_token_join_is_not_broadcast(spark):
    from lexiscope.operators.graph import token_info
    from lexiscope.sources import fixtures as X
    p = _plan(token_info(X.tokens(spark, SF)))
    assert "BroadcastHashJoin" not in p


def test_token_info_gap_positions(spark):
    """Sentences with gaps in token positions take the join path."""
    from lexiscope.operators.graph import token_info
    rows = [(1, 0, 0, "a", "a", "NOUN", "ROOT", 0), (1, 0, 5, "b", "b", "NOUN", "dep", 0),
            (1, 0, 9, "c", "c", "NOUN", "dep", 5), (2, 0, 0, "x", "x", "NOUN", "ROOT", 0),
            (2, 0, 1, "y", "y", "NOUN", "dep", 0)]
    t = spark.createDataFrame(rows, "doc_id long, sent_id int, i int, text string, lemma string, pos string, "
                                    "dep string, head_i int")
    got = {(r.doc_id, r.i): r.head_text for r in token_info(t).collect()}
    assert got == {(1, 0): "a", (1, 5): "a", (1, 9): "b", (2, 0): "x", (2, 1): "x"}


def test_filters_pushed_to_scan(spark):
    from pyspark.sql import functions as F
    from lexiscope.sources.tables import table
    p = _plan(table(spark, SF, "labels").where(F.col("quality") == 1).select("doc_id"))
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in p

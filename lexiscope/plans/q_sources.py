"""Source / sink queries. Each writes data derived from the
driver tables below the session's checkpoint folder with the sink under
test, reads it back with the matching reader and returns the result, so the
round trip is checked against the oracle of the original rows."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lexiscope.operators import metrics as M
from lexiscope.plans.catalog import register
from lexiscope.plans.oracle import with_ctes
from lexiscope.plans.q_evaluation import _evaluate_sql
from lexiscope.plans.q_sampling import _PARTS, partitions
from lexiscope.sources import files as IO
from lexiscope.sources import fixtures as X
from lexiscope.sources.tables import table


@register("read_jsonl", with_ctes(["answers"]) + "SELECT CAST(id AS BIGINT) AS id, label FROM answers")
def q_read_jsonl(spark, sf_dir):
    """A1 + A6: answers written as JSON lines and read back with a schema."""
    path = IO.scratch_path(spark, "answers-jsonl")
    IO.write_jsonl(X.answers(spark, sf_dir), path)
    return IO.read_jsonl(spark, path, "id BIGINT, label DOUBLE").select("id", "label")


@register("read_csv", with_ctes(["corpus"]) + "SELECT id, text, label, genre, model FROM corpus")
def q_read_csv(spark, sf_dir):
    """A2: the corpus as CSV with a leading row-index column and multi-line
    quoted text, read back with an explicit schema; the index is dropped."""
    path = IO.scratch_path(spark, "corpus-csv")
    IO.write_csv(X.corpus(spark, sf_dir).select("id", "text", "label", "genre", "model"), path, index=True)
    return IO.read_csv(spark, path, IO.CORPUS_CSV_SCHEMA)


@register("load_answers", with_ctes(["truth"]) + "SELECT CAST(id AS VARCHAR) AS id, label, source, model, genre FROM truth")
def q_load_answers(spark, sf_dir):
    """A5: a truth file with two-element list labels ([human, machine]),
    facets as extra keys and a repeated id whose last line wins."""
    t = X.truth(spark, sf_dir)
    lines = t.select(F.to_json(F.struct(
        F.col("id").cast("string").alias("id"),
        F.array(F.col("label") == 0.0, F.col("label") == 1.0).alias("label"),
        "source", "model", "genre")).alias("value"))
    # an earlier, wrong line for some ids that the later line must override
    stale = t.where(F.col("id") % 5 == 0).select(F.to_json(F.struct(
        F.col("id").cast("string").alias("id"), F.lit(0.5).alias("label"))).alias("value"))
    path = IO.scratch_path(spark, "truth-jsonl")
    # earlier file first: the reader's order is (file path, block, line)
    stale.write.mode("overwrite").text(os.path.join(path, "a-earlier"))
    lines.write.mode("overwrite").text(os.path.join(path, "b-later"))
    return IO.load_answers(spark, os.path.join(path, "*"))


@register("write_partitions", _PARTS + "SELECT id, label, split FROM s_corpus")
def q_write_partitions(spark, sf_dir):
    """The partitioned corpus written as one dataset partitioned by split."""
    path = IO.scratch_path(spark, "partitions")
    IO.write_partitions(partitions(spark, sf_dir).select("id", "label", "split"), path)
    return IO.read_partitions(spark, path).select("id", "label", "split")


@register("write_predictions_csv", with_ctes(["answers"]) + "SELECT id, label FROM answers")
def q_write_predictions_csv(spark, sf_dir):
    """(id, label) predictions as CSV keyed by the real id."""
    path = IO.scratch_path(spark, "pred-csv")
    IO.write_predictions(X.answers(spark, sf_dir), path)
    return IO.read_csv(spark, path, "id BIGINT, label DOUBLE", index_col=None)


@register("write_evaluation", with_ctes(["scored"], [
    "allrows AS (SELECT 'all' AS facet, t, p FROM scored)", _evaluate_sql("allrows", "facet")]) + """
SELECT key, value FROM (
  SELECT 'roc_auc' AS key, roc_auc AS value FROM evaluated UNION ALL SELECT 'brier', brier FROM evaluated
  UNION ALL SELECT 'c_at_1', c_at_1 FROM evaluated UNION ALL SELECT 'f1', f1 FROM evaluated
  UNION ALL SELECT 'f05u', f05u FROM evaluated UNION ALL SELECT 'mean_score', mean_score FROM evaluated) u
WHERE value IS NOT NULL""")
def q_write_evaluation(spark, sf_dir):
    """Evaluation written as a JSON document and a flat key/value dump;
    the dump is read back."""
    res = M.evaluate(X.truth(spark, sf_dir), X.answers(spark, sf_dir))
    path = IO.scratch_path(spark, "evaluation")
    IO.write_evaluation(res, path)
    return IO.read_csv(spark, os.path.join(path, "flat"), "key STRING, value DOUBLE", index_col=None)


@register("feature_cache", with_ctes(["fnodes", "fedges"]) + """
SELECT n.doc_id, CAST(n.c AS BIGINT) AS n_nodes, CAST(coalesce(e.c, 0) AS BIGINT) AS n_edges
FROM (SELECT doc_id, count(*) AS c FROM fnodes GROUP BY doc_id) n
LEFT JOIN (SELECT doc_id, count(*) AS c FROM fedges GROUP BY doc_id) e ON n.doc_id = e.doc_id""")
def q_feature_cache(spark, sf_dir):
    """A10: graph tables saved as parquet and reloaded instead of rebuilt."""
    from lexiscope.operators.graph import graph_stats
    from lexiscope.plans.q_graph import graphs
    nodes, edges = graphs(spark, sf_dir)
    path = IO.scratch_path(spark, "features")
    IO.save_features(path, nodes=nodes, edges=edges)
    t = IO.load_features(spark, path, "nodes", "edges")
    return graph_stats(t["nodes"], t["edges"]).select("doc_id", "n_nodes", "n_edges")


@register("pairs_to_rows", """
SELECT id, text, label FROM (
  SELECT concat_ws('-', CAST(u.conv_id AS VARCHAR), CAST(u.turn AS VARCHAR)) AS id, u.text AS text1, a.text AS text2
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant') p,
LATERAL (VALUES (p.text1, 0), (p.text2, 1)) AS v(text, label)""")
def q_pairs_to_rows(spark, sf_dir):
    """Each (user turn, assistant reply) pair becomes two labelled rows."""
    return IO.pairs_to_rows(X.pair_corpus(spark, sf_dir))


@register("drop_null_text", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL")
def q_drop_null_text(spark, sf_dir):
    """Rows without text are dropped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return IO.drop_null_text(d).select("doc_id", "lang")


@register("project_columns", with_ctes(["corpus"]) + "SELECT text, label FROM corpus")
def q_project_columns(spark, sf_dir):
    """Keep text and label only (pruned at the scan)."""
    return X.corpus(spark, sf_dir).select("text", "label")


@register("write_jsonl", with_ctes(["truth"]) + "SELECT id, label, source, model, genre FROM truth")
def q_write_jsonl(spark, sf_dir):
    """The truth table written as JSON lines (one object per line) and
    read back with an explicit schema."""
    path = IO.scratch_path(spark, "truth-jsonl")
    IO.write_jsonl(X.truth(spark, sf_dir), path)
    return IO.read_jsonl(spark, path, "id BIGINT, label DOUBLE, source STRING, model STRING, genre STRING")

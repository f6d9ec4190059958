"""Descriptive and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions.text import word_len
from lexiscope.operators import lookups as L
from lexiscope.operators import profile as P
from lexiscope.plans.catalog import register
from lexiscope.plans.q_sampling import _PARTS, partitions
from lexiscope.plans.q_text import _LABELS_SQL, _d_word_len, label_names
from lexiscope.sources import fixtures as X

_WL = f"{_d_word_len('text')}"


@register("profile", _PARTS + """
SELECT split, CAST(count(*) AS BIGINT) AS rows, u.col_name, u.dtype, CAST(u.non_null AS BIGINT) AS non_null FROM (
  SELECT split, count(*) AS n, count(id) AS c_id, count(text) AS c_text, count(label) AS c_label,
         count(genre) AS c_genre, count(source) AS c_source, count(model) AS c_model
  FROM s_corpus GROUP BY split) a,
LATERAL (VALUES ('id', 'bigint', c_id), ('text', 'string', c_text), ('label', 'int', c_label),
                ('genre', 'string', c_genre), ('source', 'string', c_source), ('model', 'string', c_model))
  AS u(col_name, dtype, non_null)
GROUP BY split, u.col_name, u.dtype, u.non_null, n""".replace("CAST(count(*) AS BIGINT) AS rows", "CAST(n AS BIGINT) AS rows"))
def q_profile(spark, sf_dir):
    """Per split rows and per column non-null count and type."""
    return P.profile(partitions(spark, sf_dir))


_VC_SQL = _PARTS + """, long AS (
  SELECT split, 'label' AS col_name, CAST(label AS VARCHAR) AS value FROM s_corpus
  UNION ALL SELECT split, 'genre', genre FROM s_corpus
  UNION ALL SELECT split, 'model', model FROM s_corpus)"""


@register("value_counts", _VC_SQL + "\nSELECT split, col_name, value, count(*) AS n FROM long GROUP BY split, col_name, value")
def q_value_counts(spark, sf_dir):
    """Counts of label, genre and model per split."""
    return P.value_counts(partitions(spark, sf_dir), ["label", "genre", "model"])


@register("value_shares", _VC_SQL + """
SELECT split, col_name, value, n, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY split, col_name) AS DOUBLE), 9) AS share
FROM (SELECT split, col_name, value, count(*) AS n FROM long GROUP BY split, col_name, value) c""")
def q_value_shares(spark, sf_dir):
    """D3: D2 as fractions of the split."""
    s = P.value_shares(partitions(spark, sf_dir), ["label", "genre", "model"])
    return s.withColumn("share", F.round("share", 9))


@register("counts_by_genre_model", _PARTS + "SELECT split, genre, model, count(*) AS n FROM s_corpus GROUP BY split, genre, model")
def q_counts_by_genre_model(spark, sf_dir):
    """Model counts within genre per split."""
    return P.counts_within(partitions(spark, sf_dir), "genre", "model")


@register("counts_by_genre_label", _PARTS + "SELECT split, genre, label, count(*) AS n FROM s_corpus GROUP BY split, genre, label")
def q_counts_by_genre_label(spark, sf_dir):
    """Label counts within genre per split."""
    return P.counts_within(partitions(spark, sf_dir), "genre", "label")


@register("label_by_split_pivot", _PARTS + """
SELECT split, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS label_0,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS label_1 FROM s_corpus GROUP BY split""")
def q_label_by_split_pivot(spark, sf_dir):
    """Split x label count matrix."""
    return P.label_by_split(partitions(spark, sf_dir))


@register("doc_length_stats", _PARTS + f"""
SELECT split, min(wl) AS min_len, max(wl) AS max_len, CAST(floor(avg(wl)) AS BIGINT) AS mean_len
FROM (SELECT split, {_WL} AS wl FROM s_corpus) x GROUP BY split""")
def q_doc_length_stats(spark, sf_dir):
    """Min / max / integer mean of word_len per split."""
    p = partitions(spark, sf_dir).select("split", word_len(F.col("text")).alias("word_len"))
    return P.length_stats(p)


@register("doc_length_by_class", _PARTS + f"""
SELECT split, label, min(wl) AS min_len, max(wl) AS max_len, CAST(floor(avg(wl)) AS BIGINT) AS mean_len
FROM (SELECT split, label, {_WL} AS wl FROM s_corpus) x GROUP BY GROUPING SETS ((split), (split, label))""")
def q_doc_length_by_class(spark, sf_dir):
    """D7 per split and per (split, label), one pass."""
    p = partitions(spark, sf_dir).select("split", "label", word_len(F.col("text")).alias("word_len"))
    return P.length_stats_by_class(p)


@register("label_dictionary", f"""
SELECT DISTINCT ln.label_text, ln.label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN {_LABELS_SQL} ON CAST(d.doc_id % 6 AS INTEGER) = ln.label""")
def q_label_dictionary(spark, sf_dir):
    """Distinct (label_text, label) of the 6-class corpus."""
    c = X.task2_corpus(spark, sf_dir).select("label")
    return c.join(F.broadcast(label_names(spark)), "label").select("label_text", "label").distinct()


@register("sample_document", _PARTS.replace("WITH ", "WITH ", 1) + """
SELECT label, arg_min(id, md5(concat_ws('|', '42', CAST(id AS VARCHAR)))) AS id FROM s_corpus GROUP BY label""")
def q_sample_document(spark, sf_dir):
    """One document per class (first in hash order)."""
    return P.sample_document(partitions(spark, sf_dir))


@register("pred_label_counts", _PARTS.split("c_corpus AS")[0].rstrip().rstrip(",") + """,
answers AS (
  SELECT id, CAST(CASE WHEN abs(p - 0.5) <= 0.05 THEN 0.5 ELSE round(p, 4) END AS DOUBLE) AS label
  FROM (SELECT id, CAST((id * 7919 + 13) % 1000 + 400 * label AS DOUBLE) / 1399.0 AS p
        FROM corpus WHERE id % 17 <> 0) q),
pr AS (SELECT c.label, CASE WHEN coalesce(a.label, 0.5) > 0.5 THEN 1 ELSE 0 END AS pred
       FROM corpus c LEFT JOIN answers a ON c.id = a.id)
SELECT 'pred' AS kind, pred AS label, count(*) AS n FROM pr GROUP BY pred
UNION ALL SELECT 'true', label, count(*) FROM pr GROUP BY label""")
def q_pred_label_counts(spark, sf_dir):
    """Counts of predicted (score > 0.5) and true labels."""
    from lexiscope.operators.metrics import join_answers
    j = join_answers(X.truth(spark, sf_dir), X.answers(spark, sf_dir))
    j = j.select(F.col("t").cast("int").alias("label"), F.when(F.col("p") > 0.5, 1).otherwise(0).alias("pred"))
    return P.pred_label_counts(j)


@register("facet_ids", _PARTS + """
SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS fid
FROM (SELECT DISTINCT genre AS value FROM s_corpus WHERE split = 'train' AND genre IS NOT NULL) d
UNION ALL SELECT 'unknown', CAST(count(DISTINCT genre) AS INTEGER) FROM s_corpus WHERE split = 'train'""")
def q_facet_ids(spark, sf_dir):
    """Genre -> id over the training split, plus 'unknown'."""
    p = partitions(spark, sf_dir)
    return L.facet_ids(p.where(F.col("split") == "train"), "genre")


@register("encode_facet", _PARTS + """,
ids AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS fid
        FROM (SELECT DISTINCT source AS value FROM s_corpus WHERE split = 'train' AND source <> 'src3') d)
SELECT s.id, coalesce(i.fid, CAST((SELECT count(*) FROM ids) AS INTEGER)) AS fid
FROM s_corpus s LEFT JOIN ids i ON s.source = i.value WHERE s.split = 'test'""")
def q_encode_facet(spark, sf_dir):
    """Test rows encoded with ids learnt on training rows; a source left
    out of training (src3) falls back to 'unknown'."""
    p = partitions(spark, sf_dir)
    ids = L.facet_ids(p.where((F.col("split") == "train") & (F.col("source") != "src3")), "source")
    return L.encode_facet(p.where(F.col("split") == "test").select("id", "source"), ids, "source").select("id", "fid")


@register("attach_prediction_id", _PARTS.split("c_corpus AS")[0].rstrip().rstrip(",") + """,
answers AS (
  SELECT id, CAST(CASE WHEN abs(p - 0.5) <= 0.05 THEN 0.5 ELSE round(p, 4) END AS DOUBLE) AS label
  FROM (SELECT id, CAST((id * 7919 + 13) % 1000 + 400 * label AS DOUBLE) / 1399.0 AS p
        FROM corpus WHERE id % 17 <> 0) q)
SELECT a.id, a.label AS p, c.model, c.genre FROM answers a JOIN corpus c ON a.id = c.id""")
def q_attach_prediction_id(spark, sf_dir):
    """E5: predictions joined to their documents by id (no positional zip)."""
    c = X.corpus(spark, sf_dir).select("id", "model", "genre")
    return X.answers(spark, sf_dir).select("id", F.col("label").alias("p")).join(c, "id")

"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.operators import metrics as M
from lexiscope.plans.catalog import register
from lexiscope.plans.oracle import with_ctes
from lexiscope.sources import fixtures as X

_D = "CAST({} AS DOUBLE)".format

_COUNTS_SQL = """
  count(*) AS n,
  sum(CASE WHEN p = 0.5 THEN 1 ELSE 0 END) AS nu,
  sum(CASE WHEN p <> 0.5 AND t = (CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) THEN 1 ELSE 0 END) AS nc,
  sum(CASE WHEN t = 1 AND p > 0.5 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN t = 0 AND p > 0.5 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN t = 1 AND p <= 0.5 THEN 1 ELSE 0 END) AS fn_f1,
  sum(CASE WHEN t = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS fn,
  sum((least(greatest(p, 0.0), 1.0) - t) * (least(greatest(p, 0.0), 1.0) - t)) AS sq,
  sum(CASE WHEN t = 0 AND p < 0.5 THEN 1 ELSE 0 END) AS conf_00,
  sum(CASE WHEN t = 0 AND p >= 0.5 THEN 1 ELSE 0 END) AS conf_01,
  sum(CASE WHEN t = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS conf_10,
  sum(CASE WHEN t = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS conf_11,
  sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) AS npos,
  sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS nneg,
  sum(CASE WHEN t NOT IN (0, 1) THEN 1 ELSE 0 END) AS noth,
  sum(CASE WHEN t = 1 THEN r + (c - 1) / 2.0 ELSE 0 END) AS srank"""

_METRICS_SQL = """
  CASE WHEN npos > 0 AND nneg > 0 AND noth = 0
       THEN (CAST(srank AS DOUBLE) - CAST(npos AS DOUBLE) * (CAST(npos AS DOUBLE) + 1.0) / 2.0)
            / (CAST(npos AS DOUBLE) * CAST(nneg AS DOUBLE)) END AS roc_auc,
  1.0 - sq / CAST(n AS DOUBLE) AS brier,
  (1.0 / CAST(n AS DOUBLE)) * (CAST(nc AS DOUBLE) + (CAST(nu AS DOUBLE) * CAST(nc AS DOUBLE) / CAST(n AS DOUBLE))) AS c_at_1,
  CASE WHEN tp + fp + fn_f1 > 0 THEN CAST(tp AS DOUBLE) * 2.0 / (CAST(tp AS DOUBLE) * 2.0 + CAST(fp AS DOUBLE) + CAST(fn_f1 AS DOUBLE)) END AS f1,
  CASE WHEN CAST(tp AS DOUBLE) * 1.25 + CAST(fn + nu AS DOUBLE) * 0.25 + CAST(fp AS DOUBLE) <> 0.0
       THEN CAST(tp AS DOUBLE) * 1.25 / (CAST(tp AS DOUBLE) * 1.25 + CAST(fn + nu AS DOUBLE) * 0.25 + CAST(fp AS DOUBLE)) END AS f05u"""


def _evaluate_sql(source: str, by: str) -> str:
    """SQL of I7 over relation ``source(<by>, t, p)`` grouped by ``by``."""
    return f"""counts AS (
  SELECT {by}, {_COUNTS_SQL}
  FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) AS r,
               count(*) OVER (PARTITION BY {by}, p) AS c FROM {source}) x
  GROUP BY {by}),
unrounded AS (
  SELECT {by}, n, {_METRICS_SQL},
         CAST(conf_00 AS BIGINT) AS conf_00, CAST(conf_01 AS BIGINT) AS conf_01,
         CAST(conf_10 AS BIGINT) AS conf_10, CAST(conf_11 AS BIGINT) AS conf_11
  FROM counts),
evaluated AS (
  SELECT {by}, CAST(n AS BIGINT) AS n, round(roc_auc, 3) AS roc_auc, round(brier, 3) AS brier,
         round(c_at_1, 3) AS c_at_1, round(f1, 3) AS f1, round(f05u, 3) AS f05u,
         round((coalesce(roc_auc, 0.0) + brier + c_at_1 + coalesce(f1, 0.0) + coalesce(f05u, 0.0)) / 5.0, 3) AS mean_score,
         conf_00, conf_01, conf_10, conf_11
  FROM unrounded)"""


@register("evaluate_by_facet", with_ctes(["faceted"], [_evaluate_sql("faceted", "facet, value")])
          + "SELECT * FROM evaluated")
def q_evaluate_by_facet(spark, sf_dir):
    """I7 + I8 (flagship): all five metrics, their mean and the confusion
    cells, overall and per source / model / genre."""
    return M.evaluate(X.truth(spark, sf_dir), X.answers(spark, sf_dir))


@register("evaluate_all", with_ctes(["scored"], [
    "allrows AS (SELECT 'all' AS facet, t, p FROM scored)", _evaluate_sql("allrows", "facet")])
    + "SELECT * FROM evaluated")
def q_evaluate_all(spark, sf_dir):
    j = M.join_answers(X.truth(spark, sf_dir), X.answers(spark, sf_dir))
    return M.evaluate_scored(j.withColumn("facet", F.lit("all")), ["facet"])


@register("roc_auc", with_ctes(["faceted"]) + """
SELECT facet, value,
  round(CASE WHEN sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) > 0
       THEN (sum(CASE WHEN t = 1 THEN r + (c - 1) / 2.0 ELSE 0 END)
             - CAST(sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) AS DOUBLE) * (CAST(sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) AS DOUBLE) + 1.0) / 2.0)
            / (CAST(sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) AS DOUBLE) * CAST(sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS DOUBLE)) END, 9) AS roc_auc
FROM (SELECT *, rank() OVER (PARTITION BY facet, value ORDER BY p) AS r,
             count(*) OVER (PARTITION BY facet, value, p) AS c FROM faceted) x
GROUP BY facet, value""")
def q_roc_auc(spark, sf_dir):
    """Exact AUC per facet value, unrounded metric shown to 9 digits."""
    j = M.with_facets(M.join_answers(X.truth(spark, sf_dir), X.answers(spark, sf_dir)))
    a = M.roc_auc(j, ["facet", "value"])
    return a.select("facet", "value", F.round("roc_auc", 9).alias("roc_auc"))


@register("binary_metrics", with_ctes(["faceted"]) + f"""
SELECT facet, value, CAST(count(*) AS BIGINT) AS n,
  round(1.0 - sum((least(greatest(p, 0.0), 1.0) - t) * (least(greatest(p, 0.0), 1.0) - t)) / CAST(count(*) AS DOUBLE), 9) AS brier,
  CAST(sum(CASE WHEN p = 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS nu,
  CAST(sum(CASE WHEN p <> 0.5 AND t = (CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) THEN 1 ELSE 0 END) AS BIGINT) AS nc,
  CAST(sum(CASE WHEN t = 1 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN t = 0 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN t = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM faceted GROUP BY facet, value""")
def q_binary_metrics(spark, sf_dir):
    """I2-I6 building blocks: the conditional counts behind c@1, F1, F0.5u,
    Brier and the confusion matrix, per facet value."""
    j = M.with_facets(M.join_answers(X.truth(spark, sf_dir), X.answers(spark, sf_dir)))
    c = M.binary_counts(j, ["facet", "value"])
    return c.select("facet", "value", "n",
                    F.round(F.lit(1.0) - F.col("sq") / F.col("n").cast("double"), 9).alias("brier"),
                    "nu", "nc", "tp", "fp", "fn")


@register("join_answers", with_ctes(["scored"]) + "SELECT id, t, p FROM scored")
def q_join_answers(spark, sf_dir):
    """Every truth row with its answer, 0.5 where missing."""
    return M.join_answers(X.truth(spark, sf_dir), X.answers(spark, sf_dir)).select("id", "t", "p")


@register("check_coverage", with_ctes(["truth", "answers"]) + """
SELECT (SELECT count(*) FROM answers a WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.id = a.id)) AS n_unknown,
       (SELECT count(*) FROM answers) AS n_pred, (SELECT count(*) FROM truth) AS n_truth""")
def q_check_coverage(spark, sf_dir):
    """Answers without a truth row and the two sizes."""
    return M.uncovered(X.truth(spark, sf_dir), X.answers(spark, sf_dir))


_OFFSET_SQL = with_ctes(["scored"], ["""stats AS (
  SELECT min(p) AS pmin, max(p) AS pmax, count(*) AS n, sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS nneg,
         -(max(p) - 0.49) AS start, 0.51 - min(p) AS stop FROM scored)""",
    """offs AS (
  SELECT k, CASE WHEN k = 999 THEN stop ELSE CAST(k AS DOUBLE) * ((stop - start) / 999.0) + start END AS o
  FROM stats, range(1000) r(k))""",
    """base AS (
  SELECT (1.0 / CAST(count(*) AS DOUBLE)) * (CAST(sum(CASE WHEN p <> 0.5 AND t = (CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) THEN 1 ELSE 0 END) AS DOUBLE)
         + (CAST(sum(CASE WHEN p = 0.5 THEN 1 ELSE 0 END) AS DOUBLE) * CAST(sum(CASE WHEN p <> 0.5 AND t = (CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE))) AS base
  FROM scored)""",
    """per_k AS (
  SELECT k, o, CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(CASE WHEN p + o = 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS nu,
         CAST(sum(CASE WHEN p + o <> 0.5 AND t = (CASE WHEN p + o > 0.5 THEN 1.0 ELSE 0.0 END) THEN 1 ELSE 0 END) AS DOUBLE) AS nc
  FROM scored, offs GROUP BY k, o)""",
    """scores AS (
  SELECT k, o, (1.0 / n) * (nc + (nu * nc / n)) AS score, base FROM per_k, base)""",
    """runs AS (
  SELECT *, greatest(base, coalesce(max(score) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base)) AS best_before
  FROM scores)""",
    """stopk AS (
  SELECT min(k) AS stop_k FROM runs WHERE best_before > base AND score < best_before - 0.01)""",
    """live AS (SELECT r.* FROM runs r, stopk s WHERE s.stop_k IS NULL OR r.k < s.stop_k)"""])


@register("optimize_offset", _OFFSET_SQL + """
SELECT round(coalesce((SELECT o FROM live WHERE score > base ORDER BY score DESC, k LIMIT 1), 0.0), 9) AS best_offset,
       round(greatest((SELECT max(score) FROM live), (SELECT base FROM base)), 9) AS best_c_at_1,
       round((SELECT base FROM base), 9) AS base_c_at_1""")
def q_optimize_offset(spark, sf_dir):
    """The operating-point search (first strictly better c@1, stop rule)."""
    j = M.join_answers(X.truth(spark, sf_dir), X.answers(spark, sf_dir))
    b = M.best_offset(j)
    return b.select(*[F.round(c, 9).alias(c) for c in b.columns])


@register("evaluate_with_offset", _OFFSET_SQL.replace("WITH ", "WITH ", 1).rstrip() + """,
bo AS (SELECT coalesce((SELECT o FROM live WHERE score > base ORDER BY score DESC, k LIMIT 1), 0.0) AS off),
shifted AS (SELECT 'all' AS facet, 'all' AS value, t, p + off AS p FROM scored, bo
  UNION ALL SELECT 'source', source, t, p + off FROM scored, bo
  UNION ALL SELECT 'model', model, t, p + off FROM scored, bo
  UNION ALL SELECT 'genre', genre, t, p + off FROM scored, bo),
""" + _evaluate_sql("shifted", "facet, value") + "\nSELECT * FROM evaluated")
def q_evaluate_with_offset(spark, sf_dir):
    """I9 applied: evaluation after shifting every score by the best offset."""
    truth, ans = X.truth(spark, sf_dir), X.answers(spark, sf_dir)
    off = M.best_offset(M.join_answers(truth, ans)).select("best_offset")
    j = M.join_answers(truth, ans).crossJoin(F.broadcast(off))  # one-row side
    j = j.withColumn("p", F.col("p") + F.col("best_offset")).drop("best_offset")
    return M.evaluate_scored(M.with_facets(j), ["facet", "value"])


def _faceted(spark, sf_dir):
    return M.with_facets(M.join_answers(X.truth(spark, sf_dir), X.answers(spark, sf_dir)))


def _metric_sql(expr: str, name: str) -> str:
    """One metric per facet value, unrounded metric shown to 9 digits."""
    return with_ctes(["faceted"]) + f"""
SELECT facet, value, round({expr}, 9) AS {name} FROM (
  SELECT facet, value, {_COUNTS_SQL.replace("sum(CASE WHEN t = 1 THEN r + (c - 1) / 2.0 ELSE 0 END) AS srank", "0 AS srank")}
  FROM (SELECT *, 0 AS r, 0 AS c FROM faceted) x GROUP BY facet, value) s"""


def _metric_query(name: str, col: str):
    def q(spark, sf_dir):
        c = M.binary_counts(_faceted(spark, sf_dir), ["facet", "value"])
        m = c.selectExpr("facet", "value", *M._METRICS)
        return m.select("facet", "value", F.round(col, 9).alias(name))
    q.__name__ = f"q_{name}"
    return q


register("c_at_1", _metric_sql(
    "(1.0 / CAST(n AS DOUBLE)) * (CAST(nc AS DOUBLE) + (CAST(nu AS DOUBLE) * CAST(nc AS DOUBLE) / CAST(n AS DOUBLE)))",
    "c_at_1"))(_metric_query("c_at_1", "c_at_1"))                                  # I2
register("f1_binary", _metric_sql(
    "CASE WHEN tp + fp + fn_f1 > 0 THEN CAST(tp AS DOUBLE) * 2.0 / (CAST(tp AS DOUBLE) * 2.0 + CAST(fp AS DOUBLE) + CAST(fn_f1 AS DOUBLE)) END",
    "f1_binary"))(_metric_query("f1_binary", "f1"))                               # I3
register("f05u", _metric_sql(
    "CASE WHEN CAST(tp AS DOUBLE) * 1.25 + CAST(fn + nu AS DOUBLE) * 0.25 + CAST(fp AS DOUBLE) <> 0.0 "
    "THEN CAST(tp AS DOUBLE) * 1.25 / (CAST(tp AS DOUBLE) * 1.25 + CAST(fn + nu AS DOUBLE) * 0.25 + CAST(fp AS DOUBLE)) END",
    "f05u"))(_metric_query("f05u", "f05u"))                                       # I4
register("brier", _metric_sql("1.0 - sq / CAST(n AS DOUBLE)", "brier"))(_metric_query("brier", "brier"))  # I5


@register("confusion", with_ctes(["faceted"]) + """
SELECT facet, value,
  CAST(sum(CASE WHEN t = 0 AND p < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS conf_00,
  CAST(sum(CASE WHEN t = 0 AND p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS conf_01,
  CAST(sum(CASE WHEN t = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS conf_10,
  CAST(sum(CASE WHEN t = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS conf_11
FROM faceted GROUP BY facet, value""")
def q_confusion(spark, sf_dir):
    """2x2 confusion per facet value (rows truth, prediction p >= 0.5)."""
    c = M.binary_counts(_faceted(spark, sf_dir), ["facet", "value"])
    return c.select("facet", "value", *M.CONFUSION_COLUMNS)

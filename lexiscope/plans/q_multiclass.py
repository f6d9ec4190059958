"""Multi-class metric queries on the 6-class corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.operators import metrics as M
from lexiscope.plans.catalog import register
from lexiscope.plans.oracle import with_ctes
from lexiscope.sources import fixtures as X

_CLASS_SQL = with_ctes(["t2pred"], ["""tc AS (SELECT label AS cls, count(*) AS support, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS tp
                                  FROM t2pred GROUP BY label)""",
                                    "pc AS (SELECT pred AS cls, count(*) AS npred FROM t2pred GROUP BY pred)",
                                    """cc AS (SELECT coalesce(tc.cls, pc.cls) AS cls, coalesce(tp, 0) AS tp,
                                         coalesce(npred, 0) - coalesce(tp, 0) AS fp, coalesce(support, 0) - coalesce(tp, 0) AS fn,
                                         coalesce(support, 0) AS support
                                  FROM tc FULL OUTER JOIN pc ON tc.cls = pc.cls)""",
                                    """prf AS (SELECT cls, tp, fp, fn, support,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(tp AS DOUBLE) * 2.0 / (CAST(tp AS DOUBLE) * 2.0 + CAST(fp AS DOUBLE) + CAST(fn AS DOUBLE)) ELSE 0.0 END AS f1
  FROM cc)"""])


@register("accuracy", with_ctes(["t2pred"]) + """
SELECT language, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM t2pred GROUP BY language""")
def q_accuracy(spark, sf_dir):
    """Share of correct predictions per language."""
    a = M.accuracy(X.task2_predictions(spark, sf_dir), by=["language"])
    return a.select("language", F.round("accuracy", 9).alias("accuracy"))


@register("f1_macro", _CLASS_SQL + "SELECT round(avg(f1), 9) AS f1_macro FROM prf")
def q_f1_macro(spark, sf_dir):
    """Unweighted mean of per-class F1 over classes in truth or prediction."""
    f = M.f1_macro(X.task2_predictions(spark, sf_dir))
    return f.select(F.round("f1_macro", 9).alias("f1_macro"))


@register("f1_micro", _CLASS_SQL + "SELECT round(CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE), 9) AS f1_micro FROM prf")
def q_f1_micro(spark, sf_dir):
    """Micro F1 (equals accuracy for single-label data)."""
    c = M.class_counts(X.task2_predictions(spark, sf_dir))
    return c.agg((F.sum("tp") / F.sum("support")).alias("f")).select(F.round("f", 9).alias("f1_micro"))


@register("classification_report", _CLASS_SQL + """
SELECT CAST(cls AS VARCHAR) AS row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM prf
UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM (
  SELECT CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS a, CAST(sum(support) AS BIGINT) AS n FROM prf) s
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf""")
def q_classification_report(spark, sf_dir):
    """Per-class precision / recall / F1 / support with the averages."""
    return M.classification_report(X.task2_predictions(spark, sf_dir))


@register("confusion_long", with_ctes(["t2pred"]) + "SELECT label AS truth, pred, count(*) AS n FROM t2pred GROUP BY label, pred")
def q_confusion_long(spark, sf_dir):
    """(truth, pred, n) counts."""
    return M.confusion_long(X.task2_predictions(spark, sf_dir))


@register("cross_entropy", with_ctes(["t2pred"]) + """
SELECT language, round(avg(-ln(exp(logits[label + 1] - list_max(logits)) / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))), 9) AS cross_entropy
FROM t2pred GROUP BY language""")
def q_cross_entropy(spark, sf_dir):
    """Mean negative log-likelihood of the true class per language."""
    c = M.cross_entropy(X.task2_predictions(spark, sf_dir), by=["language"])
    return c.select("language", F.round("cross_entropy", 9).alias("cross_entropy"))


@register("best_epoch_metrics", with_ctes(["t2pred"], ["""mt AS (
  SELECT language AS run, CAST(id % 10 AS INTEGER) AS step, 'accuracy' AS metric,
         avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS value
  FROM t2pred GROUP BY language, id % 10)"""]) + """
SELECT run, metric, round(mv, 9) AS best_value, min(CASE WHEN value = mv THEN step END) AS best_step,
       max(step) AS last_step, round(arg_max(value, step), 9) AS last_value
FROM (SELECT *, max(value) OVER (PARTITION BY run, metric) AS mv FROM mt) x GROUP BY run, metric, mv""")
def q_best_epoch_metrics(spark, sf_dir):
    """I16: best value and its first step, last step and its value, per run
    and metric, over a metrics table (here: accuracy per language over ten
    id slices used as steps)."""
    p = X.task2_predictions(spark, sf_dir)
    mt = p.groupBy(F.col("language").alias("run"), (F.col("id") % 10).cast("int").alias("step")).agg(
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("value")).withColumn("metric", F.lit("accuracy"))
    b = M.best_steps(mt)
    return b.select("run", "metric", F.round("best_value", 9).alias("best_value"), "best_step", "last_step",
                    F.round("last_value", 9).alias("last_value"))

"""Evaluation metrics as aggregates.

Input convention: one row per problem with truth ``t`` (0/1 as DOUBLE) and
score ``p``; ``p == 0.5`` exactly means unanswered. ``by`` names grouping
columns (e.g. ``facet, value``); every metric is computed for all groups in
one grouped aggregate - no per-group driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions.scalar import clip01, softmax
from lexiscope.operators.prefix import double_order_key_sql, prefix_below

FACETS = ("source", "model", "genre")
ALL = "all"


def _sum_if(cond) -> Column:
    """Count of rows where ``cond`` (a Column or SQL text) holds, as BIGINT."""
    if isinstance(cond, str):
        return F.expr(f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)")
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def _x(*exprs: str) -> list[Column]:
    return [F.expr(e) for e in exprs]


CLIP_P = "least(greatest(p, 0.0D), 1.0D)"


# --------------------------------------------------------------------------
# Answers joined to the truth
# --------------------------------------------------------------------------
def join_answers(truth: DataFrame, pred: DataFrame, default: float = 0.5) -> DataFrame:
    """Every truth row with its answer, or ``default`` when none was given.
    ``truth(id, label, *facets)``, ``pred(id, label)`` -> ``(id, t, p, *facets)``."""
    facets = [c for c in truth.columns if c not in ("id", "label")]
    p = pred.select("id", F.col("label").alias("p"))
    j = truth.join(p, "id", "left")
    return j.select("id", F.col("label").cast("double").alias("t"),
                    F.coalesce(F.col("p"), F.lit(default)).cast("double").alias("p"), *facets)


def uncovered(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Counts for the coverage check: answers whose id is not in the truth.
    The job fails when ``n_unknown > 0`` or ``n_pred > n_truth``."""
    unknown = pred.select("id").join(truth.select("id"), "id", "left_anti")
    return (unknown.agg(F.count(F.lit(1)).alias("n_unknown"))
            .crossJoin(F.broadcast(pred.agg(F.count(F.lit(1)).alias("n_pred"))))
            .crossJoin(F.broadcast(truth.agg(F.count(F.lit(1)).alias("n_truth")))))


def with_facets(df: DataFrame, facets=FACETS) -> DataFrame:
    """Unpivot to one row per (facet, value): the overall row ``('all','all')``
    plus one per facet column present. Rows whose facet value is null are left
    out of that facet only. One ``stack`` generator, no extra scan."""
    present = [f for f in facets if f in df.columns]
    rest = [c for c in df.columns if c not in present]
    args = ", ".join([f"'{ALL}', '{ALL}'"] + [f"'{f}', CAST({f} AS STRING)" for f in present])
    return (df.selectExpr(*rest, f"stack({len(present) + 1}, {args}) AS (facet, value)")
              .where("value IS NOT NULL"))


# --------------------------------------------------------------------------
# Exact ROC-AUC
# --------------------------------------------------------------------------
def score_table(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per (group, distinct score ``p``): positives, negatives, other
    truth values, rows, and the summed squared error. Every binary metric and
    the AUC derive from this table, so the input is scanned and shuffled
    once, after map-side partial aggregation."""
    return df.groupBy(*by, "p").agg(*_x(
        "CAST(sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos",
        "CAST(sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg",
        "CAST(sum(CASE WHEN t NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS oth",
        "count(1) AS cnt",
        f"sum(({CLIP_P} - t) * ({CLIP_P} - t)) AS sq"))


def auc_from_scores(g: DataFrame, by: list[str]) -> DataFrame:
    g = g.selectExpr(*by, "pos", "neg", "oth", f"{double_order_key_sql('p')} AS _key")
    pb = prefix_below(g, by, "_key", ["neg"])
    agg = pb.groupBy(*by).agg(*_x("sum(pos * (neg_below * 2 + neg)) AS u2", "sum(pos) AS P",
                                  "sum(neg) AS N", "sum(oth) AS O"))
    return agg.selectExpr(*by, "CASE WHEN P > 0 AND N > 0 AND O = 0 "
                          "THEN CAST(u2 AS DOUBLE) / (CAST(P AS DOUBLE) * N * 2) END AS roc_auc")


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half.

    Rows are first aggregated to one row per (group, score) with positive and
    negative counts (partial aggregation before the shuffle); the number of
    negatives below each score comes from ``prefix_below``. The sum
    ``U2 = Σ pos·(2·neg_below + neg)`` is integer; AUC = U2 / (2·P·N).
    Null when the group does not have exactly the two classes 0 and 1.
    """
    return auc_from_scores(score_table(df, by), by)


def counts_from_scores(g: DataFrame, by: list[str]) -> DataFrame:
    """``binary_counts`` computed from ``score_table`` rows."""
    def s(cond, v):
        return f"CAST(sum(CASE WHEN {cond} THEN {v} ELSE 0 END) AS BIGINT)"
    return g.groupBy(*by).agg(*_x(
        "CAST(sum(cnt) AS BIGINT) AS n", f"{s('p = 0.5', 'cnt')} AS nu",
        f"{s('p > 0.5', 'pos')} + {s('p < 0.5', 'neg')} AS nc",
        f"{s('p > 0.5', 'pos')} AS tp", f"{s('p > 0.5', 'neg')} AS fp",
        f"{s('p <= 0.5', 'pos')} AS fn_f1", f"{s('p < 0.5', 'pos')} AS fn", "sum(sq) AS sq",
        f"{s('p < 0.5', 'neg')} AS conf_00", f"{s('p >= 0.5', 'neg')} AS conf_01",
        f"{s('p < 0.5', 'pos')} AS conf_10", f"{s('p >= 0.5', 'pos')} AS conf_11"))


# --------------------------------------------------------------------------
# One conditional-sum aggregate
# --------------------------------------------------------------------------
_BINARY_COUNTS = [
    "count(1) AS n",
    "CAST(sum(CASE WHEN p = 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS nu",
    "CAST(sum(CASE WHEN p <> 0.5 AND t = (CASE WHEN p > 0.5 THEN 1.0D ELSE 0.0D END) THEN 1 ELSE 0 END) AS BIGINT) AS nc",
    "CAST(sum(CASE WHEN t = 1 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp",
    "CAST(sum(CASE WHEN t = 0 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp",
    "CAST(sum(CASE WHEN t = 1 AND p <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn_f1",
    "CAST(sum(CASE WHEN t = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn",
    f"sum(({CLIP_P} - t) * ({CLIP_P} - t)) AS sq",
    "CAST(sum(CASE WHEN t = 0 AND p < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS conf_00",
    "CAST(sum(CASE WHEN t = 0 AND p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS conf_01",
    "CAST(sum(CASE WHEN t = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS conf_10",
    "CAST(sum(CASE WHEN t = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS conf_11",
]


def binary_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """I2-I6 counts straight from rows ``(by..., t, p)``."""
    return df.groupBy(*by).agg(*_x(*_BINARY_COUNTS))


def c_at_1_sql(n: str, nu: str, nc: str) -> str:
    d = "CAST({} AS DOUBLE)".format
    return f"(1.0D / {d(n)}) * ({d(nc)} + ({d(nu)} * {d(nc)} / {d(n)}))"


def c_at_1_expr(n: str, nu: str, nc: str) -> Column:
    return F.expr(c_at_1_sql(n, nu, nc))


_METRICS = [
    "1.0D - sq / CAST(n AS DOUBLE) AS brier",
    c_at_1_sql("n", "nu", "nc") + " AS c_at_1",
    "CASE WHEN tp + fp + fn_f1 > 0 THEN CAST(tp AS DOUBLE) * 2.0D / "
    "(CAST(tp AS DOUBLE) * 2.0D + CAST(fp AS DOUBLE) + CAST(fn_f1 AS DOUBLE)) END AS f1",
    "CASE WHEN CAST(tp AS DOUBLE) * 1.25D + CAST(fn + nu AS DOUBLE) * 0.25D + CAST(fp AS DOUBLE) <> 0.0D "
    "THEN CAST(tp AS DOUBLE) * 1.25D / (CAST(tp AS DOUBLE) * 1.25D + CAST(fn + nu AS DOUBLE) * 0.25D "
    "+ CAST(fp AS DOUBLE)) END AS f05u",
]


METRIC_COLUMNS = ["roc_auc", "brier", "c_at_1", "f1", "f05u", "mean_score"]
CONFUSION_COLUMNS = ["conf_00", "conf_01", "conf_10", "conf_11"]


def evaluate_scored(df: DataFrame, by: list[str], digits: int | None = 3) -> DataFrame:
    """I7 per group: roc_auc, brier, c@1, f1, f05u, their mean (nulls as 0,
    taken before rounding), rounded to ``digits``; confusion cells
    ``conf_<truth><pred>`` with the prediction ``p >= 0.5``."""
    g = score_table(df, by)
    counts = counts_from_scores(g, by)
    auc = auc_from_scores(g, by)
    m = counts.join(auc, by, "left").selectExpr(*by, "n", "roc_auc", *_METRICS, *CONFUSION_COLUMNS)
    mean = ("(coalesce(roc_auc, 0.0D) + brier + c_at_1 + coalesce(f1, 0.0D) "
            "+ coalesce(f05u, 0.0D)) / 5.0D AS mean_score")
    m = m.selectExpr("*", mean)
    r = (lambda c: f"round({c}, {digits}) AS {c}") if digits is not None else (lambda c: c)
    return m.selectExpr(*by, "n", *[r(c) for c in METRIC_COLUMNS], *CONFUSION_COLUMNS)


def evaluate(truth: DataFrame, pred: DataFrame, facets=FACETS, offset: float | Column | None = None,
             digits: int | None = 3) -> DataFrame:
    """I8: I7 overall and for every value of each facet, in one grouped job.
    With ``offset`` every score (missing answers included: they are 0.5
    before the shift) is moved by it first."""
    j = join_answers(truth, pred)
    if offset is not None:
        j = j.withColumn("p", F.col("p") + (offset if isinstance(offset, Column) else F.lit(float(offset))))
    return evaluate_scored(with_facets(j, facets), ["facet", "value"], digits)


# --------------------------------------------------------------------------
# Operating-point search
# --------------------------------------------------------------------------
def best_offset(scored: DataFrame, steps: int = 1000) -> DataFrame:
    """Offset search over ``steps`` evenly spaced offsets between
    ``-(max p - .49)`` and ``.51 - min p``: the first strictly better c@1 is
    kept; the search stops once it has improved and c@1 falls more than .01
    below the best. Returns one row ``(best_offset, best_c_at_1, base_c_at_1)``.

    No cross join of rows × offsets: ``p + o_k`` grows with ``k``, so each
    distinct score has a first index where it is ``> 0.5`` and one where it is
    ``>= 0.5`` (estimated arithmetically, then fixed with the exact float
    comparison over a ±3 window). Counting rows per index and cumulating over
    the ``steps`` offsets gives nc(k) and nu(k); only the ``steps``-row table
    meets a global window.
    """
    spark = scored.sparkSession
    last = steps - 1
    base = scored.agg(*_x(
        "min(p) AS pmin", "max(p) AS pmax", "count(1) AS n",
        "CAST(sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nneg",
        "CAST(sum(CASE WHEN p = 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS nu0",
        "CAST(sum(CASE WHEN p <> 0.5 AND t = (CASE WHEN p > 0.5 THEN 1.0D ELSE 0.0D END) "
        "THEN 1 ELSE 0 END) AS BIGINT) AS nc0"))
    base = base.selectExpr("*", "-(pmax - 0.49D) AS start", "0.51D - pmin AS stop")
    base = base.selectExpr("*", f"(stop - start) / {float(last)}D AS step",
                           c_at_1_sql("n", "nu0", "nc0") + " AS base_c_at_1")
    b1 = F.broadcast(base)  # one row

    def o_at(k: str) -> str:
        return f"(CASE WHEN {k} = {last} THEN stop ELSE CAST({k} AS DOUBLE) * step + start END)"

    d = scored.groupBy("p").agg(*_x(
        "CAST(sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos",
        "CAST(sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg", "count(1) AS cnt"))
    d = d.crossJoin(b1).selectExpr(
        "*", "CAST(ceil((0.5D - p - start) / step) AS BIGINT) AS est")

    def first(op: str) -> str:
        cand = f"filter(sequence(est - 3, est + 3), k -> k >= 0 AND k < {steps} AND p + {o_at('k')} {op} 0.5D)"
        return (f"greatest(least(coalesce(array_min({cand}), "
                f"CASE WHEN est + 3 < 0 THEN 0 ELSE {steps} END), {steps}), 0)")

    d = d.selectExpr("pos", "neg", "cnt", f"{first('>')} AS kgt", f"{first('>=')} AS kge")
    ev = d.selectExpr(f"stack(2, kgt, pos, cnt, 0L, 0L, kge, 0L, 0L, neg, cnt) "
                      "AS (k, pos_gt, all_gt, neg_ge, all_ge)")
    ev = ev.groupBy("k").agg(*_x(*[f"sum({c}) AS {c}" for c in ("pos_gt", "all_gt", "neg_ge", "all_ge")]))
    cum = "ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    c = (spark.range(steps).withColumnRenamed("id", "k").join(ev, "k", "left").na.fill(0)
         .selectExpr("k", *[f"sum({x}) OVER ({cum}) AS {x}" for x in ("pos_gt", "all_gt", "neg_ge", "all_ge")])
         .crossJoin(b1))
    c = c.selectExpr("k", f"{o_at('k')} AS offset", "base_c_at_1 AS base",
                     c_at_1_sql("n", "(all_ge - all_gt)", "(pos_gt + (nneg - neg_ge))") + " AS score")
    prev = "ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    c = c.selectExpr("*", f"greatest(base, coalesce(max(score) OVER ({prev}), base)) AS best_before")
    stop_k = c.where("best_before > base AND score < best_before - 0.01D").agg(F.expr("min(k) AS stop_k"))
    live = c.crossJoin(F.broadcast(stop_k)).where("stop_k IS NULL OR k < stop_k")
    pick = live.where("score > base").agg(F.expr("max_by(offset, struct(score, -k)) AS off"),
                                          F.expr("max(score) AS best"))
    return pick.crossJoin(b1).selectExpr("coalesce(off, 0.0D) AS best_offset",
                                         "coalesce(best, base_c_at_1) AS best_c_at_1", "base_c_at_1")


# --------------------------------------------------------------------------
# Multi-class metrics
# --------------------------------------------------------------------------
def accuracy(df: DataFrame, truth: str = "label", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("accuracy"))


def class_counts(df: DataFrame, truth: str = "label", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """Per class: tp, fp, fn, support. A class appears when it is seen in the
    truth or in the predictions. Both sides are one pre-aggregated pass each."""
    tside = df.groupBy(*by, F.col(truth).alias("cls")).agg(
        F.count(F.lit(1)).alias("support"), _sum_if(F.col(truth) == F.col(pred)).alias("tp"))
    pside = df.groupBy(*by, F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("npred"))
    j = tside.join(pside, [*by, "cls"], "full_outer").na.fill(0, ["support", "tp", "npred"])
    return j.select(*by, "cls", "tp", (F.col("npred") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"), "support")


def _prf(c: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(F.col("tp") * 2 + F.col("fp") + F.col("fn") > 0, tp * 2.0 / (tp * 2.0 + fp + fn)).otherwise(0.0)
    return c.select("*", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def f1_macro(df: DataFrame, truth: str = "label", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    return _prf(class_counts(df, truth, pred, by)).groupBy(*by).agg(F.avg("f1").alias("f1_macro"))


def classification_report(df: DataFrame, truth: str = "label", pred: str = "pred",
                          digits: int = 6) -> DataFrame:
    """Per class precision/recall/F1/support plus accuracy, macro and
    weighted averages, as rows ``(row, precision, recall, f1, support)``."""
    c = _prf(class_counts(df, truth, pred))
    per = c.select(F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", "support")
    tot = c.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("ntp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = F.col("ntp").cast("double") / F.col("n")
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"), F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")),
    )).alias("s")).select("s.*")
    out = per.unionByName(summary)
    return out.select("row", *[F.round(x, digits).alias(x) for x in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def confusion_long(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """``(truth, pred, n)`` - rows truth, columns prediction, named."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label", by: list[str] = ()) -> DataFrame:
    """Mean of -ln softmax(logits)[label], every row weighted equally, in the
    form max + ln(sum(exp(x - max))) - x[label] that cannot underflow."""
    x = F.transform(F.col(logits), lambda v: v.cast("double"))
    top = F.array_max(x)
    mass = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    nll = top + F.log(mass) - F.element_at(x, F.col(label).cast("int") + 1)
    return df.groupBy(*by).agg(F.avg(nll).alias("cross_entropy"))


def best_steps(metrics: DataFrame) -> DataFrame:
    """I16: per (run, metric): best value, first step reaching it, last step,
    and the value at the last step. ``metrics(run, step, metric, value)``."""
    return metrics.groupBy("run", "metric").agg(
        F.max("value").alias("best_value"),
        F.max_by("step", F.struct(F.col("value"), -F.col("step"))).alias("best_step"),
        F.max("step").alias("last_step"),
        F.max_by("value", "step").alias("last_value"))

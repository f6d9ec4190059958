"""Sampling, splitting and balancing.

Membership is decided by a hash order ``md5(seed | id)`` that any engine can
reproduce; sizes follow the reference exactly.

``take_per_group`` is the core: keep the first ``quota`` rows of every group
in hash order. A ``row_number()`` window over the group would sort a whole
group in one task (a group may hold a third of all rows). Instead the hash is
read as digits of 12 bits: rows are counted per (group, first digit), which
is a partial aggregate; the cumulated counts (≤ 4096 per group) locate the
bucket where the quota ends. Rows before it are kept, rows after it dropped,
and only rows of that boundary bucket go to the next digit. After two digits
the boundary bucket holds ~n/16.7M rows of its group, which a window ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def hash_key(id_col, seed: int | str = DEFAULT_SEED) -> Column:
    """``md5(seed|id)`` as lower-case hex; sorting by it shuffles rows."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string")))


def _digit(h: str, level: int) -> Column:
    return F.conv(F.substring(F.col(h), 1 + 3 * level, 3), 16, 10).cast("int")


def _boundary(rows: DataFrame, by: list[str], digit: str, need: str, tag: str) -> DataFrame:
    """Per group: the first ``digit`` value whose bucket is not kept whole
    (``K<tag>``) and how many rows of it are still needed (``N<tag>``).
    Built from a partial aggregate with at most 4096 rows per group."""
    cnt = rows.groupBy(*by, digit).agg(F.count(F.lit(1)).alias("_c"), F.first(need).alias("_n"))
    w = Window.partitionBy(*by).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_b", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    cut = cnt.where(F.col("_b") + F.col("_c") > F.col("_n"))
    return cut.groupBy(*by).agg(
        F.min_by(F.col(digit), F.col(digit)).alias(f"K{tag}"),
        F.min_by(F.col("_n") - F.col("_b"), F.col(digit)).alias(f"N{tag}"))


def mark_per_group(df: DataFrame, by: list[str], quotas: DataFrame | int, id_col: str = "id",
                   seed: int | str = DEFAULT_SEED, flag: str = "_keep") -> DataFrame:
    """All rows of ``df`` plus boolean ``flag``: whether the row is among the
    first ``quota`` of its group in the order ``(md5(seed|id), id)``.
    ``quotas`` is a DataFrame ``(by..., quota)`` with one row per group, or
    one int for all groups. Ids are unique row keys.

    Keep rule per row with hash digits (d0, d1) and group cuts (K0, K1):
    ``d0 < K0``, or ``d0 = K0 and d1 < K1``, or - inside the one bucket
    ``(K0, K1)`` - a row number within the remaining need.

    The cuts come from a narrow projection ``(group, id)``: two boundary
    aggregates give one row per group, and only the boundary bucket (~n/16.7M
    rows of a group) meets a window. The wide input is then read once and
    marked through a join with the per-group cut table and a left join with
    the boundary-bucket verdicts. Quotas and cuts have one row per group and
    are broadcast: a shuffle by group would send all rows of a group, with
    their texts, to one task before AQE could see that they are small.
    """
    cols = df.columns

    def digits(x: DataFrame) -> DataFrame:
        x = x.withColumn("_h", hash_key(id_col, seed))
        return x.withColumn("_d0", _digit("_h", 0)).withColumn("_d1", _digit("_h", 1))

    narrow = digits(df.select(*by, id_col))
    if isinstance(quotas, int):
        narrow = narrow.withColumn("_need", F.lit(quotas).cast("long"))
    else:
        narrow = narrow.join(F.broadcast(quotas.select(*by, F.col("quota").cast("long").alias("_need"))), by, "left") \
                       .withColumn("_need", F.coalesce(F.col("_need"), F.lit(0).cast("long")))
    b0 = _boundary(narrow, by, "_d0", "_need", "0")
    b1 = _boundary(narrow.join(F.broadcast(b0), by).where(F.col("_d0") == F.col("K0")), by, "_d1", "N0", "1")
    cuts = F.broadcast(b0.join(b1, by, "left").select(*by, "K0", "K1", "N1"))
    at_edge = (F.col("_d0") == F.col("K0")) & (F.col("_d1") == F.col("K1"))
    w = Window.partitionBy(*by).orderBy("_h", id_col)
    edge = (narrow.join(cuts, by).where(at_edge).withColumn("_rn", F.row_number().over(w))
            .select(*by, id_col, (F.col("_rn") <= F.col("N1")).alias("_ek")))
    whole = (F.col("K0").isNull() | (F.col("_d0") < F.col("K0"))
             | ((F.col("_d0") == F.col("K0")) & (F.col("K1").isNull() | (F.col("_d1") < F.col("K1")))))
    out = digits(df).join(cuts, by, "left").join(edge, [*by, id_col], "left")
    keep = F.coalesce(F.col("_ek"), F.coalesce(whole, F.lit(False)) & ~F.coalesce(at_edge, F.lit(False)))
    return out.select(*cols, keep.alias(flag))


def take_per_group(df: DataFrame, by: list[str], quotas: DataFrame | int, id_col: str = "id",
                   seed: int | str = DEFAULT_SEED) -> DataFrame:
    """Rows of ``df`` among the first ``quota`` of their group in hash order
    (see ``mark_per_group``)."""
    return mark_per_group(df, by, quotas, id_col, seed).where("_keep").drop("_keep")


def train_quotas(counts: DataFrame, by: str, n_train: Column) -> DataFrame:
    """Largest-remainder allocation of ``n_train`` rows over classes
    proportional to their counts (ties: smaller class value first).
    ``counts(by, cnt, total)`` has one row per class - a tiny table."""
    cont = (F.col("cnt") / F.col("total")) * n_train
    q = counts.select(by, "cnt", "total", cont.alias("_cont"), n_train.alias("_ntrain"))
    q = q.select("*", F.floor("_cont").cast("long").alias("_fl"), (F.col("_cont") - F.floor("_cont")).alias("_rem"))
    w_all = Window.partitionBy()  # one row per class
    q = q.select("*", (F.col("_ntrain") - F.sum("_fl").over(w_all)).alias("_left"),
                 F.row_number().over(Window.orderBy(F.desc("_rem"), F.col(by))).alias("_r"))
    return q.select(by, "cnt", (F.col("_fl") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("quota"))


def stratified_split(df: DataFrame, by: str = "label", test_ratio: float = 0.2,
                     seed: int | str = DEFAULT_SEED, id_col: str = "id",
                     names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Adds ``split``. Test size is ``ceil(test_ratio·n)``; the train
    share of each class follows largest remainders; membership by hash order."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("cnt"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("cnt").alias("total"))))  # one row
    n_train = F.col("total") - F.ceil(F.col("total") * F.lit(float(test_ratio)))
    quotas = train_quotas(counts, by, n_train.cast("long")).select(by, "quota")
    m = mark_per_group(df, [by], quotas, id_col, seed)
    return m.withColumn("split", F.when(F.col("_keep"), F.lit(names[0])).otherwise(F.lit(names[1]))).drop("_keep")


def take_percent(df: DataFrame, pct: float, by: list[str] = (), seed: int | str = DEFAULT_SEED,
                 id_col: str = "id") -> DataFrame:
    """The first ``int(n·(pct/100))`` rows (per ``by`` group) in hash order."""
    by = list(by)
    if by:
        q = df.groupBy(*by).agg(F.floor(F.count(F.lit(1)) * F.lit(float(pct) / 100.0)).cast("long").alias("quota"))
        return take_per_group(df, by, q, id_col, seed)
    d = df.withColumn("_g", F.lit(0))
    q = d.groupBy("_g").agg(F.floor(F.count(F.lit(1)) * F.lit(float(pct) / 100.0)).cast("long").alias("quota"))
    return take_per_group(d, ["_g"], q, id_col, seed).drop("_g")


def parse_percent(spec: str) -> tuple[float, float, float]:
    """``'10_10_10'`` -> (train, val, test) percentages."""
    a, b, c = (float(x) for x in spec.split("_"))
    return a, b, c


def leave_out(df: DataFrame, genres: list[str], split: str = "split", genre: str = "genre",
              train: str = "train", val: str = "val") -> DataFrame:
    """Rows of the left-out genres move to validation, all others to
    training (test rows untouched)."""
    g = F.col(genre).isin(list(genres))
    s = F.col(split)
    new = (F.when(s.isin(train, val) & g, F.lit(val))
           .when(s.isin(train, val), F.lit(train)).otherwise(s))
    return df.withColumn(split, new)


def balance_by_label(df: DataFrame, label: str = "label", seed: int | str = DEFAULT_SEED,
                     id_col: str = "id") -> DataFrame:
    """With two or more labels, every label down to the smallest label count."""
    if label not in df.columns:
        raise ValueError("balancing needs a label column")
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    s = c.agg(F.min("cnt").alias("m"), F.count(F.lit(1)).alias("k"))
    q = c.crossJoin(F.broadcast(s)).select(
        label, F.when(F.col("k") < 2, F.col("cnt")).otherwise(F.col("m")).alias("quota"))
    return take_per_group(df, [label], q, id_col, seed)


def balance_by_label_model(df: DataFrame, label: str = "label", model: str = "model",
                           seed: int | str = DEFAULT_SEED, id_col: str = "id") -> DataFrame:
    """Within each label, every model down to the smallest model count of that label."""
    c = df.groupBy(label, model).agg(F.count(F.lit(1)).alias("cnt"))
    m = c.groupBy(label).agg(F.min("cnt").alias("quota"))
    q = c.join(m, label).select(label, model, "quota")
    return take_per_group(df, [label, model], q, id_col, seed)


def row_limit(df: DataFrame, n: int, seed: int | str = DEFAULT_SEED, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows in hash order (a top-k: TakeOrderedAndProject,
    no global sort)."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")

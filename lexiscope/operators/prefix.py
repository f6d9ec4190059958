"""Ordered prefix sums without a one-partition window.

``prefix_below(df, by, key, vals)`` returns, for every row of ``df`` (one row
per distinct ``(by, key)``), the sum of each ``val`` over the rows of the same
group with a smaller key. A plain ``Window.partitionBy(by).orderBy(key)``
would put a whole group into one task; a group may hold a third of all rows.

The 64-bit key is split into three digits of 22/21/21 bits. Prefix sums are
taken per digit level and added up:

    below(k) = below_0(k0) + below_1(k0, k1) + below_2(k0, k1, k2)

Each window partition then holds at most 2^22 distinct digits, whatever the
distribution of the keys. Levels 0 and 1 run on aggregated tables that are a
tiny fraction of the input; level 2 shares the (by, k0, k1) partitioning with
the join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK21 = (1 << 21) - 1


def double_order_key_sql(x: str) -> str:
    """SQL text of an order-preserving BIGINT image of DOUBLE ``x`` (its
    IEEE-754 bit pattern, negated for negative values), built from exact
    power-of-two arithmetic - Spark has no raw-bits function."""
    a = f"abs({x})"
    e0 = f"CAST(floor(log2({a})) AS INT)"
    e = (f"(CASE WHEN {a} < pow(2.0D, {e0}) THEN {e0} - 1 "
         f"WHEN {a} >= pow(2.0D, {e0} + 1) THEN {e0} + 1 ELSE {e0} END)")
    normal = (f"(shiftleft(CAST({e} + 1023 AS BIGINT), 52) + "
              f"CAST(({a} / pow(2.0D, {e}) - 1.0D) * 4503599627370496.0D AS BIGINT))")
    sub = f"CAST(({a} * pow(2.0D, 1022)) * 4503599627370496.0D AS BIGINT)"
    bits = (f"(CASE WHEN {a} = 0.0D THEN 0L WHEN isnan({a}) THEN 9218868437227405313L "
            f"WHEN {a} = double('infinity') THEN 9218868437227405312L "
            f"WHEN {a} < pow(2.0D, -1022) THEN {sub} ELSE {normal} END)")
    return f"(CASE WHEN {x} < 0 THEN -{bits} ELSE {bits} END)"


def double_order_key(x: str) -> Column:
    return F.expr(double_order_key_sql(x))


def prefix_below(df: DataFrame, by: list[str], key: str, vals: list[str],
                 suffix: str = "_below") -> DataFrame:
    byl = ", ".join(by)
    byc = (byl + ", ") if by else ""
    part = f"PARTITION BY {byl}" if by else ""
    d = df.selectExpr("*", f"shiftright({key}, 42) AS _k0",
                      f"shiftright({key}, 21) & {_MASK21} AS _k1", f"{key} & {_MASK21} AS _k2")
    sums = [f"sum({v}) AS {v}" for v in vals]
    t1 = d.groupBy(*by, "_k0", "_k1").agg(*[F.expr(s) for s in sums])
    t0 = t1.groupBy(*by, "_k0").agg(*[F.expr(s) for s in sums])
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    l0 = t0.selectExpr(*by, "_k0", *[
        f"coalesce(sum({v}) OVER ({part} ORDER BY _k0 {frame}), 0) AS _b0_{v}" for v in vals])
    p1 = f"PARTITION BY {byc}_k0"
    l1 = t1.selectExpr(*by, "_k0", "_k1", *[
        f"coalesce(sum({v}) OVER ({p1} ORDER BY _k1 {frame}), 0) AS _b1_{v}" for v in vals])
    p2 = f"PARTITION BY {byc}_k0, _k1"
    d2 = d.selectExpr("*", *[
        f"coalesce(sum({v}) OVER ({p2} ORDER BY _k2 {frame}), 0) AS _b2_{v}" for v in vals])
    out = d2.join(l1, [*by, "_k0", "_k1"]).join(l0, [*by, "_k0"])
    return out.selectExpr(*df.columns, *[f"_b0_{v} + _b1_{v} + _b2_{v} AS {v}{suffix}" for v in vals])

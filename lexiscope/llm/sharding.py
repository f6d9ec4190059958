"""Sharding: k-d tree over metadata, native expressions only.

Every row is a point of whole numbers (each dimension scaled to 20 bits over
its range in the table) that weighs its bytes. A node is split along the
dimension in which its points spread widest, at the weighted median; the two
halves are split again until the leaves reach the target bytes. The median is
found by digits of the sort key (dimension value, then a hash of the row, so
that equal values can be split too): a sum of bytes per node and digit, twelve
bits at a time, never a sort of the rows. Per step the driver sees one row per
node.

Defined results: a null text weighs 1; null metadata counts as the smallest
value; rows alike in every column are split by a number of their own only
as far as the hash of their id and text differs, so exact repeats of a row
(same id) stay together; an empty table gives no rows; other columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import discard, materialized
from lexiscope.llm.packing import numbered

SHARDS = 16
VALUE_BITS, TIE_BITS, DIGIT_BITS = 20, 16, 12


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def dimensions(docs: DataFrame, metadata: dict[str, Column]) -> DataFrame:
    """Columns d0, d1, ... of whole numbers in [0, 2**VALUE_BITS), in one pass
    for the ranges and one for the values."""
    raw = docs.select("*", *[c.cast("double").alias(f"_r{k}")
                             for k, c in enumerate(metadata.values())])
    ends = raw.agg(*[f(f"_r{k}").alias(f"{n}{k}") for k in range(len(metadata))
                     for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << VALUE_BITS) - 1

    def scaled(k: int) -> Column:
        lo, hi = ends[f"lo{k}"], ends[f"hi{k}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(f"_r{k}") - F.lit(lo)) / F.lit(hi - lo) * top), F.lit(0)).cast("long")

    return raw.select("*", *[scaled(k).alias(f"d{k}") for k in range(len(metadata))]).drop(
        *[f"_r{k}" for k in range(len(metadata))])


def of_node(values: dict[int, int]) -> Column:
    """The value of each row's node (null for others), from a dictionary with
    at most one entry per shard."""
    if not values:
        return F.lit(None).cast("long")
    pairs = [F.lit(x).cast("long") for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col("node"))


def cuts(keyed: DataFrame, wanted: dict[int, int]) -> dict[int, int]:
    """For each node the sort key up to which ``wanted`` bytes lie, or as near
    to them as whole rows allow. ``keyed`` has node, size and key."""
    below = {n: 0 for n in wanted}           # bytes before the digits found so far
    prefix = {n: 0 for n in wanted}
    for shift in range(VALUE_BITS + TIE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("key", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        sums = (keyed.where(F.shiftright("key", shift + DIGIT_BITS) == of_node(prefix))
                .groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes")))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("digit"))
        here = F.struct("digit", "upto", "bytes")
        reached = F.col("upto") >= of_node({n: wanted[n] - below[n] for n in wanted})
        # the digit in which the wanted bytes are reached; the last one if none is
        found = (sums.withColumn("upto", upto).groupBy("node")
                 .agg(F.coalesce(F.min(F.when(reached, here)), F.max(here)).alias("x")).collect())
        for r in found:
            n, x = r["node"], r["x"]
            prefix[n] = (prefix[n] << DIGIT_BITS) | x["digit"]
            first = below[n] + x["upto"] - x["bytes"]
            if not shift and first + x["bytes"] - wanted[n] > wanted[n] - first:
                prefix[n] -= 1               # leaving the last rows out comes nearer
            below[n] = first
    return prefix


def assign(docs: DataFrame, metadata: dict[str, Column], size: Column, row: list[str],
           shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``size`` and ``shard``. With ``target_bytes`` there are as
    many leaves as the total needs; else ``shards``. ``row`` names the columns
    whose hash splits equal points. The columns of ``docs`` are written to the
    checkpoint folder once a level, so pass only the ones that are needed."""
    dims = [f"d{k}" for k in range(len(metadata))]
    tie = F.shiftrightunsigned(F.xxhash64(*row), 64 - TIE_BITS)
    tree = materialized(
        dimensions(docs.withColumn("size", size.cast("long")), metadata)
        .withColumn("_tie", tie).withColumn("node", F.lit(0).cast("long")))
    if target_bytes:
        total = tree.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    leaves = {0: (0, shards)}                # node -> (first shard, number of shards)
    while any(n > 1 for _, n in leaves.values()):
        stats = tree.groupBy("node").agg(F.sum("size").alias("bytes"), *[
            (F.max(d) - F.min(d)).alias(d) for d in dims]).collect()
        widest = {r["node"]: max(range(len(dims)), key=lambda k: (r[dims[k]], -k))
                  for r in stats if leaves[r["node"]][1] > 1}
        # the left half gets its shards' part of the bytes
        wanted = {r["node"]: r["bytes"] * (leaves[r["node"]][1] // 2) // leaves[r["node"]][1]
                  for r in stats if r["node"] in widest}
        value = F.element_at(F.array(*dims), of_node({n: k + 1 for n, k in widest.items()}).cast("int"))
        keyed = tree.withColumn("key", F.shiftleft(value, TIE_BITS) + F.col("_tie"))
        at = of_node(cuts(keyed.select("node", "size", "key").where("key is not null"), wanted))
        n = F.col("node")
        before, tree = tree, materialized(
            keyed.withColumn("node", F.when(at.isNull(), n).when(F.col("key") > at, 2 * n + 2)
                             .otherwise(2 * n + 1)).drop("key"))
        discard(before)
        leaves = {c: s for node, (first, count) in leaves.items() for c, s in (
            [(2 * node + 1, (first, count // 2)), (2 * node + 2, (first + count // 2, count - count // 2))]
            if count > 1 else [(node, (first, count))])}
    shard = of_node({n: first for n, (first, _) in leaves.items()}).cast("int")
    return tree.withColumn("shard", shard).drop("node", "_tie", *dims)


def with_slots(sharded: DataFrame, row: list[str], rows: int) -> DataFrame:
    """Gapless slots from 0 in every shard."""
    return numbered(sharded, "shard", "slot", row, rows)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of parquet files per shard."""
    sharded.write.partitionBy("shard").parquet(path)

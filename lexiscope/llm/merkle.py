"""Merkle manifest of a dataset: build, store and verify by a recursive query.

The rows of a group (for instance a language), in the order of a key, are the
leaves of the group's tree: every ``FANOUT`` consecutive nodes become the hash
of their concatenated digests until one remains, the group's subroot. The
subroots, in the order of their groups, make the top tree in the same way; its
last node is the root of the dataset.

``build`` stores the nodes of all levels as rows linked to their parents.
``climb`` verifies every leaf against the root by a recursive query: a row
starts at the lowest node above its leaves and ascends one parent a step,
appending the siblings met there and folding the presented digest of each of
its leaves with them. The leaves of one run share all siblings above the run,
so a row carries them together; the siblings are kept as bytes.

A node is named by the position of its first leaf and its level. Upper nodes
are met by very many rows; a node is therefore stored once for each block of
2**BLOCK_BITS leaves below it, and rows meet the copy of their own block, so no
key has more than a block's rows, however the groups are distributed.

Hashes are lower-case hex sha256 of the concatenated hex digests.

Defined results: null and empty values differ (``-`` against ``0:``); rows with
equal keys are ordered by their digest, so repeated rows are interchangeable;
null keys and null groups come first; a group of one row has its leaf as
subroot, a dataset of one group its subroot as root, and a dataset of one row
an empty list of siblings; an empty table gives no rows; other columns are
ignored and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import discard, materialized

FANOUT = 8
LEVELS = 64                 # names: first leaf * LEVELS + level
TOP = 32                    # levels from here on belong to the top tree
BLOCK_BITS = 12


def digest(values: list[Column]) -> Column:
    """Hex digest of a row: each value as ``-`` if null, else its number of
    UTF-8 bytes, a colon and the value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in values]), 256)


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def packed(c: Column) -> Column:
    return F.unhex(c)


def folded(digests: Column) -> Column:
    """Hash of an array of digests."""
    return packed(F.sha2(F.array_join(F.transform(digests, hexed), ""), 256))


def joined(digests: Column) -> Column:
    """The digests of an array as one binary."""
    return packed(F.array_join(F.transform(digests, F.hex), ""))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their position (from 0) in the given order: a sort by
    ranges, rows counted per range, ranges cumulated (one row a partition)."""
    spark = df.sparkSession
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = materialized(tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
                          .withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    before, starts = 0, []
    for r in sorted(counts):
        starts.append((r[0], before))
        before += r[1]
    starts = spark.createDataFrame(starts, "_part long, _before long")
    return (placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_before", "_at"))


@dataclass
class Manifest:
    """``runs``: (block, node, leaves), a row for each lowest node; ``nodes``:
    (block, node, parent, before, after, hash, subroot), a row for each node
    below the root and each block; ``root``: its name and hash, or None."""
    runs: DataFrame
    nodes: DataFrame
    root: tuple[int, bytes] | None


def parents(nodes: DataFrame, level: int) -> DataFrame:
    """Families of one level: (tree, left, idx, first, leaves, node, hash, kids)."""
    kid = F.struct("idx", "node", "first", "leaves", "hash")
    return (nodes.groupBy("tree", "left", F.floor(F.col("idx") / FANOUT).alias("idx"))
            .agg(F.array_sort(F.collect_list(kid)).alias("kids"))
            .withColumn("left", F.ceil(F.col("left") / FANOUT))
            .withColumn("first", F.col("kids")[0]["first"])
            .withColumn("leaves", F.aggregate("kids", F.lit(0).cast("long"), lambda s, k: s + k["leaves"]))
            .withColumn("node", F.col("first") * LEVELS + level)
            .withColumn("hash", folded(F.col("kids.hash"))))


NODE = ["tree", "left", "idx", "node", "first", "leaves", "hash"]


def grown(level: DataFrame, k: int, stored: list[DataFrame]) -> list[DataFrame]:
    """Build up from the nodes of level k until each tree has one node left;
    ``stored`` gets the families. Returns the last nodes, by level."""
    done = []
    while True:
        done.append(level.where("left = 1").select(*NODE))
        open_ = level.where("left > 1")
        if open_.isEmpty():
            return done
        k += 1
        level = materialized(parents(open_.select(*NODE), k))
        stored.append(level)


def build(rows: DataFrame, key: Column, group: Column, leaf: Column, shown: Column | None = None) -> Manifest:
    """Trees over the rows. ``leaf`` is a row's digest, ``shown`` the one that
    is presented at verification (the leaf itself unless given)."""
    leaves = materialized(rows.select(key.cast("long").alias("key"), group.cast("string").alias("grp"),
                                      packed(leaf).alias("leaf"),
                                      packed(leaf if shown is None else shown).alias("shown")))
    placed = materialized(numbered(leaves, ["grp", "key", "leaf"], "pos"))
    trees = placed.groupBy("grp").agg(F.min("pos").alias("tree"), F.count("*").alias("left"))
    trees = materialized(numbered(trees, ["grp"], "rank"))
    small = trees.select(F.col("grp").alias("_grp"), "tree", "left")
    one = F.struct("pos", "key", "leaf", "shown")
    runs = (placed.join(small, F.col("grp").eqNullSafe(F.col("_grp")))
            .groupBy("tree", F.col("left").alias("size"), F.floor((F.col("pos") - F.col("tree")) / FANOUT).alias("idx"))
            .agg(F.array_sort(F.collect_list(one)).alias("members"))
            .withColumn("first", F.col("members")[0]["pos"])
            .withColumn("own", F.col("members.leaf"))
            .select("tree", F.ceil(F.col("size") / FANOUT).alias("left"), "idx", "first",
                    F.size("members").cast("long").alias("leaves"),
                    (F.col("first") * LEVELS + F.when(F.col("size") > 1, 1).otherwise(0)).alias("node"),
                    F.when(F.col("size") > 1, folded(F.col("own"))).otherwise(F.col("own")[0]).alias("hash"),
                    "own",
                    F.transform("members", lambda m, i: F.struct(
                        m["key"].alias("key"), m["leaf"].alias("leaf"),
                        # the run itself is the first fold
                        F.when(F.col("size") > 1, folded(F.transform(
                            "own", lambda x, j: F.when(i == j, m["shown"]).otherwise(x))))
                        .otherwise(m["shown"]).alias("shown"))).alias("held")))
    runs = materialized(runs)
    discard(leaves)
    discard(placed)
    stored: list[DataFrame] = []
    subroots = grown(runs, 1, stored)
    last = subroots[0]
    for other in subroots[1:]:
        last = last.unionByName(other)
    top = (last.drop("left").join(trees.select("tree", "rank"), "tree")
           .select(F.lit(-1).cast("long").alias("tree"), F.lit(trees.count()).cast("long").alias("left"),
                   F.col("rank").alias("idx"), "node", "first", "leaves", "hash"))
    upper: list[DataFrame] = []
    top = materialized(top)
    found = [r for d in grown(top, TOP, upper) for r in d.select("node", "hash").collect()]   # one row
    families = [(f, F.lit(False)) for f in stored] + [(f, F.lit(k == 0)) for k, f in enumerate(upper)]
    nodes = None
    for family, subroot in families:
        each = (family.select(F.col("node").alias("parent"), F.col("kids.hash").alias("all"),
                              F.posexplode("kids").alias("at", "kid"), subroot.alias("subroot"))
                .select(F.explode(F.sequence(F.shiftright("kid.first", BLOCK_BITS),
                                             F.shiftright(F.expr("kid.first + kid.leaves - 1"), BLOCK_BITS))).alias("block"),
                        F.col("kid.node").alias("node"), "parent",
                        joined(F.slice("all", 1, F.col("at"))).alias("before"),
                        joined(F.expr("slice(all, at + 2, size(all))")).alias("after"),
                        F.col("kid.hash").alias("hash"), "subroot"))
        nodes = each if nodes is None else nodes.unionByName(each)
    spark = rows.sparkSession
    empty = ("block long, node long, parent long, before binary, after binary, hash binary, subroot boolean")
    nodes = materialized(nodes if nodes is not None else spark.createDataFrame([], empty))
    for f in [*stored, *upper]:
        discard(f)
    runs_ = runs.select(F.shiftright("first", BLOCK_BITS).alias("block"), "node", "held", "own")
    return Manifest(runs_, nodes, (found[0][0], bytes(found[0][1])) if found else None)


ASCENT = """
WITH RECURSIVE climb(block, node, held, own, beside, subroot) AS (
  SELECT block, node, held, own, unhex('') AS beside, CAST(NULL AS BINARY) AS subroot FROM {runs}
  UNION ALL
  SELECT c.block, n.parent,
         transform(c.held, x -> named_struct('key', x.key, 'leaf', x.leaf, 'shown',
           unhex(sha2(concat(lower(hex(n.before)), lower(hex(x.shown)), lower(hex(n.after))), 256)))),
         c.own, concat(c.beside, n.before, n.after),
         coalesce(c.subroot, CASE WHEN n.subroot THEN n.hash END)
  FROM climb c JOIN {nodes} n ON c.block = n.block AND c.node = n.node
)
SELECT held, own, beside, subroot FROM climb WHERE node = {root}
"""


def recursive(spark: SparkSession, text: str, **tables) -> DataFrame:
    """Result of a recursive query over all its rows, written once: Spark's
    own limits on rows and levels are meant for runaway recursions and are
    lifted while it runs (a tree has at most LEVELS levels)."""
    limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(2 * LEVELS)}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        return materialized(spark.sql(text, **tables))
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def climb(spark: SparkSession, m: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, siblings, folded): every leaf with the hex
    digests beside its way to the root, and the root that its presented digest
    folds to."""
    if m.root is None:
        return spark.createDataFrame([], "key long, leaf string, subroot string, root string, "
                                         "siblings string, folded string")
    name, root = m.root
    # a shuffled join at every size: rows and copies of nodes meet by block
    done = recursive(spark, ASCENT, runs=m.runs, nodes=m.nodes.hint("merge"), root=name)
    each = done.select("own", "beside", "subroot", F.posexplode("held").alias("at", "h"))
    others = F.expr("filter(own, (x, j) -> j != at)")
    return each.select(F.col("h.key").alias("key"), hexed(F.col("h.leaf")).alias("leaf"),
                       hexed(F.coalesce("subroot", F.lit(root))).alias("subroot"),
                       hexed(F.lit(root)).alias("root"),
                       F.concat(F.array_join(F.transform(others, hexed), ""), hexed(F.col("beside"))).alias("siblings"),
                       hexed(F.col("h.shown")).alias("folded"))

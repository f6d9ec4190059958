"""N-gram Jaccard join: token-combination prefixes.

A document is the set of its distinct word shingles (hashes). Two documents
link when 100 * intersection >= 80 * union.

1. Shingles are counted in a sketch of fixed size (2**SKETCH_BITS saturating
   counters). A shingle whose counter stays within a bound near the mean is
   rare: its document count is at most that bound. The others are frequent,
   and fall into FREQUENT_CLASSES classes by hash.
2. All documents order their shingles alike: rare ones first, by hash. A
   document of n shingles may miss at most n - ceil(0.8 n) of them in a
   linked one. Its prefix is extended until (rare shingles) + sum over the
   frequent classes of (shingles - 1) exceeds that number; two linked
   documents then share a rare shingle or, in some class, two frequent ones.
   So rare shingles are indexed singly and frequent ones in pairs of one
   class. (Sets of up to SMALL_SET shingles may be too small for this; they
   index their plain prefix singly as well.)
3. Equal sets are one node. Rare signatures have few documents, and all their
   pairs are candidates. A frequent signature may be anybody's: its documents
   are first compared with four pivots, and after that only those that are
   not yet in the pivot's component are compared with the others.
4. Candidates pass a bound from parity bitmaps (every shingle flips one bit,
   so the bitmaps differ in at most |symmetric difference| bits), first from
   bitmaps of one size, then, for larger sets, from bitmaps that grow with the
   set (they halve by folding, so that sets of any sizes compare). Those that
   remain are verified on the full sets: first every document's link to its smallest
   partner, then those candidates whose ends are still in different
   components. The rest cannot change a component.

Defined results: a document without words has an empty set and no links; a
null doc_id has a null component and links nothing; rows that share a doc_id
are one node; repeated rows are each returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import (LIGHT_ROWS, discard, flagged, materialized, mix, release, shingle_hashes,
                                  signed, small_batches)
from lexiscope.llm.components import components

WIDTH = 5
SKETCH_BITS = 24
SKETCH_BLOCK = 1 << 18
FREQUENT_CLASSES = 8
SMALL_SET = 14
BITMAP_BITS = 1024
PIVOTS = 4
BLOCK = 1024

_U = np.uint64


def sketch(docs: DataFrame, text: str = "text", bits: int = SKETCH_BITS) -> tuple[np.ndarray, int]:
    """(flags of the counters whose shingles are frequent, the bound). Tasks
    count their documents' shingles; equal blocks of counters (a bit for each
    counter met, and the counts of those) are then added up as a stream. Only the flags, one bit a counter, reach the driver."""
    size, block = 1 << bits, min(SKETCH_BLOCK, 1 << bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = None
        for b in batches:
            h = [shingle_hashes(t, WIDTH) for t in b.t]
            if counts is None:
                counts = np.zeros(size, np.uint16)
            at, n = np.unique((np.concatenate(h) >> _U(64 - bits)).astype(np.int64), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 65535).astype(np.uint16)
        if counts is not None:
            for k in range(0, size, block):
                here = counts[k:k + block]
                if here.any():
                    yield pd.DataFrame({"k": [k], "met": [np.packbits(here > 0).tobytes()],
                                        "counts": [here[here > 0].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, met, c in zip(b.k, b.met, b.counts):
                total = sums.setdefault(k, np.zeros(block, np.uint32))
                at = np.flatnonzero(np.unpackbits(np.frombuffer(met, np.uint8)))
                total[at] = np.minimum(total[at] + np.frombuffer(c, np.uint16), 65535)
        yield pd.DataFrame({"k": list(sums), "counts": [s.astype(np.uint16).tobytes() for s in sums.values()]},
                           columns=["k", "counts"])

    small_batches(docs.sparkSession)
    parts = size // block
    total = materialized(docs.select(F.col(text).alias("t")).mapInPandas(count, "k int, met binary, counts binary")
                         .repartition(parts, "k").mapInPandas(add, "k int, counts binary"))

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [sum(int(np.frombuffer(c, np.uint16).sum(dtype=np.int64))
                                          for c in b.counts)]})

    each = (total.mapInPandas(mean, "n long").agg(F.sum("n")).first()[0] or 0) / size
    bound = int(np.ceil(each + 6 * np.sqrt(each) + 8))

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b.k, "flags": [np.packbits(np.frombuffer(c, np.uint16) > bound).tobytes()
                                                    for c in b.counts]})

    flags = np.zeros(size // 8, np.uint8)
    for r in total.mapInPandas(over, "k int, flags binary").collect():
        flags[r.k // 8:(r.k + block) // 8] = np.frombuffer(r.flags, np.uint8)
    return flags, bound


def may_miss(n: int) -> int:
    """Shingles that a set of n may lack in a linked set."""
    return n - -(-8 * n // 10)


def signatures(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single-shingle and combination signatures of a sorted set ``s`` whose
    shingles are marked ``frequent`` or not."""
    need = may_miss(len(s)) + 1
    rare, often = s[~frequent], s[frequent]
    single, pairs = rare[:need], []
    if len(single) < need and len(often):
        kind = (often % _U(FREQUENT_CLASSES)).astype(np.int64)
        # extend until (frequent shingles) - (classes met) makes up what is missing
        first = np.zeros(len(often), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        gain = np.cumsum(~first)
        end = int(np.searchsorted(gain, need - len(single))) + 1
        for c in range(FREQUENT_CLASSES):
            x = often[:end][kind[:end] == c]
            if len(x) > 1:
                i, j = np.triu_indices(len(x), 1)
                with np.errstate(over="ignore"):
                    pairs.append(mix(x[i] * _U(3) + x[j] * _U(0x9E3779B97F4A7C15)))
    if len(s) <= SMALL_SET:
        plain = often[:max(0, need - len(single))]
        pairs.append(mix(plain ^ _U(0x5851F42D4C957F2D)))
    return single, np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)


def bitmap(s: np.ndarray, bits: int = BITMAP_BITS) -> bytes:
    """Parity of the shingles that fall on each bit."""
    odd = np.bincount((s % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_bitmap(s: np.ndarray) -> bytes | None:
    """For a set of more than BITMAP_BITS shingles a bitmap of a power of two
    bits, at least one a shingle: a bitmap of fewer bits differs from
    any other in half of its bits at most, which says nothing on large sets."""
    bits = 1 << (len(s) - 1).bit_length() if len(s) else 0
    return bitmap(s, bits) if bits > BITMAP_BITS else None


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which each two bitmaps differ, the larger one folded to the
    size of the smaller one (its halves combined by exclusive or)."""
    size = np.array([[len(i), len(j)] for i, j in zip(x, y)], np.int64).reshape(-1, 2)
    out = np.zeros(len(size), np.int64)
    for pair in np.unique(size, axis=0):
        at = np.flatnonzero((size == pair).all(axis=1))
        sides = []
        for side in (x, y):
            bits = np.frombuffer(b"".join(side[k] for k in at), np.uint8).reshape(len(at), -1)
            while bits.shape[1] > pair.min():
                half = bits.shape[1] // 2
                bits = bits[:, :half] ^ bits[:, half:]
            sides.append(bits)
        out[at] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
    return out


def sets_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: doc_id, n_shingles and a 128-bit key of the set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([set_key(shingle_hashes(t, WIDTH)) for t in b.t], columns=["n", "x", "y"])
            yield got.assign(doc_id=b.doc_id.astype("Int64").to_numpy())[["doc_id", "n", "x", "y"]]

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
            .mapInPandas(run, "doc_id long, n int, x long, y long"))


def set_key(s: np.ndarray) -> tuple[int, int, int]:
    with np.errstate(over="ignore"):
        x = int(signed(np.bitwise_xor.reduce(s, initial=_U(0), keepdims=True))[0])
        y = int(signed(np.sum(mix(s), dtype=np.uint64, keepdims=True))[0])
    return len(s), x, y


def indexed(docs: DataFrame, flags: np.ndarray, key: str, text: str, bits: int = SKETCH_BITS) -> DataFrame:
    """Per row with an id and a set: doc_id, n_shingles, the set's key, its
    signatures and its bitmaps. The flags (2**bits bits) travel in a broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = shared.value
        for b in batches:
            out = []
            for doc, t in zip(b.doc_id, b.t):
                s = shingle_hashes(t, WIDTH)
                if len(s):
                    at = (s >> _U(64 - bits)).astype(np.int64)
                    single, pairs = signatures(s, (mask[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))
                    out.append((doc, *set_key(s), signed(single), signed(pairs), bitmap(s), wide_bitmap(s)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "x", "y", "single", "pairs", "bitmap", "wide"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null")
            .mapInPandas(run, "doc_id long, n int, x long, y long, single array<long>, "
                              "pairs array<long>, bitmap binary, wide binary"))


def spread(data: DataFrame, ask: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of both sides of a comparison within groups of equal ``key``, dealt
    to blocks (part, dp, qp) so that each row of ``ask`` meets each row of
    ``data`` of its group in one block, and a group has at most about
    ``block`` rows of either side in one. Small groups share parts."""
    grid = (data.groupBy(key).agg(F.count("*").alias("nd"))
            .join(ask.groupBy(key).agg(F.count("*").alias("nq")), key)
            .select(key, F.ceil(F.col("nd") / block).cast("int").alias("dn"),
                    F.ceil(F.col("nq") / block).cast("int").alias("qn")))
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.join(grid, key).withColumn("dp", deal("dn")).withColumn("qp", every("qn"))
    right = ask.join(grid, key).withColumn("qp", deal("qn")).withColumn("dp", every("dn"))
    return (left.withColumn("asks", F.lit(False)).unionByName(right.withColumn("asks", F.lit(True)))
            .drop("dn", "qn"))


def stray_pairs(groups: DataFrame, labels: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame | None:
    """Members of frequent groups that are not in their pivot's component,
    against all members in other components: only pairs that sizes and bitmaps
    allow leave the blocks. With ``nearest``, of those that join a member with
    one component only the pair whose bitmaps differ least. A written table of
    distinct pairs; None if there are no such members."""
    of = labels.select(F.col("node").alias("doc_id"), "component")
    own = F.coalesce("component", "doc_id").alias("c")
    of_pivot = labels.select(F.col("node").alias("pivot"), F.col("component").alias("pc"))
    members = materialized(groups.join(of, "doc_id", "left").select("sig", "doc_id", "n", "pivot", own)
                           .join(of_pivot, "pivot", "left")
                           .select("sig", "doc_id", "n", "c", (F.col("c") != F.coalesce("pc", "pivot")).alias("stray")))
    if members.where("stray").isEmpty():
        discard(members)
        return None
    mixed = members.where("stray").select("sig").distinct()
    maps = nodes.select("doc_id", F.col("n"), "bitmap")
    data = members.join(mixed, "sig", "left_semi").join(maps, ["doc_id", "n"])
    data = materialized(data.select("sig", "doc_id", "n", "c", "stray", "bitmap"))
    discard(members)
    parts = max(1, data.count() // BLOCK)
    rows = spread(data.drop("stray"), data.where("stray").drop("stray"), "sig", BLOCK)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("sig", kind="stable")
        sig, doc, n, c, asks = (b[x].to_numpy() for x in ("sig", "doc_id", "n", "c", "asks"))
        bits = np.frombuffer(b"".join(b.bitmap), np.uint64).reshape(len(b), -1)
        edges = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))
        out = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            side = asks[lo:hi]
            these = lo + np.flatnonzero(~side)
            for q in lo + np.flatnonzero(side):
                total = n[these].astype(np.int64) + n[q]
                differ = np.bitwise_count(bits[these] ^ bits[q]).sum(axis=1, dtype=np.int64)
                ok = np.flatnonzero((c[these] != c[q]) & (18 * differ <= 2 * total)
                                    & (10 * np.minimum(n[these], n[q]) >= 8 * np.maximum(n[these], n[q])))
                if len(ok):
                    if nearest:
                        ok = ok[np.lexsort((differ[ok], c[these[ok]]))]
                        ok = ok[np.unique(c[these[ok]], return_index=True)[1]]
                    ok = these[ok]
                    out.append(np.column_stack([np.minimum(doc[ok], doc[q]), np.maximum(doc[ok], doc[q])]))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    pairs = materialized(rows.withColumn("part", F.pmod("sig", F.lit(parts))).groupBy("part", "dp", "qp")
                         .applyInPandas(run, "a long, b long").distinct())
    discard(data)
    release(groups.sparkSession)
    return pairs


def length_ok(a, b):
    """Sizes that a linked pair may have."""
    return (10 * F.least(a, b) >= 8 * F.greatest(a, b))


def rare_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates from single signatures: signatures are brought together and
    sorted, and each short run of equal ones gives its pairs, with one row
    per distinct pair of a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            if not len(b) and rest is None:
                continue
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b.sig.iloc[-1]
            cut = int(b.sig.searchsorted(last))
            rest, b = b.iloc[cut:], b.iloc[:cut]
            yield pairs_of(b)
        if rest is not None:
            yield pairs_of(rest)

    def pairs_of(b: pd.DataFrame) -> pd.DataFrame:
        sig, doc, n = (b[c].to_numpy() for c in ("sig", "doc_id", "n"))
        out, far = [], 1
        here = np.arange(len(sig))
        while len(here):                      # pairs at distance far within a run
            here = here[here + far < len(sig)]
            here = here[sig[here] == sig[here + far]]
            p, q = here, here + far
            ok = 10 * np.minimum(n[p], n[q]).astype(np.int64) >= 8 * np.maximum(n[p], n[q]).astype(np.int64)
            ok &= doc[p] != doc[q]
            p, q = p[ok], q[ok]
            out.append(np.column_stack([np.minimum(doc[p], doc[q]), np.maximum(doc[p], doc[q])]))
            far += 1
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame(got, columns=["a", "b"])

    rows = nodes.select(F.explode("single").alias("sig"), "doc_id", "n")
    return (rows.repartition("sig").sortWithinPartitions("sig")
            .mapInPandas(run, "a long, b long").distinct())


def frequent_groups(nodes: DataFrame) -> DataFrame:
    """(sig, doc_id, n, pivot, pivot_n) of the combination signatures that more
    than one node has. The pivot is the smallest of a hash that is alike for
    a quarter of the signatures, so that a group of copies has few pivots."""
    rows = nodes.select(F.explode(F.array_distinct("pairs")).alias("sig"), "doc_id", "n")
    order = F.xxhash64("doc_id", F.pmod("sig", F.lit(PIVOTS)))
    groups = (rows.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.struct(order, "doc_id", "n")).alias("p"))
              .where("c > 1").select("sig", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("pivot_n")))
    return rows.join(groups, "sig")


def bounded(pairs: DataFrame, maps: DataFrame, column: str = "bitmap") -> DataFrame:
    """Candidates that the bitmaps allow: the symmetric difference is at least
    the number of bits in which they differ, and at most 0.2 / 1.8 of the
    sizes' sum in a linked pair. A pair without one of them stays."""
    def side(x: str) -> DataFrame:
        return maps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"m_{x}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = np.flatnonzero((b.m_a.notna() & b.m_b.notna()).to_numpy())
            if len(known):
                near = b.iloc[known]
                total = near.n_a.to_numpy(np.int64) + near.n_b.to_numpy(np.int64)
                ok = np.ones(len(b), bool)
                ok[known] = 18 * differing(near.m_a.tolist(), near.m_b.tolist()) <= 2 * total
                b = b[ok]
            yield b[["a", "b"]]

    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .mapInPandas(run, "a long, b long"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that link, decided on the whole shingle sets. Only texts that may
    be in a pair are shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b.t_a, b.t_b):
                s, t = shingle_hashes(x, WIDTH), shingle_hashes(y, WIDTH)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= 80 * (len(s) + len(t) - both))
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    def side(x: str) -> DataFrame:
        return needed.select(F.col("doc_id").alias(x), F.col("t").alias(f"t_{x}"))

    spark = pairs.sparkSession
    small_batches(spark, LIGHT_ROWS)
    pairs = materialized(pairs)
    if pairs.isEmpty():
        return pairs
    small_batches(spark)
    needed = materialized(flagged(texts, "doc_id", pairs.select(F.explode(F.array("a", "b")).alias("id"))))
    links = materialized(pairs.join(side("a"), "a").join(side("b"), "b")
                         .mapInPandas(run, "a long, b long").distinct())
    discard(needed)
    discard(pairs)
    release(spark)
    return links


def apart(pairs: DataFrame, labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs whose ends are in different components."""
    def side(x: str) -> DataFrame:
        return labels.select(F.col("node").alias(x), F.col("component").alias(f"_c_{x}"))

    return (pairs.join(side(a), a, "left").join(side(b), b, "left")
            .where(F.coalesce(f"_c_{a}", a) != F.coalesce(f"_c_{b}", b)).drop(f"_c_{a}", f"_c_{b}"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    spark = docs.sparkSession
    flags, _ = sketch(docs, text)
    rows = materialized(sets_of(docs, key, text))
    # equal sets are one node: the smallest id stands for them
    same = ["x", "y", "n"]
    first = (rows.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node")))
    member = materialized(rows.join(first, same, "left").select("doc_id", "n", *same[:2], "node"))
    # signatures are made in a second pass over the texts and written once,
    # for the nodes only
    release(spark)
    stands = member.where("doc_id = node").select("doc_id", *same).distinct()
    nodes = materialized(
        indexed(docs, flags, key, text).join(stands, ["doc_id", *same], "left_semi")
        .dropDuplicates(["doc_id", *same]).select("doc_id", "n", "single", "pairs", "bitmap", "wide"))
    member = member.select("doc_id", "n", "node")
    discard(rows)
    release(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))

    small_batches(spark, LIGHT_ROWS)
    groups = materialized(frequent_groups(nodes))
    release(spark)
    star = (groups.where(length_ok(F.col("n"), F.col("pivot_n")) & (F.col("doc_id") != F.col("pivot")))
            .select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")))
    first_pass = materialized(bounded(rare_pairs(nodes).unionByName(star).distinct(), nodes))
    maps = materialized(nodes.select("doc_id", "n", "bitmap"))
    wide = materialized(nodes.select("doc_id", "n", "wide"))
    discard(nodes)
    candidates = materialized(bounded(first_pass, wide, "wide"))
    discard(first_pass)
    release(spark)

    # ids that have several sets are one node as well
    several = member.where("node is not null").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("top")).where("a < top").select("doc_id", "a")
    links = several.join(member, "doc_id").where("node > a").select("a", F.col("node").alias("b"))

    links = links.unionByName(verified(candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts))
    labels = materialized(components(links))
    more = verified(apart(candidates, labels), texts)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = materialized(components(links))

    # members of frequent groups outside their pivot's component meet the
    # others: first the nearest of each component, then whatever is still apart
    seen = candidates
    for nearest in (True, False):
        small_batches(spark, LIGHT_ROWS)
        pairs = stray_pairs(groups, labels, maps, nearest)
        if pairs is None:
            break
        late = materialized(bounded(pairs.join(seen, ["a", "b"], "left_anti"), wide, "wide"))
        discard(pairs)
        more = verified(late, texts)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = materialized(components(links))
        seen = seen.unionByName(late)
    for done in (groups, maps, wide, seen):
        discard(done)
    return (member.join(labels, member.node == labels.node, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", member.node, "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: the one whose id is the component's;
    rows with a null id stay too. Of rows that share that id, one stays."""
    classes = jaccard_components(docs, key, text)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    stays = docs.join(kept, key, "left_semi").dropDuplicates([key])
    return stays.unionByName(docs.where(F.col(key).isNull()))

"""Integrated syntactic graphs as DataFrames.

A document graph is two tables: ``nodes(doc_id, node, pos_tag)`` and
``edges(doc_id, src, dst, dep, dist)``. Node key = ``lower(text)_POS``; every
sentence adds ``ROOT_0``. Building is a projection of the token table plus
one grouped aggregate: sentence graphs and their composition fuse into a
single shuffle keyed by (doc_id, src, dst) where the attributes of the last
token (by sentence, position) win - the networkx "later update wins" rule.

A parser hands over a document at a time, and a graph never leaves its
document. ``parses(doc_id, copies, sents)`` therefore holds a document a row,
its sentences as ``array<struct<sent_id, a: array<token>>>`` sorted by position
(``copies``: rows of the documents table with that id). On it heads, edges,
composition, nodes and fallback are expressions within the row: tokens and
edges are neither shuffled nor sorted beyond their document. Documents that come
with ``texts`` and without ``sents`` are annotated by ``surface_annotate``'s
rules as they are read, by batches in Arrow (``textgraph``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.scalar import dep_id, pos_id
from lexiscope.operators import textgraph
from lexiscope.operators.textgraph import ROOT

# Fallback graph for documents with < 2 nodes or no edge (fixed values).
DUMMY_NODES = [("DUMMY_NOUN", "NOUN"), ("FILLER_VERB", "VERB")]
DUMMY_EDGE = ("DUMMY_NOUN", "FILLER_VERB", "dep", 1.0)

# Surface annotator word classes (fixed values, SURVEY §7.4).
CLOSED_CLASSES = [
    ("DET", ["the", "a", "an"]),
    ("ADP", ["of", "in", "on", "at", "by", "with", "for", "to", "from"]),
    ("CCONJ", ["and", "or", "but"]),
    ("AUX", ["is", "are", "was", "were", "be"]),
    ("PRON", ["he", "she", "it", "they", "we", "you", "i"]),
]
DEP_BY_POS = [("PUNCT", "punct"), ("DET", "det"), ("ADP", "case"), ("CCONJ", "cc"),
              ("AUX", "aux"), ("PRON", "nsubj"), ("NUM", "nummod")]


def surface_annotate(raw: DataFrame, tok: str = "tok") -> DataFrame:
    """Deterministic stand-in for a parser: ``raw(doc_id, sent_id, i, tok)`` ->
    ``tokens(doc_id, sent_id, i, text, lemma, pos, dep, head_i)``. Head = the
    previous token; the first token of a sentence is the root. Real parses
    can be supplied in the same schema instead."""
    t = F.col(tok)
    d = raw.select("doc_id", "sent_id", "i", t.alias("text"), t.alias("lemma"), surface_pos(t).alias("pos"))
    return d.select("doc_id", "sent_id", "i", "text", "lemma", "pos", surface_dep(F.col("i"), F.col("pos")).alias("dep"),
                    surface_head(F.col("i")).alias("head_i"))


def surface_pos(t: Column) -> Column:
    pos = F.when(~t.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(t.rlike(r"^\p{N}+$"), "NUM")
    for tag, words in CLOSED_CLASSES:
        pos = pos.when(t.isin(words), tag)
    return pos.otherwise("NOUN")


def surface_dep(i: Column, pos: Column) -> Column:
    dep = F.when(i == 0, "ROOT")
    for p, rel in DEP_BY_POS:
        dep = dep.when(pos == p, rel)
    return dep.otherwise("dep")


def surface_head(i: Column) -> Column:
    return F.when(i == 0, 0).otherwise(i - 1).cast("int")


def surface_sentence(toks: Column) -> Column:
    """``surface_annotate`` for the tokens of one sentence, an array."""
    tagged = F.transform(toks, lambda t, i: F.struct(i.alias("i"), t.alias("text"), surface_pos(t).alias("pos")))
    return F.transform(tagged, lambda t: F.struct(
        t["i"].alias("i"), t["text"].alias("text"), t["text"].alias("lemma"), t["pos"].alias("pos"),
        surface_dep(t["i"], t["pos"]).alias("dep"), surface_head(t["i"]).alias("head_i")))


_INFO_COLS = ["doc_id", "sent_id", "i", "text", "lemma", "pos", "dep", "head_i",
              "head_text", "head_lemma", "head_pos", "is_root"]


def token_info(tokens: DataFrame) -> DataFrame:
    """G1: each token with its head's text, lemma and POS, and ``is_root``.

    Heads live in the same sentence. Tokens are grouped per sentence (one
    shuffle; a sentence is bounded by its document) into an array sorted by
    position and exploded again in the same pass. Where positions are
    contiguous (the usual parser output) the head is an O(1) array access;
    a sentence with gaps in its positions finds the head with
    ``array_position`` over that sentence's positions instead, so any token
    table gives the right result without a second branch or a join."""
    tok = F.struct("i", "text", "lemma", "pos", "dep", "head_i")
    s = tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(tok)).alias("a"))
    s = s.select("doc_id", "sent_id", "a", F.col("a")[0]["i"].alias("i0"),
                 ((F.element_at("a", -1)["i"] - F.col("a")[0]["i"]) == F.size("a") - 1).alias("dense"),
                 F.transform("a", lambda x: x["i"]).alias("ix"))
    r = s.select("doc_id", "sent_id", "a", "i0", "dense", "ix", F.explode("a").alias("t"))
    k = F.when(F.col("dense"), (F.col("t.head_i") - F.col("i0") + 1).cast("int")).otherwise(
        F.array_position(F.col("ix"), F.col("t.head_i")).cast("int"))
    h = F.when((k >= 1) & (k <= F.size("a")), F.element_at(F.col("a"), k))
    return r.select("doc_id", "sent_id", "t.i", "t.text", "t.lemma", "t.pos", "t.dep", "t.head_i",
                    h["text"].alias("head_text"), h["lemma"].alias("head_lemma"), h["pos"].alias("head_pos"),
                    (F.col("t.dep") == "ROOT").alias("is_root"))


def node_key(text: Column, pos: Column) -> Column:
    return F.concat_ws("_", F.lower(text), pos)


def graph_nodes(tokens: DataFrame) -> DataFrame:
    """Distinct nodes per document: ``ROOT_0`` plus ``lower(text)_POS``."""
    # every token contributes its own node and its document's ROOT_0; the
    # distinct collapses repeats map-side (partial aggregation), one pass
    pair = F.array(F.struct(node_key(F.col("text"), F.col("pos")).alias("node"), F.col("pos").alias("pos_tag")),
                   F.struct(F.lit(ROOT).alias("node"), F.lit(ROOT).alias("pos_tag")))
    return tokens.select("doc_id", F.explode(pair).alias("n")).select("doc_id", "n.node", "n.pos_tag").distinct()


def token_edges(info: DataFrame) -> DataFrame:
    """One edge per token: ``ROOT_0 -> token`` for the root, else
    ``head -> token``; attributes dep and ``1/|i - head_i|`` (1.0 at 0)."""
    dst = node_key(F.col("text"), F.col("pos"))
    src = F.when(F.col("is_root"), F.lit(ROOT)).otherwise(node_key(F.col("head_text"), F.col("head_pos")))
    dist = F.abs(F.col("i") - F.col("head_i"))
    nd = F.when(dist > 0, F.lit(1.0) / dist).otherwise(F.lit(1.0))
    return info.select("doc_id", "sent_id", "i", src.alias("src"), dst.alias("dst"),
                       F.col("dep"), nd.alias("dist"))


def compose_edges(tedges: DataFrame, directed: bool = True) -> DataFrame:
    """G4 + G5 in one shuffle: a simple graph per document where parallel
    edges collapse and the attributes of the last (sent_id, i) win.
    Undirected graphs key edges by the ordered endpoint pair."""
    e = tedges
    if not directed:
        e = e.select("doc_id", "sent_id", "i", F.least("src", "dst").alias("src"),
                     F.greatest("src", "dst").alias("dst"), "dep", "dist")
    order = F.struct(F.col("sent_id"), F.col("i"))
    g = e.groupBy("doc_id", "src", "dst").agg(F.max_by(F.struct("dep", "dist"), order).alias("a"))
    return g.select("doc_id", "src", "dst", "a.dep", "a.dist")


def build_graph(tokens: DataFrame, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Tokens -> (nodes, edges) before the fallback."""
    return graph_nodes(tokens), compose_edges(token_edges(token_info(tokens)), directed)


# ---- a document a row

def _with_heads(parses: DataFrame) -> DataFrame:
    """Adds ``look``: per sentence its first position, whether positions are
    contiguous (a head is then found by its distance from the first one, else
    by ``array_position``), the positions where they are not, the node keys."""
    def look(s):
        first, last = F.get(s["a"], F.lit(0))["i"], F.try_element_at(s["a"], F.lit(-1))["i"]
        dense = (last - first) == F.size(s["a"]) - 1
        return F.struct(first.alias("i0"), dense.alias("dense"),
                        F.when(~dense, F.transform(s["a"], lambda t: t["i"])).alias("ix"),
                        F.transform(s["a"], lambda t: node_key(t["text"], t["pos"])).alias("keys"))
    return parses.withColumn("look", F.transform("sents", look))


def _head_at(look: Column, head_i: Column) -> Column:
    """Index (from 0) of a head in its sentence's array; outside it: none."""
    return F.when(look["dense"], head_i - look["i0"]).otherwise(
        F.array_position(look["ix"], head_i).cast("int") - 1).cast("int")


def parse_info(parses: DataFrame) -> DataFrame:
    """``token_info`` of documents as rows."""
    def sentence(s, k):
        look = F.get("look", k)

        def token(t):
            h = F.get(s["a"], _head_at(look, t["head_i"]))
            return F.struct(s["sent_id"].alias("sent_id"), *[t[c].alias(c) for c in ("i", "text", "lemma", "pos", "dep", "head_i")],
                            h["text"].alias("head_text"), h["lemma"].alias("head_lemma"), h["pos"].alias("head_pos"),
                            (t["dep"] == "ROOT").alias("is_root"))
        return F.transform(s["a"], token)
    info = _with_heads(parses).select("doc_id", F.flatten(F.transform("sents", sentence)).alias("t"))
    return rows_of(info, "t").select(*_INFO_COLS)


def with_edges(parses: DataFrame) -> DataFrame:
    """Adds ``edges``, an edge per token (see ``token_edges``)."""
    def sentence(s, k):
        look = F.get("look", k)

        def edge(t, j):
            src = F.when(t["dep"] == "ROOT", F.lit(ROOT)).otherwise(
                F.coalesce(F.get(look["keys"], _head_at(look, t["head_i"])), F.lit("")))
            dist = F.abs(t["i"] - t["head_i"])
            return F.struct(src.alias("src"), F.get(look["keys"], j).alias("dst"), s["sent_id"].alias("sent_id"),
                            t["i"].alias("i"), t["dep"].alias("dep"),
                            F.when(dist > 0, F.lit(1.0) / dist).otherwise(F.lit(1.0)).alias("dist"))
        return F.transform(s["a"], edge)
    return _with_heads(parses).withColumn("edges", F.flatten(F.transform("sents", sentence))).drop("look")


def parse_edges(parses: DataFrame) -> DataFrame:
    """``token_edges`` of documents as rows."""
    return rows_of(with_edges(parses), "edges").select("doc_id", "sent_id", "i", "src", "dst", "dep", "dist")


def _last_of_key(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    """Sorts an array of structs, whose first fields are ``key``, and keeps
    the last one of each key."""
    def last(x, j):
        other = j == F.size(column) - 1
        for c in key:
            other = other | ~x[c].eqNullSafe(F.get(F.col(column), j + 1)[c])
        return other

    df = df.withColumn(column, F.array_sort(column))
    return df.withColumn(column, F.filter(column, last))


def with_sentence_graphs(parses: DataFrame) -> DataFrame:
    """``edges`` a simple directed graph per sentence."""
    fields = ("sent_id", "src", "dst", "i", "dep", "dist")
    e = with_edges(parses).withColumn("edges", F.transform("edges", lambda x: F.struct(*[x[c].alias(c) for c in fields])))
    return _last_of_key(e, "edges", ["sent_id", "src", "dst"])


def with_graph(parses: DataFrame, directed: bool = True) -> DataFrame:
    """Adds ``edges`` (the document graph: of parallel edges
    the last by sentence and position) and ``nodes``."""
    e = with_edges(parses)
    if not directed:
        e = e.withColumn("edges", F.transform("edges", lambda x: F.struct(
            F.least(x["src"], x["dst"]).alias("src"), F.greatest(x["src"], x["dst"]).alias("dst"),
            *[x[c].alias(c) for c in ("sent_id", "i", "dep", "dist")])))
    return _last_of_key(e, "edges", ["src", "dst"])


def with_nodes(parses: DataFrame) -> DataFrame:
    """Adds ``nodes``, the distinct nodes of a document with tokens."""
    root = F.struct(F.lit(ROOT).alias("node"), F.lit(ROOT).alias("pos_tag"))
    own = F.flatten(F.transform("sents", lambda s: F.transform(s["a"], lambda t: F.struct(
        node_key(t["text"], t["pos"]).alias("node"), t["pos"].alias("pos_tag")))))
    n = parses.withColumn("nodes", own)
    n = n.withColumn("nodes", F.when(F.size("nodes") > 0, F.concat(F.array(root), "nodes")).otherwise(F.col("nodes")))
    return _last_of_key(n, "nodes", ["node", "pos_tag"])


def _unparsed(docs: DataFrame) -> bool:
    return "sents" not in docs.columns


def usable() -> Column:
    """Whether a document's graph stands (at least 2 nodes and an edge)."""
    return F.col("doc_id").isNotNull() & (F.size("nodes") >= 2) & (F.size("edges") >= 1)


def parse_graph(parses: DataFrame, directed: bool = True) -> DataFrame:
    """G2 to G5 in the row: ``nodes`` and ``edges`` in place of the sentences."""
    if _unparsed(parses):
        return textgraph.graphs(parses, directed, False)
    return with_graph(with_nodes(parses), directed).select(
        *[c for c in parses.columns if c != "sents"], "nodes", F.transform("edges", lambda x: F.struct(
            *[x[c].alias(c) for c in ("src", "dst", "dep", "dist")])).alias("edges"))


def parse_graph_with_fallback(parses: DataFrame, directed: bool = True) -> DataFrame:
    """G6 in the row: the fixed graph, once a copy, where the own one is not
    usable."""
    if _unparsed(parses):
        return textgraph.graphs(parses, directed, True)
    g = parse_graph(parses, directed)
    dn = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(p).alias("pos_tag")) for n, p in DUMMY_NODES])
    de = F.array(F.struct(*[F.lit(v).alias(c) for v, c in zip(DUMMY_EDGE, ("src", "dst", "dep", "dist"))]))
    times = F.col("copies").cast("int")
    return g.select(*[c for c in g.columns if c not in ("nodes", "edges")],
                    F.when(usable(), F.col("nodes")).otherwise(F.flatten(F.array_repeat(dn, times))).alias("nodes"),
                    F.when(usable(), F.col("edges")).otherwise(F.flatten(F.array_repeat(de, times))).alias("edges"))


def rows_of(graphs: DataFrame, column: str) -> DataFrame:
    """The elements of an array as rows with their document. (For a plain
    ``explode`` the optimiser infers a filter on the array's size and pushes it
    below the steps that make the array, which then run once an element.)"""
    rows = graphs.select("doc_id", F.explode_outer(column).alias("x")).where(F.col("x").isNotNull())
    return rows.select("doc_id", "x.*")


def parse_stats(parses: DataFrame) -> DataFrame:
    """G6 + G7 of documents as rows, a row for each copy."""
    if _unparsed(parses):
        g = textgraph.sizes(parses)
        ok, n, e = F.col("usable"), F.col("n_nodes"), F.col("n_edges")
    else:
        g = parse_graph(parses)
        ok, n, e = usable(), F.size("nodes"), F.size("edges")
    return g.select("doc_id", F.when(ok, n).otherwise(F.lit(len(DUMMY_NODES))).cast("long").alias("n_nodes"),
                    F.when(ok, e).otherwise(F.lit(1)).cast("long").alias("n_edges"),
                    F.lit("success").alias("status"),
                    F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def parse_relation_frequency(graphs: DataFrame) -> DataFrame:
    """``relation_frequency`` of documents as rows: the counts of a document's
    few labels, looked up by its edges."""
    g = graphs.where(F.col("doc_id").isNotNull()).withColumn("_deps", F.array_distinct("edges.dep"))
    g = g.withColumn("_k", F.transform("_deps", lambda d: F.size(F.filter("edges", lambda e: e["dep"] == d))))
    # looked up behind the generator: within a lambda the optimiser would put the counting in place of "_k"
    e = g.select("doc_id", "_deps", "_k", F.explode_outer("edges").alias("x")).where("x.dep is not null")
    k = F.get("_k", (F.array_position("_deps", F.col("x.dep")) - 1).cast("int")) + 1
    return e.select("doc_id", "x.src", "x.dst", F.concat_ws("_", F.col("x.dep"), k.cast("string")).alias("dep"), "x.dist")


def with_fallback(docs: DataFrame, nodes: DataFrame, edges: DataFrame,
                  spark=None) -> tuple[DataFrame, DataFrame]:
    """Documents whose graph has fewer than 2 nodes or no edge get the
    fixed two-node graph instead (documents without tokens included)."""
    nn = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    ne = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"))
    good = nn.join(ne, "doc_id").where((F.col("n_nodes") >= 2) & (F.col("n_edges") >= 1)).select("doc_id")
    bad = docs.select("doc_id").join(good, "doc_id", "left_anti")
    dn = bad.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(p).alias("pos_tag"))
                                                  for n, p in DUMMY_NODES])).alias("x")).select("doc_id", "x.*")
    s, d, dep, dist = DUMMY_EDGE
    de = bad.select("doc_id", F.lit(s).alias("src"), F.lit(d).alias("dst"), F.lit(dep).alias("dep"),
                    F.lit(dist).alias("dist"))
    gn = nodes.join(good, "doc_id", "left_semi")
    ge = edges.join(good, "doc_id", "left_semi")
    return gn.unionByName(dn), ge.unionByName(de)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document node and edge counts and status."""
    nn = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    ne = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return nn.join(ne, "doc_id", "full_outer").select(
        "doc_id", F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"),
        F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), F.lit("success").alias("status"))


def graph_stats_with_fallback(docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G6 + G7 without building the fallback tables: node and edge counts are
    taken once; documents with fewer than 2 nodes or no edge report the
    fallback graph's (2, 1)."""
    nn = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nn"))
    ne = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ne"))
    j = docs.select("doc_id").join(nn, "doc_id", "left").join(ne, "doc_id", "left")
    ok = (F.coalesce(F.col("nn"), F.lit(0)) >= 2) & (F.coalesce(F.col("ne"), F.lit(0)) >= 1)
    return j.select("doc_id",
                    F.when(ok, F.col("nn")).otherwise(F.lit(len(DUMMY_NODES))).cast("long").alias("n_nodes"),
                    F.when(ok, F.col("ne")).otherwise(F.lit(1)).cast("long").alias("n_edges"),
                    F.lit("success").alias("status"))


def graph_averages(stats: DataFrame) -> DataFrame:
    """Mean node / edge count per document."""
    return stats.agg(F.avg("n_nodes").alias("avg_nodes"), F.avg("n_edges").alias("avg_edges"))


def relation_frequency(edges: DataFrame) -> DataFrame:
    """Dep becomes ``dep_k`` with k = edges of that dep in the document
    graph + edges between the endpoints (1 in a simple graph). The per-dep
    counts are a small aggregate joined back on (doc_id, dep)."""
    c = edges.groupBy("doc_id", "dep").agg(F.count(F.lit(1)).alias("_k"))
    j = edges.join(c, ["doc_id", "dep"])
    return j.select("doc_id", "src", "dst", F.concat_ws("_", F.col("dep"), (F.col("_k") + 1).cast("string")).alias("dep"),
                    "dist")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge, self-loops once."""
    there = F.struct("src", "dst")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = F.when(F.col("src") != F.col("dst"), F.array(there, back)).otherwise(F.array(there))
    return edges.withColumn("_way", F.explode(ways)).select(
        *[F.col(f"_way.{c}") if c in ("src", "dst") else F.col(c) for c in edges.columns])


def node_word(node: Column) -> Column:
    """Word part of a node key: text before the first ``_``."""
    return F.lower(F.substring_index(node, "_", 1))


def node_vectors(nodes: DataFrame, token_ids: DataFrame, vectors: DataFrame, dim: int,
                 max_len: int = 512) -> DataFrame:
    """Vector per node. ``ROOT_0`` takes position 0 (the whole-document
    vector); other nodes the vector of the last token (within ``max_len``)
    whose text equals the node word; no match -> zeros. ``matched`` flags it.

    ``token_ids(doc_id, pos, token, vec_id)`` references ``vectors(vec_id,
    vec)``: the last position per (doc, token) is chosen on the narrow table
    and only the winners fetch their vectors."""
    t = token_ids.where(F.col("pos") < max_len)
    last = t.where(F.col("pos") > 0).groupBy("doc_id", F.lower(F.col("token")).alias("word")).agg(
        F.max_by("vec_id", "pos").alias("vec_id"))
    first = t.where(F.col("pos") == 0).select("doc_id", F.lit(ROOT).alias("node"), F.col("vec_id").alias("root_vec"))
    n = nodes.select("doc_id", "node", "pos_tag", node_word(F.col("node")).alias("word"))
    j = n.join(last, ["doc_id", "word"], "left").join(first, ["doc_id", "node"], "left")
    vid = F.when(F.col("node") == ROOT, F.col("root_vec")).otherwise(F.col("vec_id"))
    j = j.select("doc_id", "node", "pos_tag", vid.alias("vec_id"))
    v = vectors.select("vec_id", F.col("vec").cast("array<double>").alias("vec"))
    out = j.join(v, "vec_id", "left")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return out.select("doc_id", "node", "pos_tag", F.coalesce(F.col("vec"), zeros).alias("vec"),
                      F.col("vec").isNotNull().alias("matched"))


def node_match_rate(nv: DataFrame) -> DataFrame:
    """Matched vs unmatched nodes overall."""
    return nv.agg(F.sum(F.col("matched").cast("long")).alias("matched"),
                  F.sum((~F.col("matched")).cast("long")).alias("unmatched"))


def seeded_table(spark, n_rows: int, dim: int, seed: int) -> DataFrame:
    """A fixed ``n_rows × dim`` table in [-0.5, 0.5) from an integer rule
    (stand-in for a seeded embedding init; reproducible in SQL)."""
    r = spark.range(n_rows).select(F.col("id").cast("int").alias("k"))
    vals = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda j: ((F.col("k") * 7919 + j * 104729 + seed * 31) % 1000).cast("double") / 1000.0 - 0.5)
    return r.select("k", vals.alias("emb"))


def concat_pos(nv: DataFrame, pos_table: DataFrame) -> DataFrame:
    """Node vector ++ embedding of its POS id (B16). The table has 18
    rows, so it is broadcast."""
    j = nv.withColumn("k", pos_id(F.col("node"))).join(F.broadcast(pos_table), "k")
    return j.select("doc_id", "node", F.concat(F.col("vec"), F.col("emb")).alias("vec"))


def edge_vectors(edges: DataFrame, dep_table: DataFrame) -> DataFrame:
    """Per edge the embedding of its dep id (B18); 24-row broadcast."""
    j = edges.withColumn("k", dep_id(F.col("dep"))).join(F.broadcast(dep_table), "k")
    return j.select("doc_id", "src", "dst", "dep", "dist", "k", F.col("emb").alias("evec"))


def pool(nv: DataFrame, how: str = "mean", key: str = "doc_id", vec: str = "vec") -> DataFrame:
    """Mean / max / sum of node vectors per document with Spark ML's
    Summarizer (a partially aggregated vector aggregate; no per-dimension
    explode)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = nv.select(key, array_to_vector(F.col(vec)).alias("_v"))
    fn = {"mean": Summarizer.mean, "max": Summarizer.max, "sum": Summarizer.sum}[how]
    return v.groupBy(key).agg(vector_to_array(fn(F.col("_v"))).alias(vec))


def attention_pool(nv: DataFrame, gate: list[float], key: str = "doc_id", vec: str = "vec") -> DataFrame:
    """Softmax over a document's nodes of ``gate · x``, weighted sum.
    The max-shift uses the per-document max score (an aggregate joined back)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    g = F.array(*[F.lit(float(x)) for x in gate])
    s = nv.select(key, vec, F.aggregate(F.zip_with(F.col(vec), g, lambda a, b: a * b), F.lit(0.0),
                                         lambda acc, x: acc + x).alias("_s"))
    m = s.groupBy(key).agg(F.max("_s").alias("_m"))
    w = s.join(m, key).select(key, array_to_vector(F.col(vec)).alias("_v"), F.exp(F.col("_s") - F.col("_m")).alias("_w"))
    agg = w.groupBy(key).agg(Summarizer.sum(F.col("_v"), F.col("_w")).alias("_sv"), F.sum("_w").alias("_z"))
    return agg.select(key, F.transform(vector_to_array(F.col("_sv")), lambda x: x / F.col("_z")).alias(vec))


def propagate(nv: DataFrame, edges: DataFrame, hops: int = 1, directed: bool = False) -> DataFrame:
    """``hops`` rounds of ``D^-1/2 (A + I) D^-1/2 X`` without learnt
    weights. Messages flow src -> dst (undirected edges are symmetrised
    first); deg = 1 + in-degree. Each round is a join of edges with node
    vectors and a weighted vector sum per target node (Summarizer with a
    weight column), partially aggregated before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    e = edges.select("doc_id", "src", "dst")
    if not directed:
        e = symmetrize(e)
    e = e.where(F.col("src") != F.col("dst")).distinct()
    deg = e.groupBy("doc_id", F.col("dst").alias("node")).agg((F.count(F.lit(1)) + 1).alias("deg"))
    x = nv.select("doc_id", "node", "vec")
    nodes_deg = x.select("doc_id", "node").join(deg, ["doc_id", "node"], "left").select(
        "doc_id", "node", F.coalesce(F.col("deg"), F.lit(1)).cast("double").alias("deg"))
    for _ in range(hops):
        xs = x.join(nodes_deg, ["doc_id", "node"])
        msg = (e.join(xs.select("doc_id", F.col("node").alias("src"), F.col("vec").alias("sv"),
                                F.col("deg").alias("sdeg")), ["doc_id", "src"])
                .join(nodes_deg.select("doc_id", F.col("node").alias("dst"), F.col("deg").alias("ddeg")),
                      ["doc_id", "dst"])
                .select("doc_id", F.col("dst").alias("node"), "sv",
                        (F.lit(1.0) / F.sqrt(F.col("sdeg") * F.col("ddeg"))).alias("w")))
        self_msg = xs.select("doc_id", "node", F.col("vec").alias("sv"), (F.lit(1.0) / F.col("deg")).alias("w"))
        allm = msg.unionByName(self_msg).select("doc_id", "node", array_to_vector(F.col("sv")).alias("_v"), "w")
        x = allm.groupBy("doc_id", "node").agg(vector_to_array(Summarizer.sum(F.col("_v"), F.col("w"))).alias("vec"))
    return x


def projection_matrix(d_in: int, d_out: int = 256, seed: int = 42):
    """Seeded Gaussian random projection (d_in x d_out), scaled 1/sqrt(d_in).
    Fixed size, so shipping it to every task is bounded."""
    import numpy as np
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((d_in, d_out)) / np.sqrt(d_in)).astype("float64")


def project(nv: DataFrame, matrix, vec: str = "vec") -> DataFrame:
    """Linear map of every node vector, Arrow-batched with
    ``mapInPandas`` (one numpy matrix product per batch, not per row)."""
    import numpy as np
    mat = np.asarray(matrix, dtype="float64")
    bmat = nv.sparkSession.sparkContext.broadcast(mat)
    keep = [c for c in nv.columns if c != vec]
    from pyspark.sql.types import ArrayType, DoubleType
    schema = nv.select(*keep).schema.add("vec", ArrayType(DoubleType()))

    def run(batches):
        m = bmat.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec].to_numpy())
            out = pdf[keep].copy()
            out["vec"] = list(x @ m)
            yield out

    return nv.mapInPandas(run, schema)

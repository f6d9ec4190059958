"""Token-graph queries over the surface-annotated token table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import scalar as S
from lexiscope.operators import docvectors as DV
from lexiscope.operators import graph as G
from lexiscope.plans.catalog import register
from lexiscope.plans.oracle import with_ctes
from lexiscope.sources import fixtures as X
from lexiscope.sources.conllu import read_parses, write_parses
from lexiscope.sources.files import scratch_path
from lexiscope.sources.tables import table

DIM = 64


def stats(spark, sf_dir):
    """Per-document node / edge counts with the fallback rule applied."""
    return G.parse_stats(X.grouped_texts(spark, sf_dir))


def graphs(spark, sf_dir, directed=True):
    """(nodes, edges) per document after the fallback rule."""
    g = G.parse_graph_with_fallback(X.grouped_texts(spark, sf_dir), directed)
    return G.rows_of(g, "nodes"), G.rows_of(g, "edges")


def composed(spark, sf_dir, directed=True):
    """Edges of the document graphs before the fallback."""
    return G.rows_of(G.with_graph(X.parses(spark, sf_dir), directed), "edges").drop("sent_id", "i")


@register("tokens", with_ctes(["tokens"]) + "SELECT doc_id, sent_id, i, text, lemma, pos, dep, head_i FROM tokens")
def q_tokens(spark, sf_dir):
    """Surface annotation (input of the graph jobs)."""
    return X.tokens(spark, sf_dir)


@register("token_info", with_ctes(["heads"]) + """
SELECT doc_id, sent_id, i, text, pos, dep, head_text, head_lemma, head_pos, dep = 'ROOT' AS is_root FROM heads""")
def q_token_info(spark, sf_dir):
    """G1: tokens with their head's text, lemma and POS."""
    return G.parse_info(X.parses(spark, sf_dir)).select(
        "doc_id", "sent_id", "i", "text", "pos", "dep", "head_text", "head_lemma", "head_pos", "is_root")


@register("graph_nodes", with_ctes(["nodes"]) + "SELECT doc_id, node, pos_tag FROM nodes")
def q_graph_nodes(spark, sf_dir):
    """Distinct graph nodes per document."""
    return G.graph_nodes(X.tokens(spark, sf_dir))


@register("graph_edges", with_ctes(["token_edges"]) + "SELECT doc_id, sent_id, i, src, dst, dep, dist FROM token_edges")
def q_graph_edges(spark, sf_dir):
    """One edge per token with dep and normalised distance."""
    return G.parse_edges(X.parses(spark, sf_dir))


@register("sentence_graph", with_ctes(["token_edges"]) + """
SELECT doc_id, sent_id, src, dst, dep, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, src, dst ORDER BY i DESC) AS rn FROM token_edges) x
WHERE rn = 1""")
def q_sentence_graph(spark, sf_dir):
    """Simple directed graph per sentence (last attributes win)."""
    return G.rows_of(G.with_sentence_graphs(X.parses(spark, sf_dir)), "edges").drop("i")


@register("compose_graph", with_ctes(["edges"]) + "SELECT doc_id, src, dst, dep, dist FROM edges")
def q_compose_graph(spark, sf_dir):
    """Directed document graph (sentence graphs composed in order)."""
    return composed(spark, sf_dir)


@register("compose_graph_undirected", with_ctes(["token_edges"]) + """
SELECT doc_id, src, dst, dep, dist FROM (
  SELECT doc_id, least(src, dst) AS src, greatest(src, dst) AS dst, dep, dist,
         row_number() OVER (PARTITION BY doc_id, least(src, dst), greatest(src, dst) ORDER BY sent_id DESC, i DESC) AS rn
  FROM token_edges) x WHERE rn = 1""")
def q_compose_graph_undirected(spark, sf_dir):
    """G4/G5 undirected: (u, v) and (v, u) are one edge."""
    return composed(spark, sf_dir, False)


@register("fallback_graph", with_ctes(["fedges"]) + "SELECT doc_id, src, dst, dep, dist FROM fedges")
def q_fallback_graph(spark, sf_dir):
    """Document graphs with the two-node fallback for unusable ones."""
    return graphs(spark, sf_dir)[1]


@register("graph_stats", with_ctes(["fnodes", "fedges"]) + """
SELECT n.doc_id, CAST(n.c AS BIGINT) AS n_nodes, CAST(coalesce(e.c, 0) AS BIGINT) AS n_edges, 'success' AS status
FROM (SELECT doc_id, count(*) AS c FROM fnodes GROUP BY doc_id) n
LEFT JOIN (SELECT doc_id, count(*) AS c FROM fedges GROUP BY doc_id) e ON n.doc_id = e.doc_id""")
def q_graph_stats(spark, sf_dir):
    """Node and edge counts per document."""
    return stats(spark, sf_dir)


@register("graph_averages", with_ctes(["fnodes", "fedges"]) + """
SELECT round(avg(n_nodes), 9) AS avg_nodes, round(avg(n_edges), 9) AS avg_edges FROM (
  SELECT n.doc_id, n.c AS n_nodes, coalesce(e.c, 0) AS n_edges
  FROM (SELECT doc_id, count(*) AS c FROM fnodes GROUP BY doc_id) n
  LEFT JOIN (SELECT doc_id, count(*) AS c FROM fedges GROUP BY doc_id) e ON n.doc_id = e.doc_id) s""")
def q_graph_averages(spark, sf_dir):
    """Mean node and edge count per document."""
    a = G.graph_averages(stats(spark, sf_dir))
    return a.select(F.round("avg_nodes", 9).alias("avg_nodes"), F.round("avg_edges", 9).alias("avg_edges"))


@register("attach_text_label", with_ctes(["fnodes", "fedges"]) + """
SELECT n.doc_id, CAST(n.c AS BIGINT) AS n_nodes, l.quality AS label
FROM (SELECT doc_id, count(*) AS c FROM fnodes GROUP BY doc_id) n JOIN labels l ON n.doc_id = l.doc_id""")
def q_attach_text_label(spark, sf_dir):
    """Graph records joined to their labels by id (not by position)."""
    st = stats(spark, sf_dir).select("doc_id", "n_nodes")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return st.join(lab, "doc_id")


@register("relation_frequency", with_ctes(["edges"]) + """
SELECT e.doc_id, e.src, e.dst, concat_ws('_', e.dep, CAST(c.k + 1 AS VARCHAR)) AS dep, e.dist
FROM edges e JOIN (SELECT doc_id, dep, count(*) AS k FROM edges GROUP BY doc_id, dep) c
  ON e.doc_id = c.doc_id AND e.dep = c.dep""")
def q_relation_frequency(spark, sf_dir):
    """Dep labels suffixed with their frequency in the document graph."""
    return G.parse_relation_frequency(G.with_graph(X.parses(spark, sf_dir)))


@register("symmetrize_edges", with_ctes(["token_edges"], ["""ue AS (
  SELECT doc_id, src, dst, dep, dist FROM (
    SELECT doc_id, least(src, dst) AS src, greatest(src, dst) AS dst, dep, dist,
           row_number() OVER (PARTITION BY doc_id, least(src, dst), greatest(src, dst) ORDER BY sent_id DESC, i DESC) AS rn
    FROM token_edges) x WHERE rn = 1)"""]) + """
SELECT doc_id, src, dst, dep, dist FROM ue UNION ALL SELECT doc_id, dst, src, dep, dist FROM ue WHERE src <> dst""")
def q_symmetrize_edges(spark, sf_dir):
    """Both directions of each undirected edge, self-loops once."""
    return G.symmetrize(composed(spark, sf_dir, False))


@register("pos_id", with_ctes(["nodes"]) + f"""
SELECT doc_id, node, CAST(CASE WHEN strpos(node, '_') = 0 THEN {S.POS_TAGS.index('X')}
  ELSE coalesce(list_position({[t for t in S.POS_TAGS]}, split_part(node, '_', -1)) - 1, {S.POS_TAGS.index('X')}) END AS INTEGER) AS pos_id
FROM nodes""")
def q_pos_id(spark, sf_dir):
    """POS index of every graph node (unknown suffix, e.g. ROOT_0's '0', -> X)."""
    return G.graph_nodes(X.tokens(spark, sf_dir)).select("doc_id", "node", S.pos_id(F.col("node")).alias("pos_id"))


@register("pos_one_hot", with_ctes(["nodes"]) + f"""
SELECT doc_id, node, CAST(coalesce(list_position({[t for t in S.POS_TAGS]}, split_part(node, '_', -1)) - 1, -1) AS INTEGER) AS hot,
       CAST(CASE WHEN list_position({[t for t in S.POS_TAGS]}, split_part(node, '_', -1)) IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS total
FROM nodes""")
def q_pos_one_hot(spark, sf_dir):
    """Position of the 1 in each node's 18-wide one-hot POS vector
    (-1 when all zeros) and the vector's sum."""
    v = G.graph_nodes(X.tokens(spark, sf_dir)).select("doc_id", "node", S.pos_one_hot(F.col("node")).alias("v"))
    return v.select("doc_id", "node",
                    F.coalesce(F.array_position(F.col("v"), 1.0) - 1, F.lit(-1)).cast("int").alias("hot"),
                    F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("dep_id", with_ctes(["edges"]) + f"""
SELECT doc_id, src, dst, CAST(coalesce(list_position({[t for t in S.DEP_TAGS]}, dep) - 1, {S.DEP_TAGS.index('dep')}) AS INTEGER) AS dep_id,
       CAST(dist AS DOUBLE) AS dist FROM edges""")
def q_dep_id(spark, sf_dir):
    """Dependency index per edge (unknown -> dep) and distance as double."""
    e = composed(spark, sf_dir)
    return e.select("doc_id", "src", "dst", S.dep_id(F.col("dep")).alias("dep_id"), F.col("dist").cast("double"))


def vector_stream(spark, sf_dir, make, schema):
    """``make`` of ``docvectors`` over the graphs and vectors of all documents."""
    size = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0]      # sets the number of blocks
    docs = X.with_vector_count(spark, sf_dir, X.grouped_texts(spark, sf_dir))
    return DV.stream(docs, X.vectors(spark, sf_dir), DIM, 1 + (size or 0) // DV.BLOCK_BYTES, make, schema,
                     vec_id=X.word_vector_ids)


def node_vecs(spark, sf_dir):
    v = vector_stream(spark, sf_dir, DV.node_rows, "doc_id long, node string, pos_tag string, vec array<double>")
    zeros = F.array_repeat(F.lit(0.0), DIM)
    return v.select("doc_id", "node", "pos_tag", F.coalesce("vec", zeros).alias("vec"), F.col("vec").isNotNull().alias("matched"))


def pooled_vecs(spark, sf_dir, how):
    return vector_stream(spark, sf_dir, DV.pooled(how), "doc_id long, vec array<double>")


@register("node_vectors", with_ctes(["nv"]) + """
SELECT nv.doc_id, nv.node, e.embedding IS NOT NULL AS matched,
       round(coalesce(CAST(e.embedding[1] AS DOUBLE), 0.0), 6) AS v0,
       round(coalesce(list_sum(CAST(e.embedding AS DOUBLE[])), 0.0), 4) AS vsum
FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id""")
def q_node_vectors(spark, sf_dir):
    """Node vectors (first component and sum shown)."""
    v = node_vecs(spark, sf_dir)
    return v.select("doc_id", "node", "matched", F.round(F.col("vec")[0], 6).alias("v0"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("vsum"))


def _rounded(vec: str, digits: int):
    return F.transform(vec, lambda x: F.round(x, digits)).alias("vec")


_NODE_VEC = "coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(range(64), lambda j: 0.0))"


@register("node_vectors_full", with_ctes(["nv"]) + f"""
SELECT nv.doc_id, nv.node, e.embedding IS NOT NULL AS matched, list_transform({_NODE_VEC}, lambda x: round(x, 6)) AS vec
FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id""")
def q_node_vectors_full(spark, sf_dir):
    """Node vectors, all components."""
    return node_vecs(spark, sf_dir).select("doc_id", "node", "matched", _rounded("vec", 6))


@register("node_match_rate", with_ctes(["nv"]) + """
SELECT CAST(sum(CASE WHEN e.embedding IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched,
       CAST(sum(CASE WHEN e.embedding IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched
FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id""")
def q_node_match_rate(spark, sf_dir):
    """Matched vs unmatched nodes."""
    return G.node_match_rate(vector_stream(spark, sf_dir, DV.node_matches, "doc_id long, node string, matched boolean"))


def _seeded_sql(n: int, dim: int, seed: int, name: str) -> str:
    return (f"{name} AS (SELECT CAST(k AS INTEGER) AS k, list_transform(range({dim}), lambda j: "
            f"CAST((k * 7919 + j * 104729 + {seed * 31}) % 1000 AS DOUBLE) / 1000.0 - 0.5) AS emb FROM range({n}) r(k))")


@register("pos_feature_concat", with_ctes(["nv"], [_seeded_sql(18, 32, 1, "pt")]) + f"""
SELECT nv.doc_id, nv.node, CAST({DIM} + 32 AS INTEGER) AS width,
       round(coalesce(list_sum(CAST(e.embedding AS DOUBLE[])), 0.0) + list_sum(pt.emb), 4) AS vsum
FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id
JOIN pt ON pt.k = CASE WHEN strpos(nv.node, '_') = 0 THEN {S.POS_TAGS.index('X')}
  ELSE coalesce(list_position({[t for t in S.POS_TAGS]}, split_part(nv.node, '_', -1)) - 1, {S.POS_TAGS.index('X')}) END""")
def q_pos_feature_concat(spark, sf_dir):
    """Node vector ++ 32-wide POS embedding (seeded 18 x 32 table)."""
    pt = G.seeded_table(spark, len(S.POS_TAGS), 32, 1)
    c = G.concat_pos(node_vecs(spark, sf_dir), pt)
    return c.select("doc_id", "node", F.size("vec").cast("int").alias("width"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("vsum"))


@register("pos_feature_concat_full", with_ctes(["nv"], [_seeded_sql(18, 32, 1, "pt")]) + f"""
SELECT nv.doc_id, nv.node, list_transform(list_concat({_NODE_VEC}, pt.emb), lambda x: round(x, 6)) AS vec
FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id
JOIN pt ON pt.k = CASE WHEN strpos(nv.node, '_') = 0 THEN {S.POS_TAGS.index('X')}
  ELSE coalesce(list_position({[t for t in S.POS_TAGS]}, split_part(nv.node, '_', -1)) - 1, {S.POS_TAGS.index('X')}) END""")
def q_pos_feature_concat_full(spark, sf_dir):
    """Node vector ++ POS embedding, all components."""
    pt = G.seeded_table(spark, len(S.POS_TAGS), 32, 1)
    return G.concat_pos(node_vecs(spark, sf_dir), pt).select("doc_id", "node", _rounded("vec", 6))


def _rounded_table(spark, n: int, dim: int, seed: int):
    """``seeded_table``, rounded in its few rows and not once an edge."""
    return G.seeded_table(spark, n, dim, seed).select("k", F.transform("emb", lambda x: F.round(x, 6)).alias("emb"))


@register("dep_edge_vector", with_ctes(["fedges"], [_seeded_sql(24, 32, 2, "dt")]) + f"""
SELECT f.doc_id, f.src, f.dst, dt.k, round(list_sum(dt.emb), 6) AS esum, list_transform(dt.emb, lambda x: round(x, 6)) AS vec
FROM fedges f
JOIN dt ON dt.k = coalesce(list_position({[t for t in S.DEP_TAGS]}, f.dep) - 1, {S.DEP_TAGS.index('dep')})""")
def q_dep_edge_vector(spark, sf_dir):
    """32-wide dependency embedding per edge (seeded 24 x 32 table), all
    components and their sum."""
    e = G.edge_vectors(graphs(spark, sf_dir)[1], _rounded_table(spark, len(S.DEP_TAGS), 32, 2))
    total = F.aggregate("evec", F.lit(0.0), lambda a, x: a + x)
    return e.select("doc_id", "src", "dst", "k", F.round(total, 6).alias("esum"), F.col("evec").alias("vec"))


@register("dep_edge_vector_full", with_ctes(["fedges"], [_seeded_sql(24, 32, 2, "dt")]) + f"""
SELECT f.doc_id, f.src, f.dst, dt.k, list_transform(dt.emb, lambda x: round(x, 6)) AS vec FROM fedges f
JOIN dt ON dt.k = coalesce(list_position({[t for t in S.DEP_TAGS]}, f.dep) - 1, {S.DEP_TAGS.index('dep')})""")
def q_dep_edge_vector_full(spark, sf_dir):
    """Dependency embedding per edge, all components."""
    e = G.edge_vectors(graphs(spark, sf_dir)[1], _rounded_table(spark, len(S.DEP_TAGS), 32, 2))
    return e.select("doc_id", "src", "dst", "k", F.col("evec").alias("vec"))


@register("graph_pool", with_ctes(["nv"]) + """
SELECT doc_id, CAST(d AS INTEGER) AS dim, round(avg(x), 6) AS value FROM (
  SELECT nv.doc_id, unnest(range(64)) AS d,
         unnest(coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(range(64), lambda j: 0.0))) AS x
  FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id) s
GROUP BY doc_id, d""")
def q_graph_pool(spark, sf_dir):
    """Mean pooling of node vectors per document (one row per dimension)."""
    p = pooled_vecs(spark, sf_dir, "mean")
    return p.select("doc_id", F.posexplode("vec").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("int"), F.round("value", 6).alias("value"))


@register("gcn_propagate", with_ctes(["nv", "fedges"], ["""x AS (
  SELECT nv.doc_id, nv.node, coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(range(64), lambda j: 0.0)) AS v
  FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id)""",
    """se AS (SELECT DISTINCT doc_id, src, dst FROM (
      SELECT doc_id, src, dst FROM fedges UNION ALL SELECT doc_id, dst, src FROM fedges) u WHERE src <> dst)""",
    """deg AS (SELECT x.doc_id, x.node, 1.0 + coalesce(c.k, 0) AS deg FROM x
      LEFT JOIN (SELECT doc_id, dst, count(*) AS k FROM se GROUP BY doc_id, dst) c ON x.doc_id = c.doc_id AND x.node = c.dst)""",
    """msg AS (
  SELECT se.doc_id, se.dst AS node, x.v, 1.0 / sqrt(ds.deg * dd.deg) AS w FROM se
  JOIN x ON x.doc_id = se.doc_id AND x.node = se.src
  JOIN deg ds ON ds.doc_id = se.doc_id AND ds.node = se.src
  JOIN deg dd ON dd.doc_id = se.doc_id AND dd.node = se.dst
  UNION ALL SELECT x.doc_id, x.node, x.v, 1.0 / deg.deg FROM x JOIN deg ON x.doc_id = deg.doc_id AND x.node = deg.node)"""])
    + """
SELECT doc_id, CAST(d AS INTEGER) AS dim, round(sum(value), 5) AS total, round(sum(value * value), 5) AS squares FROM (
  SELECT doc_id, node, d, sum(w * val) AS value FROM (
    SELECT doc_id, node, w, unnest(range(64)) AS d, unnest(v) AS val FROM msg) s
  GROUP BY doc_id, node, d) x
GROUP BY doc_id, d""")
def q_gcn_propagate(spark, sf_dir):
    """One round of normalised propagation over the undirected graph, on
    all vector components; per document and component the sum and the sum of
    squares over its nodes' new vectors."""
    x = vector_stream(spark, sf_dir, DV.propagated_pools(1, ["sum", "squares"]),
                      "doc_id long, sum array<double>, squares array<double>")
    v = x.select("doc_id", F.posexplode(F.arrays_zip("sum", "squares")).alias("dim", "v"))
    return v.select("doc_id", F.col("dim").cast("int"), F.round("v.sum", 5).alias("total"),
                    F.round("v.squares", 5).alias("squares"))


@register("gcn_propagate_full", with_ctes(["nv", "fedges"], ["""x AS (
  SELECT nv.doc_id, nv.node, coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(range(64), lambda j: 0.0)) AS v
  FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id)""",
    """se AS (SELECT DISTINCT doc_id, src, dst FROM (
      SELECT doc_id, src, dst FROM fedges UNION ALL SELECT doc_id, dst, src FROM fedges) u WHERE src <> dst)""",
    """deg AS (SELECT x.doc_id, x.node, 1.0 + coalesce(c.k, 0) AS deg FROM x
      LEFT JOIN (SELECT doc_id, dst, count(*) AS k FROM se GROUP BY doc_id, dst) c ON x.doc_id = c.doc_id AND x.node = c.dst)""",
    """msg AS (
  SELECT se.doc_id, se.dst AS node, x.v, 1.0 / sqrt(ds.deg * dd.deg) AS w FROM se
  JOIN x ON x.doc_id = se.doc_id AND x.node = se.src
  JOIN deg ds ON ds.doc_id = se.doc_id AND ds.node = se.src
  JOIN deg dd ON dd.doc_id = se.doc_id AND dd.node = se.dst
  UNION ALL SELECT x.doc_id, x.node, x.v, 1.0 / deg.deg FROM x JOIN deg ON x.doc_id = deg.doc_id AND x.node = deg.node)"""])
    + f"""
SELECT doc_id, node, {", ".join(f"sum(w * v[{j + 1}]) AS v{j}" for j in range(DIM))}
FROM msg GROUP BY doc_id, node""")
def q_gcn_propagate_full(spark, sf_dir):
    """One round of normalised propagation; the new vector of every node,
    a column for each component (sums of doubles differ in their last digits
    with the order of the rows, so they are not rounded into an array)."""
    x = vector_stream(spark, sf_dir, DV.propagated(1), "doc_id long, node string, vec array<double>")
    return x.select("doc_id", "node", *[F.col("vec")[j].alias(f"v{j}") for j in range(DIM)])


# attention gate over all components, by a rule (fixed value)
GATE = [((j * 37 + 11) % 41 - 20) / 20.0 for j in range(DIM)]


@register("attention_pool", with_ctes(["nv"], ["""x AS (
  SELECT nv.doc_id, nv.node, coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(range(64), lambda j: 0.0)) AS v
  FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id)""",
    """s AS (SELECT doc_id, v, list_sum(list_transform(range(64), lambda j: v[j + 1] * (((j * 37 + 11) % 41 - 20) / 20.0))) AS sc FROM x)""",
    """w AS (SELECT doc_id, v, exp(sc - max(sc) OVER (PARTITION BY doc_id)) AS w FROM s)"""]) + """
SELECT doc_id, CAST(d AS INTEGER) AS dim, round(sum(w * val) / sum(w), 6) AS value FROM (
  SELECT doc_id, w, unnest(range(64)) AS d, unnest(v) AS val FROM w) q
GROUP BY doc_id, d""")
def q_attention_pool(spark, sf_dir):
    """Softmax-gated pooling of node vectors (all components, fixed gate)
    per document."""
    p = vector_stream(spark, sf_dir, DV.attended(GATE), "doc_id long, vec array<double>")
    return p.select("doc_id", F.posexplode("vec").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("int"), F.round("value", 6).alias("value"))


@register("project_vectors")
def q_project_vectors(spark, sf_dir):
    """Node vectors mapped to 256 dimensions by a seeded projection
    (rows-only check; the product runs in Arrow batches)."""
    nv = node_vecs(spark, sf_dir).select("doc_id", "node", "vec")
    p = G.project(nv, G.projection_matrix(DIM, 256))
    return p.select("doc_id", "node", F.size("vec").alias("width"),
                    F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("vsum"), "vec")


def _pool_sql(fn: str) -> str:
    return with_ctes(["nv"]) + f"""
SELECT doc_id, CAST(d AS INTEGER) AS dim, round({fn}(x), 6) AS value FROM (
  SELECT nv.doc_id, unnest(range(64)) AS d,
         unnest(coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(range(64), lambda j: 0.0))) AS x
  FROM nv LEFT JOIN embeddings e ON nv.vec_id = e.vec_id) s
GROUP BY doc_id, d"""


def _pool_query(how: str):
    def q(spark, sf_dir):
        p = pooled_vecs(spark, sf_dir, how)
        return p.select("doc_id", F.posexplode("vec").alias("dim", "value")).select(
            "doc_id", F.col("dim").cast("int"), F.round("value", 6).alias("value"))
    q.__name__ = f"q_graph_pool_{how}"
    return q


register("graph_pool_max", _pool_sql("max"))(_pool_query("max"))   # G15 (max)
register("graph_pool_sum", _pool_sql("sum"))(_pool_query("sum"))   # G15 (sum)


@register("conllu_graph_edges", with_ctes(["tokens"], ["""placed AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, sent_id) - 1 - i AS behind FROM tokens)""", """heads AS (
  SELECT *, CASE WHEN behind > 0 THEN 1 + i * 7 % behind ELSE 0 END AS step,
         dense_rank() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS sent
  FROM placed)""", """edges AS (
  SELECT doc_id, CAST(sent AS INTEGER) AS sent_id, i,
         CASE WHEN behind = 0 THEN 'ROOT_0'
              ELSE lead(concat_ws('_', lower(text), pos), step) OVER (PARTITION BY doc_id, sent_id ORDER BY i) END AS src,
         concat_ws('_', lower(text), pos) AS dst, CASE WHEN behind = 0 THEN 'ROOT' ELSE 'dep' END AS dep,
         CASE WHEN step > 0 THEN 1.0 / step ELSE 1.0 END AS dist
  FROM heads)"""]) + "SELECT doc_id, sent_id, i, src, dst, dep, dist FROM edges")
def q_conllu_graph_edges(spark, sf_dir):
    """A parse with heads far apart, written as CoNLL-U and read back;
    the last token of a sentence is its root."""
    def far(s):
        def token(t):
            behind = F.size(s["a"]) - 1 - t["i"]
            root = behind == 0
            head = t["i"] + 1 + F.when(root, 0).otherwise(t["i"] * 7 % F.greatest(behind, F.lit(1)))
            return F.struct(*[t[c].alias(c) for c in ("i", "text", "lemma", "pos")], F.when(root, "ROOT").otherwise("dep").alias("dep"),
                            F.when(root, t["i"]).otherwise(head).cast("int").alias("head_i"))
        return F.struct(s["sent_id"].alias("sent_id"), F.transform(s["a"], token).alias("a"))

    path = scratch_path(spark, "conllu")
    write_parses(X.parses(spark, sf_dir).withColumn("sents", F.transform("sents", far)), path, "lz4")
    return G.parse_edges(read_parses(spark, path))

"""DuckDB SQL for the correctness check.

``FIXTURE_CTES`` restates the fixture views of ``lexiscope.sources.fixtures``
over the pre-registered driver tables; each oracle query is
``WITH <ctes> <query>``. Plain window functions are fine here: the oracle
runs on one machine at sf0.01.
"""

from __future__ import annotations

CTE = {
    "corpus": """corpus AS (
  SELECT d.doc_id AS id, d.text, l.quality AS label, d.lang AS genre, d.source AS source,
         CASE WHEN l.quality = 0 THEN 'human' ELSE concat('gen', CAST(d.doc_id % 4 AS VARCHAR)) END AS model
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "answers": """answers AS (
  SELECT id, CAST(CASE WHEN abs(p - 0.5) <= 0.05 THEN 0.5 ELSE round(p, 4) END AS DOUBLE) AS label
  FROM (SELECT id, CAST((id * 7919 + 13) % 1000 + 400 * label AS DOUBLE) / 1399.0 AS p
        FROM corpus WHERE id % 17 <> 0) q)""",
    "truth": """truth AS (
  SELECT id, CAST(label AS DOUBLE) AS label, source, model, genre FROM corpus)""",
    "scored": """scored AS (
  SELECT t.id, t.label AS t, coalesce(a.label, 0.5) AS p, t.source, t.model, t.genre
  FROM truth t LEFT JOIN answers a ON t.id = a.id)""",
    "faceted": """faceted AS (
  SELECT 'all' AS facet, 'all' AS value, t, p FROM scored
  UNION ALL SELECT 'source', source, t, p FROM scored WHERE source IS NOT NULL
  UNION ALL SELECT 'model', model, t, p FROM scored WHERE model IS NOT NULL
  UNION ALL SELECT 'genre', genre, t, p FROM scored WHERE genre IS NOT NULL)""",
    "raw_tokens": r"""raw_tokens AS (
  SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(unnest(range(len(a))) AS INTEGER) AS i, unnest(a) AS tok FROM (
    SELECT doc_id, sent_id,
           regexp_extract_all(lower(sent), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS a
    FROM (SELECT doc_id, unnest(range(len(z))) AS sent_id, unnest(z) AS sent
          FROM (SELECT doc_id, string_split(text, chr(10)) AS z FROM documents) s0) s1) s2)""",
    "tokens": r"""tokens AS (
  SELECT doc_id, sent_id, i, tok AS text, tok AS lemma, pos,
    CASE WHEN i = 0 THEN 'ROOT' WHEN pos = 'PUNCT' THEN 'punct' WHEN pos = 'DET' THEN 'det'
         WHEN pos = 'ADP' THEN 'case' WHEN pos = 'CCONJ' THEN 'cc' WHEN pos = 'AUX' THEN 'aux'
         WHEN pos = 'PRON' THEN 'nsubj' WHEN pos = 'NUM' THEN 'nummod' ELSE 'dep' END AS dep,
    CASE WHEN i = 0 THEN 0 ELSE i - 1 END AS head_i
  FROM (SELECT *, CASE
      WHEN NOT regexp_matches(tok, '[\p{L}\p{N}]') THEN 'PUNCT'
      WHEN regexp_matches(tok, '^\p{N}+$') THEN 'NUM'
      WHEN tok IN ('the','a','an') THEN 'DET'
      WHEN tok IN ('of','in','on','at','by','with','for','to','from') THEN 'ADP'
      WHEN tok IN ('and','or','but') THEN 'CCONJ'
      WHEN tok IN ('is','are','was','were','be') THEN 'AUX'
      WHEN tok IN ('he','she','it','they','we','you','i') THEN 'PRON'
      ELSE 'NOUN' END AS pos FROM raw_tokens) q)""",
    "token_ids": r"""token_ids AS (
  SELECT doc_id, CAST(k + 1 AS INTEGER) AS pos, token, CAST((length(token) * 31 + ascii(token)) % (SELECT count(*) FROM embeddings) AS BIGINT) AS vec_id
  FROM (SELECT doc_id, unnest(range(len(a))) AS k, unnest(a) AS token
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS a FROM documents) s) t
  UNION ALL SELECT doc_id, 0, '', CAST(doc_id % (SELECT count(*) FROM embeddings) AS BIGINT) FROM documents)""",
    "nodes": """nodes AS (
  SELECT DISTINCT doc_id, concat_ws('_', lower(text), pos) AS node, pos AS pos_tag FROM tokens
  UNION SELECT DISTINCT doc_id, 'ROOT_0', 'ROOT_0' FROM tokens)""",
    # the annotator's heads are the token itself or the one before it, so the
    # oracle finds them by a window instead of a self-join
    "heads": """heads AS (
  SELECT doc_id, sent_id, i, text, pos, dep, head_i,
         CASE WHEN head_i = i THEN text ELSE lag(text) OVER s END AS head_text,
         CASE WHEN head_i = i THEN lemma ELSE lag(lemma) OVER s END AS head_lemma,
         CASE WHEN head_i = i THEN pos ELSE lag(pos) OVER s END AS head_pos
  FROM tokens WINDOW s AS (PARTITION BY doc_id, sent_id ORDER BY i))""",
    "token_edges": """token_edges AS (
  SELECT doc_id, sent_id, i,
         CASE WHEN dep = 'ROOT' THEN 'ROOT_0' ELSE concat_ws('_', lower(head_text), head_pos) END AS src,
         concat_ws('_', lower(text), pos) AS dst, dep,
         CASE WHEN abs(i - head_i) > 0 THEN 1.0 / abs(i - head_i) ELSE 1.0 END AS dist
  FROM heads)""",
    "edges": """edges AS (
  SELECT doc_id, src, dst, dep, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, src, dst ORDER BY sent_id DESC, i DESC) AS rn FROM token_edges) x
  WHERE rn = 1)""",
    "gstats": """gstats AS (
  SELECT coalesce(n.doc_id, e.doc_id) AS doc_id, coalesce(n.n_nodes, 0) AS n_nodes, coalesce(e.n_edges, 0) AS n_edges
  FROM (SELECT doc_id, count(*) AS n_nodes FROM nodes GROUP BY doc_id) n
  FULL OUTER JOIN (SELECT doc_id, count(*) AS n_edges FROM edges GROUP BY doc_id) e ON n.doc_id = e.doc_id)""",
    "good": """good AS (SELECT doc_id FROM gstats WHERE n_nodes >= 2 AND n_edges >= 1)""",
    "fnodes": """fnodes AS (
  SELECT * FROM nodes WHERE doc_id IN (SELECT doc_id FROM good)
  UNION ALL SELECT doc_id, 'DUMMY_NOUN', 'NOUN' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM good)
  UNION ALL SELECT doc_id, 'FILLER_VERB', 'VERB' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM good))""",
    "fedges": """fedges AS (
  SELECT * FROM edges WHERE doc_id IN (SELECT doc_id FROM good)
  UNION ALL SELECT doc_id, 'DUMMY_NOUN', 'FILLER_VERB', 'dep', 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM good))""",
    "nv": """nv AS (
  SELECT n.doc_id, n.node, n.pos_tag, CASE WHEN n.node = 'ROOT_0' THEN r.vec_id ELSE l.vec_id END AS vec_id
  FROM fnodes n
  LEFT JOIN (SELECT doc_id, lower(token) AS word, arg_max(vec_id, pos) AS vec_id FROM token_ids
             WHERE pos > 0 AND pos < 512 GROUP BY doc_id, lower(token)) l
    ON n.doc_id = l.doc_id AND lower(split_part(n.node, '_', 1)) = l.word
  LEFT JOIN (SELECT doc_id, vec_id FROM token_ids WHERE pos = 0) r ON n.doc_id = r.doc_id)""",
    "t2pred": """t2pred AS (
  SELECT id, label, pred, language,
         list_transform(range(6), lambda k: CAST((id * 31 + k * 17) % 100 AS DOUBLE) / 25.0 + CASE WHEN k = pred THEN 2.0 ELSE 0.0 END) AS logits
  FROM (SELECT d.doc_id AS id, CAST(d.doc_id % 6 AS INTEGER) AS label, d.lang AS language,
               CAST(CASE WHEN (d.doc_id * 7919 + 13) % 1000 < 600 THEN d.doc_id % 6 ELSE ((d.doc_id * 7919 + 13) % 1000) % 6 END AS INTEGER) AS pred
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x)""",
}

# dependency order of the CTEs
_DEPS = {
    "corpus": [], "answers": ["corpus"], "truth": ["corpus"],
    "scored": ["truth", "answers"], "faceted": ["scored"],
    "raw_tokens": [], "tokens": ["raw_tokens"], "token_ids": [],
    "nodes": ["tokens"], "heads": ["tokens"], "token_edges": ["heads"], "edges": ["token_edges"],
    "gstats": ["nodes", "edges"], "good": ["gstats"], "fnodes": ["good"], "fedges": ["good"],
    "nv": ["fnodes", "token_ids"], "t2pred": [],
}


def with_ctes(names: list[str], extra: list[str] | None = None) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, followed by
    ``extra`` CTE bodies (``"name AS (...)"``)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [CTE[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n"

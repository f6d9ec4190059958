"""DuckDB SQL of the operators whose results SQL can express."""

from __future__ import annotations

import string

CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


def _row_digest(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
             for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_row_digest("text")} AS leaf, {CRC32} % 3 = 0 AS tampered,
         {_row_digest(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS lowered
  FROM documents),
leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN tampered THEN lowered ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
tree(lang, lvl, i, n, h) AS (
  SELECT lang, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
family AS (
  SELECT lang, lvl, i // 8 AS p, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 8),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top(lvl, i, n, h) AS (
  SELECT 0, i, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY lvl, i // 8, n),
top_family AS (
  SELECT lvl, i // 8 AS p, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY lvl, i // 8),
climb(doc_id, leaf, lang, lvl, i, n, h, beside) AS (
  SELECT doc_id, leaf, lang, 0, i, n, shown, '' FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, c.lvl + 1, c.i // 8, (c.n + 7) // 8,
         sha256(array_to_string(f.hs[1:c.i % 8], '') || c.h || array_to_string(f.hs[c.i % 8 + 2:], '')),
         c.beside || array_to_string(f.hs[1:c.i % 8], '') || array_to_string(f.hs[c.i % 8 + 2:], '')
  FROM climb c JOIN family f ON c.lang IS NOT DISTINCT FROM f.lang AND c.lvl = f.lvl AND c.i // 8 = f.p
  WHERE c.n > 1),
ascent(doc_id, leaf, subroot, lvl, i, n, h, beside) AS (
  SELECT c.doc_id, c.leaf, s.h, 0, s.i, s.n, c.h, c.beside
  FROM climb c JOIN subroots s ON c.lang IS NOT DISTINCT FROM s.lang WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.i // 8, (c.n + 7) // 8,
         sha256(array_to_string(f.hs[1:c.i % 8], '') || c.h || array_to_string(f.hs[c.i % 8 + 2:], '')),
         c.beside || array_to_string(f.hs[1:c.i % 8], '') || array_to_string(f.hs[c.i % 8 + 2:], '')
  FROM ascent c JOIN top_family f ON c.lvl = f.lvl AND c.i // 8 = f.p
  WHERE c.n > 1)
SELECT a.doc_id, a.leaf, a.subroot, t.h AS root, sha256(a.beside) AS proof_sha256, a.h AS folded_root,
       a.h = t.h AS verified
FROM ascent a, (SELECT h FROM top WHERE n = 1) t WHERE a.n = 1
"""

TOPK = """
WITH parts AS (
  SELECT vec_id, CAST(list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS BIGINT[]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) r
WHERE rank <= 20
"""

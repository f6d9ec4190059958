"""Merkle manifest, exact top-k and tokenizer alignment: contracts against
brute force, and odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.llm import align, merkle, queries, topk

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- Merkle manifest

def leaf_of(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def levels_of(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append((level[a:i], level[i + 1:a + 8]))
        i //= 8
    return out


def manifest_by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    if not rows:
        return []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {g: levels_of([leaf_of(r) for r in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = beside(trees[g], i) + beside(top, k)
            h = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = leaf_of((*r[:4], r[4].translate(str.maketrans(UPPER, UPPER.lower()))))
            for a, b in way:
                h = sha("".join(a) + h + "".join(b))
            proof = sha("".join("".join(a) + "".join(b) for a, b in way))
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, proof, h, h == root))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("kind", ["hot", "many languages", "one row", "one language", "odd", "none"])
def test_manifest_is_that_of_a_plain_loop(spark, tmp_path, kind):
    rows = {"hot": [(i, "s", "en" if i % 10 else "de", i, f"Text {i}") for i in range(700)],
            "many languages": [(i, None, f"l{i % 75}", i, f"Text {i}") for i in range(150)],
            "one row": [(7, "s", None, 3, "Abc")],
            "one language": [(i, "s", "en", 1, "A" * i) for i in range(9)],
            "odd": [(1, None, None, None, None), (2, "", "", 0, ""), (2, "", "", 0, ""), (2, "x", "", 0, "B"),
                    (None, "q", "en", 1, "No id"), (None, "q", "é", 1, "No id"), (3, "ß", "z", -5, "Ä Long " * 40000),
                    *[(9, "s", "rep", 4, "Same")] * 30],
            "none": []}[kind]
    # columns whose names clash with those of the operator
    df = spark.createDataFrame(rows, COLUMNS)
    for c in ("leaf", "root", "tree", "key", "node", "block", "held", "pos", "grp", "_tie"):
        df = df.withColumn(c, F.lit("mine"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == manifest_by_hand(rows)


def test_manifest_leaves_the_session_as_it_was(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    df = spark.range(20).selectExpr("id", "'x' AS g")
    m = merkle.build(df, F.col("id"), F.col("g"), merkle.digest([F.col("id")]))
    done = merkle.climb(spark, m).collect()
    assert len(done) == 20 and all(r.folded == r.root for r in done)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) == before


# ---- exact top-k

def test_topk_of_the_given_vectors(spark, sf):
    got = [tuple(r) for r in queries.op12_exhaustive_accumulation(spark, sf).orderBy("query_id", "rank").collect()]
    x = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, v = x.vec_id.to_numpy(), np.floor(64 * np.stack(x.embedding.to_numpy()).astype(float)).astype(np.int64)
    want = []
    for q in ids[ids % 20 == 0].tolist():
        s = v @ v[ids == q][0]
        best = [i for i in np.lexsort((ids, -s)).tolist() if ids[i] != q][:20]
        want += [(q, r, int(ids[i]), int(s[i])) for r, i in enumerate(best, 1)]
    assert got == want


def test_topk_odd_vectors_ties_and_hot_copies(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []),
            (20, [1.0, 1.0]), (20, [1.0, 1.0]), (None, [9.0, 9.0]), (40, [1.0, 2.0, 3.0]),
            *[(k, [0.5, -0.01]) for k in range(100, 400) if k % 20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    monkeypatch.setattr(topk, "BLOCK", 16)
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 4096), (0, 2, 101, 2048), (0, 3, 102, 2048),
                   (20, 1, 0, 4096), (20, 2, 101, 1984), (20, 3, 102, 1984)]
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_postings_scatter_what_the_product_is():
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (50, 12)) * (rng.random((50, 12)) < rng.random(12))
    q = rng.integers(-2, 3, 12) * (rng.random(12) < 0.5)
    scores, terms = np.full(50, 9), np.flatnonzero(q)
    topk.accumulate(terms, q[terms], topk.postings(x), scores)
    assert (scores == x @ q).all() and any(rows is not None for rows, _ in topk.postings(x))


# ---- tokenizer alignment

def aligned_by_hand(docs):
    """Whole texts through both tokenizers, dictionaries over whole texts."""
    import sentencepiece
    import tokenizers
    a_tok = tokenizers.Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    letters = align.byte_letters()
    found, count = [], Counter()
    for doc_id, text in docs:
        links, groups, a, b = Counter(), [], [], []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            in_a = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
            in_b = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()
                    for i in b for p in [b_tok.id_to_piece(i)]]
            whole = (" " + text).encode()
            if b"".join(in_a) != whole or b"".join(in_b) != whole:
                a, b = [], []
            ends = [{e: k for k, e in enumerate(np.cumsum([len(p) for p in x]).tolist(), 1)} for x in (in_a, in_b)]
            i = j = 0
            for e in sorted(ends[0].keys() & ends[1].keys()) if a else ():
                p, q = ends[0][e], ends[1][e]
                links.update((x, y) for x in a[i:p] for y in b[j:q])
                groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                i, j = p, q
        count.update(links.keys())
        found.append((doc_id, a, b, groups, links))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return sorted([(d, len(a), len(b), len(g), sum(k.values()),
                    sum(n for pair, n in k.items() if count[pair] == top[pair[0]]),
                    sum(n * count[pair] for pair, n in k.items()), sha(";".join(g)) if g else "")
                   for d, a, b, g, k in found], key=str)


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(spark, path):
    return sorted([tuple(r) for r in queries.op13_tokenizer_alignment(spark, path).select(*FIELDS).collect()], key=str)


def test_alignment_of_the_given_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert aligned(spark, sf) == aligned_by_hand(docs)


def test_alignment_of_odd_texts_in_small_blocks(spark, tmp_path, monkeypatch):
    texts = [None, "", " ", "\n", "  a  b ", "a\n b\t\n  c \x1c d", "<|endoftext|> <s></s> x", "x▁y", "ﷺ 😀 ٣", "a" * 5000,
             "Word", "Word", "x" * 70 + " y", "don't we'll 12345 Überraschung", "word " * 20000, "é" * 3000 + " z "]
    monkeypatch.setattr(align, "BLOCK_LINKS", 64)
    monkeypatch.setattr(align, "CACHED", 8)
    monkeypatch.setattr(align, "CHUNK_CHARS", 40)
    rows = [*enumerate(texts), (3, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("block", "name", "pair", "held", "at", "n_a"):
        df = df.withColumn(c, F.lit("mine"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert aligned(spark, str(tmp_path)) == aligned_by_hand(rows)
    empty = df.limit(0)
    assert align.align(empty, *map(queries.tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))).count() == 0


def test_alignment_segments_are_those_of_the_whole_text():
    rng = np.random.default_rng(8)
    letters = [*"ab  \n\t\x1c\x85 é▁'s12", " the", "<s>", "\r\n", "   x", "ﷺ", "\x00"]
    made = align.Aligner(*map(queries.tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(1, 20)))
        parts, ids = made.aligned(made.segments(text)), [t.encode(" " + text) for t in made.tok]
        if any(b"".join([t.bytes[i] for i in x]) != (" " + text).encode() for t, x in zip(made.tok, ids)):
            assert None in parts
            continue
        groups = [g.split("|") for g in b"".join([p[1] for p in parts]).decode()[:-1].split(";")]
        assert [[int(i) for g in groups for i in g[k].split(",")] for k in (0, 1)] == ids


def test_a_long_stretch_without_common_ends_is_counted_by_distinct_ids():
    a, b = np.array([1, 2] * 50 + [7]), np.array([5] * 90 + [8])
    pairs, times, rows = align.links_of(a, b, np.array([100, 1]), np.array([90, 1]))
    full = Counter((x, y) for x in a[:100].tolist() for y in b[:90].tolist())
    full[7, 8] += 1
    assert rows.tolist() == [2, 1]
    assert {(p // align.B_IDS, p % align.B_IDS): t for p, t in zip(pairs.tolist(), times.tolist())} == full

"""Edge cases and brute force for the training-data operators."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.llm import (ann, chat, components, decontam, jaccard, langid, lm, packing, quality, queries,
                           sharding, toxicity)
from lexiscope.llm.common import flagged, words_of

DOCS = "doc_id long, text string, score string, lang string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with the operators' outputs."""
    return spark.createDataFrame([(i, t, "mine", "x") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t"), (4, "Word"), (4, "Word"), (None, "no id here at all my friend"),
       (5, "a b c d e f g " * 4000), (6, "ÀÉ ßtraße 12!")]


# ---- nearest neighbours

def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]),
            (6, [None, 1.0]), (7, []), (20, [5.0, 5.0]), (20, [5.0, 5.0]), (None, [1.0, 1.0]), (8, [0.9, 0.1]),
            (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 5.0), (0, 2, 1, 0.9), (0, 3, 8, 0.9), (20, 1, 0, 5.0), (20, 2, 1, 5.0), (20, 3, 8, 5.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("width", [1, 2])
def test_neighbours_recall_and_scores(spark, sf, width):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ann.search(rows, F.col("vec_id") % 20 == 0, k=20, width=width, tables=12 if width == 1 else 60).toPandas()
    x = rows.orderBy("vec_id").toPandas()
    ids, v = x.vec_id.to_numpy(), np.stack(x.embedding.to_numpy()).astype(float)
    hit = total = 0
    for q, part in got.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))][:20])
        hit, total = hit + len(best & set(part.vec_id)), total + 20
        assert part.sort_values("rank").score.is_monotonic_decreasing
    assert total == 20 * (ids % 20 == 0).sum() and hit / total >= 0.9


def test_neighbours_of_mixed_lengths_over_batches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(2000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    few = np.where(np.arange(2000) % 400 == 1, 3.0, 1.0)     # in all batches but the rest unit
    small = ann.small_batches
    monkeypatch.setattr(ann, "small_batches", lambda s, rows=512: small(s, min(rows, 500)))
    for size in (1 + rng.uniform(-1e-3, 1e-3, 2000), rng.uniform(0.5, 2, 2000), few):
        v = unit * size[:, None]
        df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
        hit = 0
        for q, part in ann.search(df.coalesce(1), F.col("vec_id") % 20 == 0, k=20).toPandas().groupby("query_id"):
            s = v @ v[q]
            s[q] = -np.inf
            hit += len(set(np.argsort(-s)[:20]) & set(part.vec_id))
        assert hit / 2000 >= 0.9


def test_default_tables_are_those_that_the_recall_test_uses():
    assert [ann.tables_of(w, None) for w in (0, 1, 2)] == [1, 12, 60] and ann.tables_of(2, 7) == 7


# ---- packing

def check_packed(got, capacity):
    for _, p in got.sort_values("offset").groupby("sequence_id"):
        assert (p.offset.to_numpy() == np.cumsum(p.length) - p.length).all() and p.length.sum() <= capacity


def test_packing_odd_texts(spark):
    got = packing.pack(docs_of(spark, ODD), queries.tokenizer_path(), capacity=64).toPandas()
    check_packed(got, 64)
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    assert (got[got.doc_id.isin([1, 2, 3])].ids_crc32 == end).all()
    assert got.length.sum() == 3 + 2 * 2 + got[got.doc_id.isna() | got.doc_id.isin([5, 6])].length.sum()
    assert packing.pack(docs_of(spark, ODD).limit(0), queries.tokenizer_path()).count() == 0


def test_packing_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["It's 12 o'clock, déjà vu\x1cx", "é İstanbul ΣΣ 中文 don't", "​ a b"]
    got = packing.Tokens(queries.tokenizer_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_ids_survive_full_generations(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "CACHE", 8)
    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["Word, word. WORD!!! İstanbul, ΑΣ. straße&&& ... # '' don't. it's, (a) x1. e\u0301t\u00e9.",
             "new words come here, more than the cache may hold; İ ﬁn Ⅷ ª. ǅ, 한국어. \u1112\u1161\u11ab,", "word. x1."]
    tokens = packing.Tokens(queries.tokenizer_path())
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for _ in range(3):
        for text, ids in zip(texts, want):
            assert np.frombuffer(tokens.encode([text])[0], "<u4").tolist() == ids


def test_minimum_slack_fill_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = dict(collections.Counter(rng.integers(1, 40, 9).tolist()))
        used = packing.fill(counts, 60)
        items = [x for x, n in counts.items() for _ in range(n)]
        items.remove(max(items))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(x * n for x, n in used.items()) == max(counts) + max(s for s in sums if s <= 60 - max(counts))
        assert all(n <= counts[x] for x, n in used.items())


# ---- language id

def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where(queries.crc_mod("doc_id", 4) != 2), per_language=100)
    got = langid.identify(docs, model).where(queries.crc_mod("doc_id", 4) == 2)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = {r.doc_id: r for r in langid.identify(docs_of(spark, ODD), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3)) and odd[4].lang == "x"
    none = langid.fit(docs.limit(0))
    assert langid.identify(docs_of(spark, ODD), none).select("lang_pred").distinct().collect()[0][0] == "und"


def test_unseen_words_back_off_to_shorter_grams():
    m = langid.LanguageModel(["a", "b"], {}, np.zeros((0, 2)), {"xy": 0, "z": 1}, np.log([[.9, .1], [.2, .8]]))
    assert m.backoff("xyz") == [0, 1] and m.predict("xy")[0] == "a" and m.predict("z")[0] == "b"


# ---- sharding

def test_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", F.octet_length("text").alias("w"))
    hot = docs.unionByName(spark.range(400).select(F.lit(-1).cast("long").alias("doc_id"),
                                                   F.lit(5).cast("long").alias("n_chars"), F.lit(700).alias("w")))
    hot = hot.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.lit("mine")).drop("shard")
    got = sharding.assign(hot, {"d": F.col("doc_id"), "n": F.col("n_chars")}, F.col("w"), ["row"], 6)
    sums = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 6 and max(sums) / min(sums) < 1.1
    slots = sharding.with_slots(got, ["row"], hot.count()).groupBy("shard").agg(
        F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d"))
    assert all(r.n == r.m + 1 == r.d for r in slots.collect())
    assert sharding.assign(hot.limit(0), {"d": F.col("doc_id")}, F.col("w"), ["row"]).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, w int")
    assert [r.shard for r in sharding.assign(one, {"d": F.col("doc_id")}, F.lit(1), ["doc_id"]).collect()] != []


# ---- classifiers

@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd_texts_and_no_training(spark, module):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, 7)],
                                   "doc_id long, toxic int, quality int")
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in module.score(docs, module.fit(docs, labels.limit(0))).collect())


def test_toxicity_finds_planted_words():
    rng = np.random.default_rng(0)
    f = lambda t: np.unique(toxicity.skipgram_features(t, 16))
    text = lambda bad: " ".join([*rng.choice([f"w{k}" for k in range(300)], 60), *(["vile", "rot"] if bad else [])])
    model = toxicity.train([(k % 2, f(text(k % 2))) for k in range(600)], bits=16)
    assert np.mean([model.score(text(True)) >= 0.7 for _ in range(50)]) > 0.9
    assert np.mean([model.score(text(False)) < 0.7 for _ in range(50)]) > 0.9


def test_dual_descent_reaches_the_hinge_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (x[:, 0] > 0).astype(int)
    w, b = quality.dual_descent([(int(t), np.arange(5), v) for t, v in zip(y, x)], 5, 1.0, 400)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).sum()
    best = loss(w, b)
    for _ in range(300):
        assert best <= loss(w + rng.normal(0, .05, 5), b + rng.normal(0, .05)) + 1e-3


# ---- n-gram Jaccard join

def brute(docs):
    sets, parent = {}, {}
    for i, t in docs:
        w = words_of(t)
        sets[i] = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(n):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    line = list(rng.choice(words, 30))
    bases = [list(rng.choice(words, rng.integers(5, 60))) for _ in range(4)]
    rows = []
    for i in range(n):
        t = list(bases[rng.integers(0, 4)])
        kind = rng.integers(0, 4)
        if kind == 0:
            t = list(rng.choice(words, rng.integers(0, 40)))
        elif kind == 1:
            t = line + list(rng.choice(words, rng.integers(0, 6)))
        else:
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows


def test_jaccard_components_equal_brute_force(spark):
    rows = near_copies(600) + [(900, ""), (901, None), (902, "A  b"), (903, "a B "), (904, "a")]
    got = jaccard.jaccard_components(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    kept = [r.doc_id for r in jaccard.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(kept) == sorted({c for _, c in brute(rows).values()})


def test_jaccard_odd_rows(spark):
    got = jaccard.jaccard_components(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.jaccard_components(docs_of(spark, ODD).limit(0)).count() == 0


def test_jaccard_wide_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (400, 1025, 2000, 5000, 6000)]
    maps = [jaccard.wide_bitmap(s) or jaccard.bitmap(s) for s in sets]
    assert jaccard.wide_bitmap(sets[0]) is None and jaccard.wide_bitmap(sets[0][:0]) is None
    assert [8 * len(m) for m in maps] == [1024, 2048, 2048, 8192, 8192]
    x, y = zip(*[(i, j) for i in range(5) for j in range(5)])
    got = jaccard.differing([maps[i] for i in x], [maps[j] for j in y])
    for i, j, d in zip(x, y, got):
        assert d <= len(np.setxor1d(sets[i], sets[j])) and (i != j or d == 0)
    # a large set and another one: the narrow bitmaps allow the pair, the wide ones do not
    n = len(sets[3]) + len(sets[4])
    assert 18 * jaccard.differing([jaccard.bitmap(sets[3])], [jaccard.bitmap(sets[4])])[0] <= 2 * n
    assert 18 * jaccard.differing([maps[3]], [maps[4]])[0] > 2 * n


def test_jaccard_long_documents_and_ids_with_two_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    shared = list(rng.choice(words, 400))
    rows = []
    for i in range(12):      # long texts that share a passage, and edits of them
        base = list(rng.choice(words, 480 + 150 * i))
        rows.append((10 * i, " ".join(shared + base)))
        for k, edits in ((1, 5), (2, 60)):
            t = list(base)
            for at in rng.integers(0, len(t), edits):
                t[at] = "x"
            rows.append((10 * i + k, " ".join(shared + t)))
    got = jaccard.jaccard_components(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    # an id with a small and a large text links by either
    two = [(1, rows[3][1]), (1, " ".join(shared[:200])), (2, rows[4][1]), (3, " ".join(shared[:202]))]
    got = jaccard.jaccard_components(docs_of(spark, two)).collect()
    assert {r.component_id for r in got} == {1}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 1), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


def test_flagged_keeps_all_needed_rows(spark):
    df = spark.range(2000)
    ids = spark.range(0, 2000, 7).withColumnRenamed("id", "x")
    got = {r.id for r in flagged(df, "id", ids).collect()}
    assert got >= set(range(0, 2000, 7)) and len(got) < 400


# ---- decontamination

def test_decontamination(spark):
    item = ("A train with Anna leaves at 9 and travels 120 km to the town before Anna eats 3 apples there")
    other = item.replace("Anna", "Bruno").replace("120 km", "75 miles").replace("9", "11").replace("3", "8")
    mixed = item.replace("Anna", "Bruno", 1).replace("Anna", "Clara")
    docs = docs_of(spark, [(1, f"Some text. {item}. More text."), (2, f"Start here. {other}!"), (3, None), (4, ""),
                           (5, "a clean text without anything of the kind but with many words"), (None, item),
                           (2, f"Start here. {other}!")])
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7].changed_slots == 0 and got[2, 7].changed_slots == 5
    clean = decontam.clean(docs, bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["3", "4", "5", "None"] and clean.columns == docs.columns
    assert decontam.clean(docs, bench.limit(0)).count() == 7
    x, y, z = (decontam.template(t) for t in (item, other, mixed))
    whole = lambda t: t.fillers(0, len(t.ids))
    assert (x.ids == y.ids).all() and decontam.consistent(whole(x), whole(y))["anna"] == "bruno"
    assert decontam.consistent(whole(x), whole(z)) is None


def test_decontamination_of_moved_and_verbatim_passages(spark):
    w = [f"tok{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    item = " ".join(w[:27])
    named = " ".join([*w[:9], "Anna", *w[9:18], "1000", *w[18:25]])
    long = " ".join(w)
    rows = [(1, named.replace("Anna", "Mary Ann").replace("1000", "1 000")),       # fillers of other token counts
            (2, " ".join([*w[:9], "new", *w[9:18], "more", *w[18:27]])),            # inserted
            (3, " ".join([*w[:9], *w[10:18], *w[19:27]])),                          # dropped
            (4, " ".join(["x", *w[20:33], "y"])), (5, " ".join(["x", *w[20:32], "y"])),   # 13 and 12 verbatim
            (6, " ".join([*w[30:38], "other", "words", *w[2:11]]))]                 # two lone passages out of order
    bench = spark.createDataFrame([(7, item), (8, named), (9, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(docs_of(spark, rows), bench).collect()}
    assert {(1, 8), (2, 7), (3, 7), (4, 9)} <= set(got) and got[1, 8].matched_windows == got[1, 8].item_windows
    assert got[1, 8].changed_slots == 2 and got[2, 7].matched_windows == 20
    assert not {d for d, _ in got} & {5, 6}
    x, y = decontam.template("then Mary Ann took 1 000 of them"), decontam.template("then Anna took 1,000 of them")
    assert (x.ids == y.ids).all() and x.fillers(0, 4).split("\t") == ["", "mary ann", "", "1 000"]


# ---- chat

def test_chat_round_trip_and_examples(spark):
    rows = [(1, 0, "user", "hi \\### a </turn>\n"), (1, 1, "assistant", "\\### Assistant: </turn> ok"),
            (1, 2, "user", None), (1, 3, "assistant", "z: \\\\"), (1, 4, None, "tail"), (2, 0, "od: d\\", "x"),
            (2, 0, "od: d\\", "x"), (None, None, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.expand(turns)
    by = {r.conv_id: r for r in chat.digests(out).collect()}
    want = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert by[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    loss = rows[1][3] + rows[3][3]
    assert (by[1].loss_chars, by[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    full = {r.example: r for r in chat.examples(out).where("conv_id = 1").collect()}
    assert len(full) == 3 and full[2].target_start is None and full[2].text.startswith(full[1].text)
    assert chat.unescape(full[1].text[full[1].target_start:full[1].target_end]) == "z: \\\\"
    assert by[1].formatted_chars == sum(len(r.text) for r in full.values())
    assert by[2].n_turns == 2 and by[None].n_turns == 1
    assert chat.digests(chat.expand(turns.limit(0))).count() == 0


def test_chat_digests_read_the_examples(spark):
    rows = [(1, 0, "user", "hi \\### a </turn>\n" * 3), (1, 1, "assistant", "one <"), (1, 2, "assistant", "</turn>two"),
            (2, 0, "assistant", ""), (None, 0, "user", "# x")]
    out = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = {(r.conv_id, r.example): r for r in chat.examples(out).collect()}
    parts = {}
    for r in chat.example_stream(out, part_size=7).collect():
        assert 0 < len(r.text) <= 7
        parts.setdefault((r.conv_id, r.example), []).append(r)
    assert {k: "".join(x.text for x in sorted(v, key=lambda x: x.part)) for k, v in parts.items()} == {
        k: r.text for k, r in full.items()}
    assert {k: tuple(max(v, key=lambda x: x.part)[4:]) for k, v in parts.items()} == {
        k: (r.target_start, r.target_end) for k, r in full.items()}
    small, large = (sorted(map(str, chat.digests(out, part_size=n).collect())) for n in (7, 1000))
    assert small == large and len(small) == 3
    plan = chat.digests(out)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInPandas") == 2       # examples are written, then read back


# ---- LM scoring

def test_lm_scores_equal_a_plain_computation(spark):
    docs = docs_of(spark, [(i, t) for i, t in ODD if i != 5] + [(9, "the cat sat on the mat " * 5)])
    model = lm.fit(docs, rounds=1, mask_rate=0.5)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    p, ids = model.parameters, model.symbols.of("the cat sat on the mat " * 5)
    total = 0.0
    for k, s in enumerate(ids):
        h = p["bias"].astype(float)
        for j, d in enumerate((-2, -1, 1, 2)):
            at = k + d
            h = h + p["context"][j][ids[at] if 0 <= at < len(ids) else lm.SYMBOLS]
        h = np.tanh(h)
        g = s // lm.GROUP
        for logits, one in ((h @ p["group"] + p["group_bias"], g),
                            (h @ p["word"][g] + p["word_bias"][g], s % lm.GROUP)):
            total += logits[one] - np.log(np.exp(logits).sum())
    assert got[9].logprob == pytest.approx(total, rel=1e-4) and got[9].n_words == 30
    assert got[1].n_words == 0 and got[1].logprob == 0 and got[1].mean_logprob is None
    assert lm.score(docs.limit(0), lm.fit(docs.limit(0))).count() == 0


@pytest.mark.parametrize("known", [0, 1000, lm.KNOWN])
def test_lm_words_have_their_own_probability(spark, known):
    common = " ".join(f"w{k:04d}" for k in range(lm.WORDS))
    rare = [f"r{k:05d}" for k in range(3000)]
    same = [w for w in rare if zlib.crc32(w.encode()) % lm.HASHED == 7]
    x, y = same[:2]
    new = next(w for w in (f"n{k}" for k in range(9999)) if zlib.crc32(w.encode()) % lm.HASHED == 7)
    rows = [(1, " ".join([common] * 9)), (2, " ".join(rare)), (3, f"{x} " * 6)]
    model = lm.fit(docs_of(spark, rows), known=known)
    seen = docs_of(spark, [(1, x), (2, y), (3, new), (3, new), (4, f"{x} {y}"), (4, f"{x} {y}"), (5, "w0001")])
    got = {r.doc_id: r for r in lm.score(seen, model).collect()}
    n = len(same) + 6                                       # occurrences of the class, of which 7 are x
    assert got[1].logprob - got[2].logprob == pytest.approx(np.log(7), abs=1e-6)
    assert got[2].logprob - got[3].logprob == pytest.approx(0, abs=1e-6)
    _, plain = model.__class__(model.symbols, model.parameters, None, []).score([x, f"{x} {y}", "w0001"])
    assert got[1].logprob == pytest.approx(plain[0] + np.log(7 / (n + 1)), abs=1e-6)
    assert got[4].logprob == pytest.approx(plain[1] + np.log(7 / (n + 1)) - np.log(n + 1), abs=1e-6)
    assert got[5].logprob == pytest.approx(plain[2], abs=1e-9) and got[5].mean_logprob == got[5].logprob
    assert lm.vocabulary_size(10) == lm.WORDS and 1200 < lm.vocabulary_size(404_216) < lm.vocabulary_size(10**8)


def test_lm_learns_from_every_position():
    for rounds in (1, 2, 3):
        t = np.arange(1001) % 17
        parts = [lm.turn(t, r, 1 / rounds) for r in range(rounds)]
        assert sorted(np.concatenate(parts)) == list(range(1001))
    assert len(lm.turn(t, 0, 0.5)) == 500 and not len(lm.turn(t[:0], 0, 1))


@pytest.mark.parametrize("large", [1, 400])
def test_lm_steps_and_scores_equal_plain_ones(large):
    """Also with logits whose exponentials single precision cannot hold."""
    rng, symbols = np.random.default_rng(5), lm.SYMBOLS
    ids = [rng.integers(0, symbols, n).astype(np.int32) for n in (0, 1, 70, 200)]
    t, c = lm.context_of(ids, symbols)
    p = lm.start(symbols)
    p["group"], p["word"], p["word_bias"] = p["group"] * large, p["word"] * large, p["word_bias"] + np.float32(large / 2)
    q = {k: v.astype(float) for k, v in p.items()}
    h = np.tanh(q["bias"] + sum(q["context"][k][c[:, k]] for k in range(2 * lm.SIDE)))
    g, w = t // lm.GROUP, t % lm.GROUP
    row, grad, total = np.arange(len(t)), {k: np.zeros_like(v) for k, v in q.items()}, 0.0
    shares = []
    for x, at in ((h @ q["group"] + q["group_bias"], g),
                  (np.einsum("ni,nij->nj", h, q["word"][g]) + q["word_bias"][g], w)):
        x = x - x.max(axis=1, keepdims=True)
        total = total + x[row, at] - np.log(np.exp(x).sum(axis=1))
        d = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
        d[row, at] -= 1
        shares.append(d / len(t))
    d, e = shares
    dh = (d @ q["group"].T + np.einsum("nj,nij->ni", e, q["word"][g])) * (1 - h * h)
    grad["group"], grad["group_bias"], grad["bias"] = h.T @ d, d.sum(axis=0), dh.sum(axis=0)
    np.add.at(grad["word"], g, np.einsum("ni,nj->nij", h, e))
    np.add.at(grad["word_bias"], g, e)
    for k in range(2 * lm.SIDE):
        np.add.at(grad["context"][k], c[:, k], dh)
    got = lm.log_probabilities(p, t, c)
    assert np.isfinite(got).all() and np.allclose(got, total, rtol=1e-4, atol=1e-3)
    learner = lm.Learner(p)
    learner.step(t, c)
    for k in p:
        assert np.allclose(learner.p[k], q[k] - lm.RATE * grad[k] / np.sqrt(0.1 + grad[k] ** 2), rtol=1e-4, atol=2e-5 * large), k
    near = lm.centred(np.array([[1.0, -2.0]], np.float32))
    far = lm.centred(np.array([[1.0, 2.0], [-500.0, -499.0]], np.float32))
    assert near.tolist() == [[1, -2]] and far.tolist() == [[-1, 0], [-1, 0]]


def test_lm_blocks_number_each_outside_word_once(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_WORDS", 5)
    rng = np.random.default_rng(3)
    texts = [[f"w{k}" for k in rng.integers(0, 12, rng.integers(0, 9))] for _ in range(60)]
    ids = [np.array([int(w[1:]) for w in t], np.int32) for t in texts]
    blocks, lists = lm.Blocks(1 << 33), {}
    for text, x in zip(texts, ids):
        block, had, new, uses = blocks.add(text, np.flatnonzero(x >= 3))
        known = lists.setdefault(block, [])
        assert len(known) == had
        known += new
        assert [known[k] for k in np.frombuffer(uses, np.int32)] == [w for w, i in zip(text, x) if i >= 3]
    assert len(lists) > 1 and all(len(set(v)) == len(v) for v in lists.values())
    assert min(lists) == 1 << 33 and max(lists) < (1 << 33) + 60


def test_lm_replaces_columns_named_like_outputs(spark):
    docs = docs_of(spark, [(1, "one two one"), (2, ""), (3, None)]).withColumn("n_words", F.lit("x"))
    docs = docs.withColumn("logprob", F.lit(5)).withColumn("units", F.lit(1))
    got = {r.doc_id: r for r in lm.score(docs, lm.fit(docs)).collect()}
    assert [got[k].n_words for k in (1, 2, 3)] == [3, 0, 0] and got[2].logprob == 0 and got[3].mean_logprob is None
    assert got[1].units == 1 and got[1].logprob < 0


def test_decontamination_of_items_without_wording_needs_equal_fillers(spark):
    items = spark.createDataFrame([(1, "42"), (2, "see Paris"), (3, "how far does the old train of Anna go in 3 hours")],
                                  "item_id long, text string")
    docs = docs_of(spark, [(1, "there were 17 of them"), (2, "there were 42 of them"), (3, "we did see London today"),
                           (4, "we did see Paris today"), (5, "how far does the old train of Emma go in 7 hours"),
                           (6, None), (7, "")])
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()}
    assert got == {(2, 1), (4, 2), (5, 3)}
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {1, 3, 6, 7}

"""Fixture views: the reference's input shapes derived from the driver tables.

The mapping is fixed in FIXTURES.md; every view here is a lazy DataFrame over
``documents`` / ``labels`` / ``embeddings`` / ``conversations`` so its work
grows with the tables. The same definitions exist as DuckDB SQL in
``lexiscope.plans.oracle`` for the correctness check.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.functions.scalar import decide
from lexiscope.sources.tables import table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task-1 corpus ``(id, text, label, genre, source, model)``.

    documents ⋈ labels on doc_id; ``quality`` stands in for human (0) /
    machine (1), ``lang`` for genre, and ``model`` is 'human' or gen0..gen3.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id")
    return j.select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("quality").alias("label"),
        F.col("lang").alias("genre"),
        "source",
        F.when(F.col("quality") == 0, F.lit("human"))
         .otherwise(F.concat(F.lit("gen"), (F.col("doc_id") % 4).cast("string")))
         .alias("model"),
    )


def answer_score(id_col: Column, label_col: Column) -> Column:
    """Deterministic stand-in classifier score in [0, 1] (FIXTURES.md)."""
    return ((id_col * 7919 + 13) % 1000 + label_col * 400).cast("double") / F.lit(1399.0)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer file ``(id, label)``; ids divisible by 17 are missing on purpose,
    scores within 0.05 of 0.5 are 'unanswered' (0.5)."""
    c = corpus(spark, sf_dir).select("id", "label").where(F.col("id") % 17 != 0)
    p = answer_score(F.col("id"), F.col("label"))
    return c.select("id", decide(p).alias("label"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth file ``(id, label DOUBLE, source, model, genre)``."""
    return corpus(spark, sf_dir).select(
        "id", F.col("label").cast("double").alias("label"), "source", "model", "genre")


def raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, sent_id, i, tok)``: sentence = line, token = word or punctuation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return T.sentence_tokens(docs)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface-annotated token table: the input shape of the graph jobs."""
    from lexiscope.operators.graph import surface_annotate
    return surface_annotate(raw_tokens(spark, sf_dir))


def grouped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a row: ``(doc_id, copies, texts)``, ``copies`` counts the rows
    of the id, with or without a text."""
    return (table(spark, sf_dir, "documents").groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("copies"), F.collect_list("text").alias("texts")))


def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table with a document a row ``(doc_id, copies, texts, sents)``
    (see ``lexiscope.operators.graph``)."""
    return with_sentences(grouped_texts(spark, sf_dir))


def with_sentences(docs: DataFrame) -> DataFrame:
    """Adds ``sents``, the parse of the ``texts``. Texts of the same id are one
    document, whose sentences of the same number are one sentence. Works within
    the row; a row without ``texts`` has none."""
    from lexiscope.operators.graph import surface_sentence
    d = docs.withColumn("_lines", F.transform("texts", lambda t: F.transform(
        F.split(t, "\n"), lambda s: surface_sentence(T.tokenize(s)))))

    def sentence(a, k):
        return F.struct(k.alias("sent_id"), a.alias("a"))

    longest = F.array_max(F.transform("_lines", lambda x: F.size(x)))
    met = F.transform(F.sequence(F.lit(0), longest - 1), lambda k: sentence(F.array_sort(F.flatten(
        F.filter(F.transform("_lines", lambda x: F.get(x, k)), lambda a: a.isNotNull()))), k))
    one = F.transform(F.flatten("_lines"), sentence)
    return d.select(*docs.columns, F.when(F.size("texts") > 1, met).otherwise(one).alias("sents"))


def task2_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6-class corpus ``(id, text, label, language, source_dataset)``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), "text",
        (F.col("doc_id") % 6).cast("int").alias("label"),
        F.col("lang").alias("language"), F.col("source").alias("source_dataset"))


def pair_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs ``(id, text1, text2, label_txt1, label_txt2)``: a user turn and the
    assistant turn right after it in the same conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("nturn"), F.col("text").alias("text1"),
        F.col("turn").alias("uturn"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("nturn"), F.col("text").alias("text2"))
    return u.join(a, ["conv_id", "nturn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("uturn").cast("string")).alias("id"),
        "text1", "text2", F.lit(0).alias("label_txt1"), F.lit(1).alias("label_txt2"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-vector input ``(doc_id, pos, token, vec_id)`` for every token of
    every document: position 0 is the whole-document vector, token k of the
    document sits at position k+1; ``vec_id`` points into ``vectors``."""
    from lexiscope.sources.tables import spread
    n = F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("_n")))  # one row
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").crossJoin(n)
    toks = docs.select("doc_id", "_n", F.posexplode(T.tokenize(F.col("text"))).alias("i", "token"))
    toks = toks.select("doc_id", (F.col("i") + 1).cast("int").alias("pos"), "token",
                       ((F.length("token") * 31 + F.ascii("token")) % F.col("_n")).cast("long").alias("vec_id"))
    root = docs.select("doc_id", F.lit(0).alias("pos"), F.lit("").alias("token"),
                       (F.col("doc_id") % F.col("_n")).cast("long").alias("vec_id"))
    return toks.unionByName(root)


def with_vector_count(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Adds ``_n``, the rows of ``embeddings``, for ``with_token_ids``."""
    return docs.crossJoin(F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("_n"))))  # one row


def with_token_ids(docs: DataFrame) -> DataFrame:
    """``token_ids`` with a document a row: adds ``ids``, an array of
    ``(pos, token, vec_id)`` made from the document's ``texts`` and ``_n``."""

    def entry(pos, token, vec_id):
        return F.struct(pos.cast("int").alias("pos"), token.alias("token"), vec_id.cast("long").alias("vec_id"))

    toks = F.flatten(F.transform("texts", lambda t: F.transform(T.tokenize(t), lambda w, i: entry(
        i + 1, w, (F.length(w) * 31 + F.ascii(w)) % F.col("_n")))))
    roots = F.array_repeat(entry(F.lit(0), F.lit(""), F.col("doc_id") % F.col("_n")), F.col("copies").cast("int"))
    return docs.withColumn("ids", F.concat(roots, toks))


def word_vector_ids(words: list[str], n: int) -> np.ndarray:
    """The ``vec_id`` of ``token_ids`` for distinct words, ``n`` vectors."""
    return np.array([(len(w) * 31 + ord(w[0])) % n for w in words], np.int64)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, vec ARRAY<FLOAT>)`` from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, pos, token, vec)``: the token-vector table of FIXTURES.md."""
    return token_ids(spark, sf_dir).join(vectors(spark, sf_dir), "vec_id").drop("vec_id")


def task2_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in 6-class predictions ``(id, label, pred, logits)`` for the
    multi-class metrics: right for 60 % of ids, otherwise a hashed class;
    logits put +2 on the predicted class."""
    c = task2_corpus(spark, sf_dir).select("id", "label", "language")
    r = (F.col("id") * 7919 + 13) % 1000
    pred = F.when(r < 600, F.col("label")).otherwise((r % 6).cast("int"))
    c = c.select("id", "label", "language", pred.cast("int").alias("pred"))
    logits = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: ((F.col("id") * 31 + k * 17) % 100).cast("double") / 25.0
                         + F.when(k == F.col("pred"), F.lit(2.0)).otherwise(F.lit(0.0)))
    return c.select("id", "label", "pred", "language", logits.alias("logits"))

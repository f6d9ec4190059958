"""One query per operator, over the whole given tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm import align, ann, chat, decontam, jaccard, langid, lm, merkle, oracle, packing, quality, sharding, topk, toxicity
from lexiscope.llm.common import crc_mod, read

TOXIC_FROM, QUALITY_KEPT = 0.7, 0.3
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def learnt_from(labels: DataFrame, mod: int, held: int) -> DataFrame:
    """Labels without those of the held-out ids."""
    return labels.where(crc_mod("doc_id", mod) != held)


def held_out(mod: int, held: int):
    return F.coalesce(crc_mod("doc_id", mod) == held, F.lit(False))


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op2_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op3_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return (langid.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score"))


def op4_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.crc32("text").alias("text_crc32"), sharding.size_of("text").alias("bytes"),
                       "n_chars", F.crc32("lang").alias("lang"), F.crc32("source").alias("source"))
    metadata = {"doc_id": F.col("doc_id"), "n_chars": F.log1p("n_chars"),
                "lang": F.col("lang"), "source": F.col("source")}
    sharded = sharding.assign(rows, metadata, F.col("bytes"), ["doc_id", "text_crc32"])
    return (sharding.with_slots(sharded.select("doc_id", "size", "text_crc32", "shard"),
                                ["doc_id", "text_crc32"], docs.count())
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, learnt_from(read(spark, sf_dir, "labels"), 3, 1))
    return (toxicity.score(docs, model)
            .select("doc_id", held_out(3, 1).alias("held_out"), "score",
                    (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")))


def op6_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents").select("doc_id", "text"),
                            read(spark, sf_dir, "benchmark"))


def op8_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(said).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.expand(turns.unionByName(extra)))


def op9_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.fit(docs), keep=["doc_id"]).select("doc_id", "n_words", "logprob", "mean_logprob")


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, learnt_from(read(spark, sf_dir, "labels"), 5, 0))
    return (quality.score(docs, model)
            .select("doc_id", held_out(5, 0).alias("held_out"), "score",
                    (F.col("score") >= QUALITY_KEPT).cast("int").alias("predicted")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.digest([*columns, F.col("text")])
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    shown = F.when(crc_mod("doc_id", 3) == 0, merkle.digest([*columns, lowered])).otherwise(leaf)
    tree = merkle.build(docs, F.col("doc_id"), F.col("lang"), leaf, shown)
    return (merkle.climb(spark, tree)
            .select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                    F.sha2("siblings", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
                    (F.col("folded") == F.col("root")).alias("verified")))


def op12_exhaustive_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                       tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_cross_polytope, op2_minimum_bin_slack, op3_word_first_backoff, op4_kd_tree_sharding,
                            op5_ftrl_toxicity, op6_token_combination_join, op7_template_decontamination, op8_prefix_target_chat, op9_masked_pseudo_likelihood, op10_nbsvm_quality,
                            op11_merkle_manifest, op12_exhaustive_accumulation,
                            op13_tokenizer_alignment)}
ORACLE: dict[str, str] = {"op11_merkle_manifest": oracle.MERKLE, "op12_exhaustive_accumulation": oracle.TOPK}

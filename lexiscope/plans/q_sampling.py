"""Sampling / splitting / balancing queries and the corpus
loaders that use them (A3, A4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions.text import word_len
from lexiscope.operators import sampling as SM
from lexiscope.plans.catalog import register
from lexiscope.session import checkpointed
from lexiscope.plans.oracle import with_ctes
from lexiscope.plans.q_text import _d_word_len
from lexiscope.sources import fixtures as X

_H = "md5(concat_ws('|', '42', CAST({} AS VARCHAR)))".format


def _split_sql(src: str, by: str, ratio: float, names=("train", "test")) -> list[str]:
    """CTEs ``q_<src>`` (train quotas) and ``s_<src>`` (src + split)."""
    return [f"""c_{src} AS (SELECT {by} AS cls, count(*) AS cnt FROM {src} GROUP BY {by})""",
            f"""q_{src} AS (
  SELECT cls, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= ntrain - sum(fl) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT cls, ntrain, floor(cont) AS fl, cont - floor(cont) AS rem
        FROM (SELECT cls, CAST(total - ceil(CAST(total AS DOUBLE) * CAST({ratio} AS DOUBLE)) AS BIGINT) AS ntrain,
                     (CAST(cnt AS DOUBLE) / CAST(total AS DOUBLE)) * CAST(total - ceil(CAST(total AS DOUBLE) * CAST({ratio} AS DOUBLE)) AS DOUBLE) AS cont
              FROM c_{src}, (SELECT sum(cnt) AS total FROM c_{src}) t) a) b)""",
            f"""s_{src} AS (
  SELECT x.*, CASE WHEN rn <= quota THEN '{names[0]}' ELSE '{names[1]}' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {_H('id')}, id) AS rn FROM {src}) x
  JOIN q_{src} q ON x.{by} = q.cls)"""]


@register("shuffle", with_ctes(["corpus"]) + f"SELECT id, {_H('id')} AS shuffle_key FROM corpus")
def q_shuffle(spark, sf_dir):
    """The hash order key of every corpus row."""
    return X.corpus(spark, sf_dir).select("id", SM.hash_key("id").alias("shuffle_key"))


@register("stratified_split", with_ctes(["corpus"], _split_sql("corpus", "label", 0.2))
          + "SELECT id, label, split FROM s_corpus")
def q_stratified_split(spark, sf_dir):
    """80/20 split stratified by label."""
    return SM.stratified_split(X.corpus(spark, sf_dir).select("id", "label"), "label", 0.2)


@register("stratified_split_multi", with_ctes([], [
    "t2 AS (SELECT d.doc_id AS id, CAST(d.doc_id % 6 AS INTEGER) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"]
    + _split_sql("t2", "label", 0.3)) + "SELECT id, label, split FROM s_t2")
def q_stratified_split_multi(spark, sf_dir):
    """70/30 split stratified over the six classes."""
    return SM.stratified_split(X.task2_corpus(spark, sf_dir).select("id", "label"), "label", 0.3)


_PARTS = with_ctes(["corpus"], _split_sql("corpus", "label", 0.2))


def partitions(spark, sf_dir):
    """C4: the corpus with its split (train / test hold-out), named explicitly."""
    return SM.stratified_split(X.corpus(spark, sf_dir), "label", 0.2)


@register("build_partitions", _PARTS + "SELECT id, label, genre, model, split FROM s_corpus")
def q_build_partitions(spark, sf_dir):
    return partitions(spark, sf_dir).select("id", "label", "genre", "model", "split")


@register("load_corpus", _PARTS + f"SELECT id, split, {_d_word_len('text')} AS word_len FROM s_corpus")
def q_load_corpus(spark, sf_dir):
    """A3: the partitioned corpus with ``word_len`` added to each split."""
    # the texts are measured where they are read; the split carries the lengths
    c = X.corpus(spark, sf_dir).withColumn("word_len", word_len(F.col("text")))
    return SM.stratified_split(c, "label", 0.2).select("id", "split", "word_len")


@register("load_corpus_domain", with_ctes(["corpus"], [
    "dom AS (SELECT id, text, label, genre AS domain, model FROM corpus)",
    "ren AS (SELECT id, text, label, domain AS genre, model FROM dom)"] + _split_sql("ren", "label", 0.2))
    + f"SELECT id, genre, split, {_d_word_len('text')} AS word_len FROM s_ren")
def q_load_corpus_domain(spark, sf_dir):
    """A4: a corpus whose facet is called ``domain`` is renamed to ``genre``."""
    dom = X.corpus(spark, sf_dir).select("id", "text", "label", F.col("genre").alias("domain"), "model")
    df = dom.withColumnRenamed("domain", "genre").withColumn("word_len", word_len(F.col("text")))
    return SM.stratified_split(df, "label", 0.2).select("id", "genre", "split", "word_len")


@register("cutoff_percent", _PARTS + f"""
SELECT id, split FROM (
  SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY {_H('id')}, id) AS rn,
         count(*) OVER (PARTITION BY split) AS n FROM s_corpus) x
WHERE rn <= CAST(floor(CAST(n AS DOUBLE) * (CAST(10 AS DOUBLE) / 100)) AS BIGINT)""")
def q_cutoff_percent(spark, sf_dir):
    """10 % of every split ('10_10_10'), first rows in hash order."""
    pct = SM.parse_percent("10_10_10")[0]
    # the partitions are a written table before they are cut (lineage cut
    # into the shared checkpoint folder), so two exact takes do not nest
    parts = checkpointed(partitions(spark, sf_dir).select("id", "split"))
    return SM.take_percent(parts, pct, ["split"])


@register("leave_out_genre", _PARTS + """
SELECT id, genre, CASE WHEN split IN ('train', 'test') AND genre IN ('de', 'fr') THEN 'test'
                       WHEN split IN ('train', 'test') THEN 'train' ELSE split END AS split
FROM s_corpus""")
def q_leave_out_genre(spark, sf_dir):
    """Genres de and fr are held out: they move to the evaluation split,
    every other genre to training."""
    p = partitions(spark, sf_dir).select("id", "genre", "split")
    return SM.leave_out(p, ["de", "fr"], train="train", val="test")


@register("balance_by_label", with_ctes(["corpus"]) + f"""
SELECT id, label FROM (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_H('id')}, id) AS rn FROM corpus) x
WHERE rn <= (SELECT CASE WHEN count(*) < 2 THEN max(cnt) ELSE min(cnt) END
             FROM (SELECT label, count(*) AS cnt FROM corpus GROUP BY label) c)""")
def q_balance_by_label(spark, sf_dir):
    """Both labels down to the smaller label count."""
    return SM.balance_by_label(X.corpus(spark, sf_dir).select("id", "label"))


@register("balance_by_label_model", with_ctes(["corpus"]) + f"""
SELECT x.id, x.label, x.model FROM (
  SELECT id, label, model, row_number() OVER (PARTITION BY label, model ORDER BY {_H('id')}, id) AS rn FROM corpus) x
JOIN (SELECT label, min(cnt) AS quota FROM (SELECT label, model, count(*) AS cnt FROM corpus GROUP BY label, model) c
      GROUP BY label) q ON x.label = q.label
WHERE rn <= quota""")
def q_balance_by_label_model(spark, sf_dir):
    """Within each label every model down to that label's smallest model count."""
    return SM.balance_by_label_model(X.corpus(spark, sf_dir).select("id", "label", "model"))


@register("row_limit", with_ctes(["corpus"]) + f"SELECT id FROM corpus ORDER BY {_H('id')}, id LIMIT 100")
def q_row_limit(spark, sf_dir):
    """The first 100 rows in hash order (the limit is the feature)."""
    return SM.row_limit(X.corpus(spark, sf_dir).select("id"), 100)

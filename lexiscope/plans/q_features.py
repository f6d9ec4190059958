"""Text-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators import features as FE
from lexiscope.plans.catalog import register
from lexiscope.plans.oracle import with_ctes
from lexiscope.plans.q_text import _q
from lexiscope.sources import fixtures as X
from lexiscope.sources.tables import spread, table

_STOP = "[" + ", ".join(_q(w) for w in T.english_stop_words()) + "]"


def _n_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


@register("vocab_count", with_ctes(["raw_tokens"]) + """
SELECT term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df,
       CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx
FROM (SELECT term, tf, df FROM (SELECT tok AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM raw_tokens GROUP BY tok) s,
      (SELECT count(*) AS n FROM documents) n
      WHERE df >= 1 AND CAST(df AS DOUBLE) <= CAST(n AS DOUBLE) * 0.9 ORDER BY tf DESC, term LIMIT 5000) t""")
def q_vocab_count(spark, sf_dir):
    """F1: vocabulary with min_df=1, max_df=0.9, max_features=5000."""
    toks = X.raw_tokens(spark, sf_dir).select("doc_id", F.col("tok").alias("term"))
    return FE.vocab(toks, _n_docs(spark, sf_dir), 1, 0.9, 5000)


@register("vocab_tokens", with_ctes(["tokens"]) + """
SELECT term, CAST(freq AS BIGINT) AS freq, CAST(row_number() OVER (ORDER BY freq DESC, term) - 1 AS INTEGER) AS idx
FROM (SELECT text AS term, count(*) AS freq FROM tokens WHERE pos <> 'PUNCT' GROUP BY text
      HAVING count(*) >= 2 ORDER BY freq DESC, term LIMIT 5000) t""")
def q_vocab_tokens(spark, sf_dir):
    """frequency-ranked vocabulary of parsed tokens, punctuation dropped,
    min frequency 2, 5000 terms."""
    toks = X.tokens(spark, sf_dir).where(F.col("pos") != "PUNCT")
    return FE.vocab_by_freq(toks, 2, 5000)


@register("word_index_lookup", with_ctes(["raw_tokens"], ["""voc AS (
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx
FROM (SELECT term, tf, df FROM (SELECT tok AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM raw_tokens GROUP BY tok) s,
      (SELECT count(*) AS n FROM documents) n
      WHERE df >= 1 AND CAST(df AS DOUBLE) <= CAST(n AS DOUBLE) * 0.9 ORDER BY tf DESC, term LIMIT 5000) t)"""])
    + "SELECT r.doc_id, r.sent_id, r.i, v.idx FROM raw_tokens r JOIN voc v ON r.tok = v.term")
def q_word_index_lookup(spark, sf_dir):
    """every in-vocabulary token with its index."""
    raw = X.raw_tokens(spark, sf_dir)
    voc = FE.vocab(raw.select("doc_id", F.col("tok").alias("term")), _n_docs(spark, sf_dir), 1, 0.9, 5000)
    j = FE.index_tokens(raw.withColumnRenamed("tok", "term"), voc)
    return j.select("doc_id", "sent_id", "i", "idx")


_TF_SQL = rf"""WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE NOT list_contains({_STOP}, term) GROUP BY doc_id, term)
"""


def _tfidf_tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    t = docs.select("doc_id", F.explode(T.tokenize_tfidf(F.col("text"))).alias("term"))
    # IN over many literals is planned as a hash-set lookup (InSet)
    return t.where(~F.col("term").isin(T.english_stop_words()))


@register("term_frequency", _TF_SQL + "SELECT doc_id, term, tf FROM f")
def q_term_frequency(spark, sf_dir):
    """counts per (document, term), English stop words removed."""
    return FE.term_frequency(_tfidf_tokens(spark, sf_dir))


@register("tfidf", _TF_SQL + """,
d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT f.doc_id, f.term, CAST(f.tf AS DOUBLE) * (ln((CAST(n.n AS DOUBLE) + 1.0) / (CAST(d.df AS DOUBLE) + 1.0)) + 1.0) AS w
      FROM f JOIN d ON f.term = d.term, (SELECT count(*) AS n FROM documents) n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w""")
def q_tfidf(spark, sf_dir):
    """smooth-IDF TF-IDF weights, L2-normalised per document."""
    t = FE.tfidf(_tfidf_tokens(spark, sf_dir), n_docs=_n_docs(spark, sf_dir))
    return t.select("doc_id", "term", F.round("weight", 9).alias("weight"))


@register("truncate_tokens", with_ctes(["token_ids"]) + "SELECT doc_id, pos, token FROM token_ids WHERE pos < 512")
def q_truncate_tokens(spark, sf_dir):
    """token positions that reach the encoder (first 512)."""
    return FE.truncate_tokens(X.token_ids(spark, sf_dir)).select("doc_id", "pos", "token")

"""Text features: vocabularies, term frequencies, TF-IDF.

Relational forms work on a token table ``(doc_id, term)`` and stay exact;
``tfidf_stages`` gives the Spark ML form for the classifier pipelines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_frequency(tokens: DataFrame, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """occurrences of each term per document (partial aggregate)."""
    return tokens.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))


def term_stats(tokens: DataFrame, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """Per term: total frequency and document frequency. Two aggregation
    steps (per (doc, term), then per term), both partially aggregated, so a
    term found in every document is not gathered row by row in one task."""
    tf = term_frequency(tokens, doc, term)
    return tf.groupBy(term).agg(F.sum("tf").cast("long").alias("tf"), F.count(F.lit(1)).alias("df"))


def vocab(tokens: DataFrame, n_docs, min_df: int = 1, max_df: float = 0.9,
          max_features: int | None = 5000, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """keep terms with ``df >= min_df`` and ``df <= max_df·n_docs``, then
    the ``max_features`` most frequent by total count (ties: alphabetical),
    numbered in alphabetical order -> ``(term, tf, df, idx)``.

    ``n_docs`` is an int or a one-row DataFrame with column ``n``. The top-k
    is a TakeOrdered (per-partition top-k, then merge: no global sort); the
    final numbering window sees at most ``max_features`` rows."""
    st = term_stats(tokens, doc, term)
    if isinstance(n_docs, DataFrame):
        st = st.crossJoin(F.broadcast(n_docs.select(F.col("n").alias("_n"))))  # one row
    else:
        st = st.withColumn("_n", F.lit(int(n_docs)))
    limit_df = F.col("_n") * F.lit(float(max_df)) if isinstance(max_df, float) else F.lit(int(max_df))
    st = st.where((F.col("df") >= min_df) & (F.col("df") <= limit_df)).drop("_n")
    if max_features is not None:
        st = st.orderBy(F.desc("tf"), F.col(term)).limit(int(max_features))
    w = Window.orderBy(term)  # bounded by max_features
    return st.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def vocab_by_freq(tokens: DataFrame, min_freq: int = 1, max_features: int = 5000,
                  term: str = "text") -> DataFrame:
    """token texts counted over all occurrences, ``freq >= min_freq``,
    most frequent first (ties by term), first ``max_features``; index = rank.
    Stop-word / punctuation filtering is applied by the caller on ``tokens``."""
    c = tokens.groupBy(term).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_freq)
    top = c.orderBy(F.desc("freq"), F.col(term)).limit(int(max_features))
    w = Window.orderBy(F.desc("freq"), F.col(term))  # bounded by max_features
    return top.withColumn("idx", (F.row_number().over(w) - 1).cast("int")).withColumnRenamed(term, "term")


def index_tokens(tokens: DataFrame, voc: DataFrame, term: str = "term") -> DataFrame:
    """token -> vocabulary index; out-of-vocabulary tokens are dropped. The
    join is left to AQE, which sees the vocabulary's real size."""
    v = voc.select(F.col("term").alias(term), "idx")
    return tokens.join(v, term)


def tfidf(tokens: DataFrame, doc: str = "doc_id", term: str = "term", n_docs=None) -> DataFrame:
    """``tf · (ln((1+n)/(1+df)) + 1)``, L2-normalised per document ->
    ``(doc_id, term, weight)``.

    The per-document term counts are materialised once (a checkpoint in the
    shared folder: read twice below, and a lineage cut). The join
    with the document frequencies is left to AQE, which broadcasts them only
    below its byte threshold and else splits very common (skewed) terms. The L2
    norm is a window over one document's distinct terms."""
    from lexiscope.session import checkpointed
    tf = checkpointed(term_frequency(tokens, doc, term))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    if n_docs is None:
        n_docs = tf.select(doc).distinct().agg(F.count(F.lit(1)).alias("n"))
    if isinstance(n_docs, DataFrame):
        df = df.crossJoin(F.broadcast(n_docs.select(F.col("n").alias("_n"))))  # one row
    else:
        df = df.withColumn("_n", F.lit(int(n_docs)))
    idf = F.log((F.col("_n") + 1.0) / (F.col("df") + 1.0)) + 1.0
    d = df.select(term, idf.alias("idf"))
    w = tf.join(d, term).select(doc, term, (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, term, (F.col("w") / norm).alias("weight"))


def truncate_tokens(token_vecs: DataFrame, max_len: int = 512, pos: str = "pos") -> DataFrame:
    """only the first ``max_len`` positions count (pushed into the scan /
    before any join)."""
    return token_vecs.where(F.col(pos) < max_len)


def tfidf_stages(stop_words: list[str] | None = None, vocab_size: int = 1 << 18, min_df: float = 1.0):
    """Spark ML stages text -> L2-normalised TF-IDF vector ``features``.

    Spark's IDF is ``ln((n+1)/(df+1))``; the smooth-IDF weight adds 1, which
    ``SmoothIdf`` below applies as an elementwise product learnt at fit time
    (a vector of ``vocab_size`` doubles at most)."""
    from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
    from lexiscope.functions.text import TFIDF_PATTERN, english_stop_words
    tok = RegexTokenizer(inputCol="text", outputCol="_tok", pattern=TFIDF_PATTERN, gaps=False,
                         toLowercase=True)
    sw = StopWordsRemover(inputCol="_tok", outputCol="_tok2",
                          stopWords=english_stop_words() if stop_words is None else stop_words)
    cv = CountVectorizer(inputCol="_tok2", outputCol="_tf", vocabSize=vocab_size, minDF=min_df)
    return [tok, sw, cv, SmoothIdf(inputCol="_tf", outputCol="features")]


from pyspark import keyword_only  # noqa: E402
from pyspark.ml import Estimator, Model  # noqa: E402
from pyspark.ml.param.shared import HasInputCol, HasOutputCol  # noqa: E402
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable  # noqa: E402


class SmoothIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits Spark's ``IDF`` and returns a model that scales term counts by
    ``idf + 1`` and L2-normalises: the smooth-IDF TF-IDF weighting."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        from pyspark.ml import PipelineModel
        from pyspark.ml.feature import IDF, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import DenseVector
        idf = IDF(inputCol=self.getInputCol(), outputCol="_idf_unused").fit(dataset)
        scale = DenseVector(idf.idf.toArray() + 1.0)
        ep = ElementwiseProduct(scalingVec=scale, inputCol=self.getInputCol(), outputCol="_scaled")
        nm = Normalizer(p=2.0, inputCol="_scaled", outputCol=self.getOutputCol())
        return PipelineModel([ep, nm])

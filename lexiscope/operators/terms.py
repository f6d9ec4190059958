"""TF-IDF rows for classifiers, over the whole vocabulary.

``TermVectorizer`` numbers all distinct terms of its training texts in
alphabetical order (a sort by ranges plus counts per range, so no task and not
the driver ever holds the vocabulary) and keeps them as a table
``(term, idx, df, idf)``. ``TermVectorizerModel.transform`` joins the terms of
new texts with that table and collects each text's weights, in the order of
their numbers, into a sparse vector: ``indices``, ``values`` and ``features``
(the same as a Spark ML vector). A text without a known term has an empty one.

The rows are written once to the checkpoint folder: iterative solvers read
them many times, and reading them back with the vector type makes Spark ML
vectors without any Python code.
"""

from __future__ import annotations

import os

from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexiscope.functions.text import english_stop_words, tokenize_tfidf
from lexiscope.operators.features import term_frequency
from lexiscope.session import checkpointed


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """The rows, written to a folder of their own below the checkpoint folder
    and read back (with ``schema`` if given)."""
    from lexiscope.sources.files import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def coded(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Rows with the position (from 0) of their value in sorted order; the
    values are distinct. Rows are sorted by ranges and counted per range, and
    only those counts (one a partition) are cumulated on the driver."""
    spark = df.sparkSession
    placed = written(df.repartitionByRange(column).sortWithinPartitions(column)
                     .withColumn("_at", F.monotonically_increasing_id()), "coded")
    part = F.shiftright("_at", 33)
    starts, before = [], 0
    for r in sorted(placed.groupBy(part.alias("p")).count().collect()):
        starts.append((r[0], before))
        before += r[1]
    starts = spark.createDataFrame(starts, "_part long, _before long")
    return (placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_before", "_at"))


def terms_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)``: the terms of each text without English stop words."""
    t = rows.select(key, F.explode(tokenize_tfidf(F.col(text))).alias("term"))
    return term_frequency(t.where(~F.col("term").isin(english_stop_words())), key, "term")


class TermVectorizer(Estimator):
    """Learns the vocabulary and the smooth inverse document frequencies
    ``ln((1 + n) / (1 + df)) + 1``."""

    def __init__(self, text: str = "text"):
        super().__init__()
        self.text = text

    def _fit(self, df: DataFrame) -> "TermVectorizerModel":
        rows = checkpointed(df.select(self.text).withColumn("_row", F.monotonically_increasing_id()))
        n = rows.count()
        counts = terms_of(rows, "_row", self.text).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log((F.lit(float(n)) + 1.0) / (F.col("df") + 1.0)) + 1.0
        vocabulary = written(coded(counts, "term").withColumn("idf", idf), "vocabulary")
        return TermVectorizerModel(vocabulary, n, vocabulary.count(), self.text)


class TermVectorizerModel(Model, MLWritable, MLReadable):
    def __init__(self, vocabulary: DataFrame | None = None, n_docs: int = 0, size: int = 0, text: str = "text"):
        super().__init__()
        self.vocabulary, self.n_docs, self.size, self.text = vocabulary, n_docs, size, text

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
        known = self.vocabulary.select("term", "idx", "idf")
        weighted = (terms_of(rows, "_row", self.text).join(known, "term")
                    .select("_row", "idx", (F.col("tf") * F.col("idf")).alias("w")))
        # the terms of one text, in the order of their numbers
        listed = (weighted.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("t"))
                  .withColumn("norm", F.sqrt(F.aggregate("t.w", F.lit(0.0), lambda s, w: s + w * w))))
        vectors = listed.select("_row", F.transform("t.idx", lambda i: i.cast("int")).alias("indices"),
                                F.transform("t.w", lambda w: w / F.col("norm")).alias("values"))
        none = (F.array().cast("array<int>"), F.array().cast("array<double>"))
        out = (rows.join(vectors, "_row", "left").drop("_row")
               .withColumn("indices", F.coalesce("indices", none[0]))
               .withColumn("values", F.coalesce("values", none[1])))
        sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(max(self.size, 1)).alias("size"),
                          F.col("indices"), F.col("values"))
        schema = StructType([*out.schema.fields, StructField("features", VectorUDT())])
        return written(out.withColumn("features", sparse), "features", schema)

    def write(self) -> MLWriter:
        return _VectorizerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _VectorizerReader(cls)


class _VectorizerWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "n_docs": m.n_docs, "size": m.size, "text": m.text})
        m.vocabulary.write.parquet(os.path.join(path, "vocabulary"))


class _VectorizerReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        m = self.cls(self.sparkSession.read.parquet(os.path.join(path, "vocabulary")),
                     meta["n_docs"], meta["size"], meta["text"])
        m._resetUid(meta["uid"])
        return m

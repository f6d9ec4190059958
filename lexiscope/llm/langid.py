"""Language id: word-first backoff.

A word that the training texts contain is scored by its log frequency in every
language. An unseen word is scored by its character n-grams, padded with word
marks: at each position the longest known n-gram that ends there counts, from
MAX_GRAM characters down to one. The mean over the positions stands for one
word. A text's score is the softmax of the words' sums.

Defined results: ``und`` with score 0 for a null text or one without a letter
(``str.isalpha``), and for every text if there was nothing to learn from; a
tie goes to the alphabetically first language; repeated rows score alike;
other columns pass through (columns named like the outputs are replaced).
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lexiscope.llm.common import sample_by_hash, small_batches

SAMPLE_PER_LANGUAGE = 2500
WORDS, GRAMS = 120_000, 80_000  # entries of the model, shared by the languages
MAX_GRAM = 4
SMOOTHING = 0.5
CACHE = 200_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower()) if text else []


@dataclasses.dataclass
class LanguageModel:
    languages: list[str]
    index: dict[str, int]       # word -> row
    table: np.ndarray           # log frequencies, rows by languages
    gram_index: dict[str, int]
    gram_table: np.ndarray

    def __post_init__(self):
        self._unseen: dict[str, list[int]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def backoff(self, word: str) -> list[int]:
        """Rows of the n-grams that stand for an unseen word."""
        rows = self._unseen.get(word)
        if rows is None:
            if len(self._unseen) >= CACHE:
                self._unseen.clear()
            rows = self._unseen[word] = []
            marked, find = f"<{word}>", self.gram_index.get
            for end in range(2, len(marked) + 1):
                for n in range(min(MAX_GRAM, end), 0, -1):
                    row = find(marked[end - n:end])
                    if row is not None:
                        rows.append(row)
                        break
        return rows

    def log_scores(self, text: str | None) -> np.ndarray | None:
        """Sum over the words; None without a letter."""
        seen = Counter(words(text))
        if not seen:
            return None
        rows, counts, gram_rows, shares = [], [], [], []
        for w, n in seen.items():
            row = self.index.get(w)
            if row is not None:
                rows.append(row)
                counts.append(n)
            elif got := self.backoff(w):
                gram_rows += got
                shares += [n / len(got)] * len(got)
        total = np.zeros(len(self.languages))
        if rows:
            total += np.array(counts, float) @ self.table[rows]
        if gram_rows:
            total += np.array(shares) @ self.gram_table[gram_rows]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        s = self.log_scores(text) if self.languages else None
        if s is None:
            return UNKNOWN, 0.0
        k = int(s.argmax())
        return self.languages[k], float(1.0 / np.exp(np.minimum(s - s[k], 0)).sum())


def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words and n-grams of a batch of (lang, text)."""
    for b in batches:
        out = []
        for lang, texts in b.groupby("lang").text:
            seen: Counter = Counter()
            for t in texts:
                seen.update(words(t))
            grams: Counter = Counter()
            for w, n in seen.items():
                marked = f"<{w}>"
                for end in range(2, len(marked) + 1):
                    for size in range(min(MAX_GRAM, end), 0, -1):
                        grams[marked[end - size:end]] += n
            out += [(lang, 0, w, n) for w, n in seen.items()]
            out += [(lang, len(g), g, n) for g, n in grams.items()]
        yield pd.DataFrame(out, columns=["lang", "size", "token", "n"])


def log_table(rows: pd.DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Token -> row, and smoothed log frequencies by language."""
    names = sorted(rows.token.unique())
    index = {t: k for k, t in enumerate(names)}
    at = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(names), len(languages)))
    counts[rows.token.map(index).to_numpy(int), rows.lang.map(at).to_numpy(int)] = rows.n
    totals = counts.sum(axis=0) + SMOOTHING * max(1, len(names))
    return index, np.log((counts + SMOOTHING) / totals)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample: about ``per_language`` rows of each language by
    a hash of ``key``. The counts stay in Spark; the model has at most WORDS
    words and GRAMS n-grams, the most frequent of each language in equal
    shares."""
    small_batches(rows.sparkSession)
    clean = (rows.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
             .where("lang is not null and k is not null"))
    sample = sample_by_hash(clean, "k", per_language, "lang").select("lang", "text")
    counts = (sample.mapInPandas(tally, "lang string, size int, token string, n long")
              .groupBy("lang", "size", "token").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in clean.select("lang").distinct().collect())
    share = max(1, len(languages))
    place = F.row_number().over(Window.partitionBy("lang", F.col("size") == 0)
                                .orderBy(F.desc("n"), "size", "token"))
    kept = (counts.withColumn("place", place)
            .where(F.col("place") <= F.when(F.col("size") == 0, WORDS // share).otherwise(GRAMS // share))
            .drop("place").toPandas())
    w, g = kept[kept["size"] == 0], kept[kept["size"] > 0]
    return LanguageModel(languages, *log_table(w, languages), *log_table(g, languages))


def identify(df: DataFrame, model: LanguageModel, text: str = "text",
             out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its probability."""
    small_batches(df.sparkSession)
    base = df.drop(*[c for c in (out, score) if c in df.columns])
    schema = StructType([*base.schema.fields, StructField(out, StringType()),
                         StructField(score, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [model.predict(t) for t in b[text]]
            b[out] = pd.Series([x for x, _ in got], index=b.index, dtype=object)
            b[score] = [float(y) for _, y in got]
            yield b

    return base.mapInPandas(run, schema)

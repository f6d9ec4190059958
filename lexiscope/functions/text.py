"""Text normalisation and tokenisation as Spark SQL expressions.

Regular expressions are written so that Java (Spark) and RE2 (the DuckDB
oracle) read them the same way: word characters are ``[\\p{L}\\p{N}_]``
rather than ``\\w`` (ASCII-only in Java without flags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay as written for results to agree)
# ---------------------------------------------------------------------------
WORD = r"[\p{L}\p{N}_]"
# A run of word characters, or one character that is neither a word
# character nor whitespace.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Words of two or more word characters (unigram vectoriser default).
TFIDF_PATTERN = r"[\p{L}\p{N}_]{2,}"
APOSTROPHE_PATTERN = r"([A-Za-z]+)['`]([A-Za-z]+)"
# (?d): only \n ends a line for '.', as in Python (Java also stops at \r,
# U+0085, U+2028, U+2029 by default).
HTML_TAG_PATTERN = r"(?d)<.*?>"
# Whitespace run; (?U) makes Java's \s Unicode-aware (U+00A0 etc.).
BLANK_PATTERN = r"(?U)\s+"

# English contractions expanded by B2 (our own table; lower-case keys).
CONTRACTIONS = {
    "ain't": "are not", "aren't": "are not", "can't": "cannot",
    "can't've": "cannot have", "could've": "could have", "couldn't": "could not",
    "didn't": "did not", "doesn't": "does not", "don't": "do not",
    "hadn't": "had not", "hasn't": "has not", "haven't": "have not",
    "he'd": "he would", "he'll": "he will", "he's": "he is",
    "how'd": "how did", "how'll": "how will", "how's": "how is",
    "i'd": "i would", "i'll": "i will", "i'm": "i am", "i've": "i have",
    "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is",
    "let's": "let us", "might've": "might have", "mightn't": "might not",
    "must've": "must have", "mustn't": "must not", "needn't": "need not",
    "shan't": "shall not", "she'd": "she would", "she'll": "she will",
    "she's": "she is", "should've": "should have", "shouldn't": "should not",
    "that'd": "that would", "that's": "that is", "there'd": "there would",
    "there's": "there is", "they'd": "they would", "they'll": "they will",
    "they're": "they are", "they've": "they have", "wasn't": "was not",
    "we'd": "we would", "we'll": "we will", "we're": "we are",
    "we've": "we have", "weren't": "were not", "what'll": "what will",
    "what're": "what are", "what's": "what is", "what've": "what have",
    "where'd": "where did", "where's": "where is", "who'd": "who would",
    "who'll": "who will", "who's": "who is", "who've": "who have",
    "why's": "why is", "won't": "will not", "would've": "would have",
    "wouldn't": "would not", "y'all": "you all", "you'd": "you would",
    "you'll": "you will", "you're": "you are", "you've": "you have",
}


# Spark ML's default English stop-word list (StopWordsRemover, 181 words),
# kept here so SQL text can be built without a running JVM.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've "
    "isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't "
    "shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's "
    "when's where's who's why's would").split()


def english_stop_words() -> list[str]:
    """The English stop-word list (181 words)."""
    return list(ENGLISH_STOP_WORDS)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# B1
def norm_lower(c) -> Column:
    return F.lower(_c(c))


def _contraction_map() -> Column:
    kv = []
    for k, v in CONTRACTIONS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


# B2
def norm_contractions(c) -> Column:
    """Split on whitespace, expand each word through CONTRACTIONS, join with
    one blank (this already collapses whitespace)."""
    m = _contraction_map()
    t = F.trim(F.regexp_replace(_c(c), BLANK_PATTERN, " "))
    words = F.split(t, " ")
    out = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w)), " ")
    return F.when(t == "", F.lit("")).otherwise(out)


# B3
def norm_apostrophe(c) -> Column:
    return F.regexp_replace(_c(c), APOSTROPHE_PATTERN, "$1$2")


# B4
def norm_blank(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), BLANK_PATTERN, " "))


# B5
def norm_html(c) -> Column:
    return F.regexp_replace(_c(c), HTML_TAG_PATTERN, "")


# B6
def norm_special(c) -> Column:
    x = F.regexp_replace(_c(c), r"[^A-Za-z0-9]+ ", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " ")
    x = F.regexp_replace(x, '"', " ")
    x = F.regexp_replace(x, r"\(", " ")
    return norm_blank(x)


# B7
def norm_stopwords(c, stop: list[str] | None = None) -> Column:
    """Word-tokenise (B11 tokens), drop tokens whose lower-case form is a stop
    word, join with one blank."""
    stop = english_stop_words() if stop is None else stop
    toks = F.regexp_extract_all(_c(c), F.lit(TOKEN_PATTERN), 0)
    # IN over many literals becomes a hash-set lookup (InSet)
    kept = F.filter(toks, lambda w: ~F.lower(w).isin(list(stop)))
    return F.array_join(kept, " ")


# B8
def text_normalize(c, special_chars: bool = False, stop_words: bool = False) -> Column:
    x = norm_lower(c)
    x = norm_contractions(x)
    x = norm_apostrophe(x)
    x = norm_blank(x)
    x = norm_html(x)
    if special_chars:
        x = norm_special(x)
    if stop_words:
        x = norm_stopwords(x)
    return x


# B9
def text_normalize_notebook(c, stop: list[str] | None = None) -> Column:
    x = norm_lower(c)
    x = norm_blank(x)
    x = norm_html(x)
    x = F.regexp_replace(x, r"[^A-Za-z0-9]+ ", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_]+ ", " ")
    x = F.regexp_replace(x, '"', " ")
    x = norm_blank(x)
    return norm_stopwords(x, stop)


# B10
def word_len(c) -> Column:
    """Number of whitespace-separated words; 0 for empty/blank text."""
    t = F.trim(F.regexp_replace(_c(c), BLANK_PATTERN, " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("int")


# B11
def tokenize(c, pattern: str = TOKEN_PATTERN, lower: bool = True) -> Column:
    x = F.lower(_c(c)) if lower else _c(c)
    return F.regexp_extract_all(x, F.lit(pattern), 0)


# B12
def tokenize_tfidf(c) -> Column:
    return tokenize(c, TFIDF_PATTERN)


def sentence_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, sent_id, i, tok)``: each line is a sentence, tokens by B11.

    Two generator steps, both streaming per row: no shuffle, no row
    materialised beyond one document.
    """
    from lexiscope.sources.tables import spread
    docs = spread(docs, "doc_id")
    s = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n")).alias("sent_id", "sent"))
    return s.select(
        "doc_id", F.col("sent_id").cast("int").alias("sent_id"),
        F.posexplode(tokenize(F.col("sent"))).alias("i", "tok"),
    ).select("doc_id", "sent_id", F.col("i").cast("int").alias("i"), "tok")

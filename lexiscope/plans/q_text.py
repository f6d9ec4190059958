"""Text normalisation, tokenisation and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import scalar as S
from lexiscope.functions import text as T
from lexiscope.plans.catalog import register
from lexiscope.plans.oracle import with_ctes
from lexiscope.sources import fixtures as X
from lexiscope.sources.tables import table

# ----------------------------------------------------------------- DuckDB forms
_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _d_blank(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _d_contractions(x: str) -> str:
    m = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in T.CONTRACTIONS.items()) + "}"
    t = _d_blank(x)
    return (f"(CASE WHEN {t} = '' THEN '' ELSE array_to_string(list_transform(string_split({t}, ' '), "
            f"lambda w: coalesce({m}[w], w)), ' ') END)")


def _d_apostrophe(x: str) -> str:
    return f"regexp_replace({x}, '([A-Za-z]+)[''`]([A-Za-z]+)', '\\1\\2', 'g')"


def _d_html(x: str) -> str:
    return f"regexp_replace({x}, '<.*?>', '', 'g')"


def _d_special(x: str) -> str:
    x = f"regexp_replace({x}, '[^A-Za-z0-9]+ ', ' ', 'g')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
    x = f"replace({x}, '\"', ' ')"
    x = f"replace({x}, '(', ' ')"
    return _d_blank(x)


def _d_stop(x: str) -> str:
    lst = "[" + ", ".join(_q(w) for w in T.english_stop_words()) + "]"
    return (f"array_to_string(list_filter(regexp_extract_all({x}, '{_TOK}'), "
            f"lambda w: NOT list_contains({lst}, lower(w))), ' ')")


def _d_normalize(x: str, special=False, stop=False) -> str:
    x = _d_html(_d_blank(_d_apostrophe(_d_contractions(f"lower({x})"))))
    if special:
        x = _d_special(x)
    if stop:
        x = _d_stop(x)
    return x


def _d_notebook(x: str) -> str:
    x = _d_html(_d_blank(f"lower({x})"))
    x = f"regexp_replace({x}, '[^A-Za-z0-9]+ ', ' ', 'g')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+ ', ' ', 'g')"
    x = f"replace({x}, '\"', ' ')"
    return _d_stop(_d_blank(x))


def _d_word_len(x: str) -> str:
    t = _d_blank(x)
    return f"CAST(CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END AS INTEGER)"


def _docs(spark, sf_dir):
    from lexiscope.sources.tables import spread
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _doc_query(name: str, spark_fn, duck_fn):
    @register(name, f"SELECT doc_id, {duck_fn('text')} AS text FROM documents")
    def q(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", spark_fn(F.col("text")).alias("text"))
    q.__name__ = f"q_{name}"
    return q


# B1-B9 over every document
_doc_query("norm_lower", T.norm_lower, lambda x: f"lower({x})")
_doc_query("norm_contractions", T.norm_contractions, _d_contractions)
_doc_query("norm_apostrophe", T.norm_apostrophe, _d_apostrophe)
_doc_query("norm_blank", T.norm_blank, _d_blank)
_doc_query("norm_special", T.norm_special, _d_special)
_doc_query("norm_stopwords", T.norm_stopwords, _d_stop)
_doc_query("text_normalize", T.text_normalize, _d_normalize)
_doc_query("text_normalize_full", lambda c: T.text_normalize(c, special_chars=True, stop_words=True),
           lambda x: _d_normalize(x, True, True))
_doc_query("text_normalize_notebook", T.text_normalize_notebook, _d_notebook)


@register("norm_html", f"SELECT page_id, {_d_html('html')} AS text FROM pages")
def q_norm_html(spark, sf_dir):
    """B5 over raw web pages: tags removed, whitespace left as is."""
    return table(spark, sf_dir, "pages").select("page_id", T.norm_html(F.col("html")).alias("text"))


@register("word_len", f"SELECT doc_id, {_d_word_len('text')} AS word_len FROM documents")
def q_word_len(spark, sf_dir):
    """Whitespace word count per document (0 for blank text)."""
    return _docs(spark, sf_dir).select("doc_id", T.word_len(F.col("text")).alias("word_len"))


@register("tokenize_words_punct", with_ctes(["raw_tokens"]) + "SELECT doc_id, sent_id, i, tok FROM raw_tokens")
def q_tokenize_words_punct(spark, sf_dir):
    """Sentence (line) and token position of every word / punctuation token."""
    return X.raw_tokens(spark, sf_dir)


@register("tokenize_tfidf", r"""
SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS i, unnest(a) AS tok
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS a FROM documents) s""")
def q_tokenize_tfidf(spark, sf_dir):
    """Vectoriser tokens (two or more word characters), lower-cased."""
    from lexiscope.sources.tables import spread
    d = spread(_docs(spark, sf_dir), "doc_id")
    return d.select("doc_id", F.posexplode(T.tokenize_tfidf(F.col("text"))).alias("i", "tok")) \
            .select("doc_id", F.col("i").cast("int").alias("i"), "tok")


# ----------------------------------------------------------------- B13-B20
@register("softmax_prob", """
SELECT vec_id, CAST(k AS INTEGER) AS k, round(pr, 9) AS prob FROM (
  SELECT vec_id, unnest(range(len(e))) AS k,
         unnest(list_transform(e, lambda x: x / list_sum(e))) AS pr
  FROM (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a) b) c""")
def q_softmax_prob(spark, sf_dir):
    """Class probabilities of each embedding row read as logits."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.select("vec_id", F.posexplode(S.softmax(F.col("v"))).alias("k", "pr"))
    return p.select("vec_id", F.col("k").cast("int").alias("k"), F.round("pr", 9).alias("prob"))


@register("argmax_class", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS cls FROM embeddings""")
def q_argmax_class(spark, sf_dir):
    """Index of the largest component, first wins."""
    return table(spark, sf_dir, "embeddings").select("vec_id", S.argmax(F.col("embedding")).alias("cls"))


@register("undecidable_rule", with_ctes(["answers"]) + "SELECT id, label FROM answers")
def q_undecidable_rule(spark, sf_dir):
    """Scores within 0.05 of 0.5 become 0.5, the rest rounded to 4 places."""
    return X.answers(spark, sf_dir)


@register("clip_score", with_ctes(["scored"]) + """
SELECT id, least(greatest(p * 1.5 - 0.25, 0.0), 1.0) AS p FROM scored""")
def q_clip_score(spark, sf_dir):
    """Scores stretched beyond [0, 1] and clipped back."""
    from lexiscope.operators.metrics import join_answers
    j = join_answers(X.truth(spark, sf_dir), X.answers(spark, sf_dir))
    return j.select("id", S.clip01(F.col("p") * 1.5 - 0.25).alias("p"))


def label_names(spark):
    """The 6-row label dictionary (fixed size, safe to broadcast)."""
    return spark.createDataFrame(S.LABEL_NAMES, "label INT, label_text STRING")


_LABELS_SQL = "(VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in S.LABEL_NAMES) + ") AS ln(label, label_text)"


@register("label_name", f"""
SELECT d.doc_id AS id, CAST(d.doc_id % 6 AS INTEGER) AS label, ln.label_text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN {_LABELS_SQL} ON CAST(d.doc_id % 6 AS INTEGER) = ln.label""")
def q_label_name(spark, sf_dir):
    """Class id -> description on the 6-class corpus."""
    c = X.task2_corpus(spark, sf_dir).select("id", "label")
    return c.join(F.broadcast(label_names(spark)), "label").select("id", "label", "label_text")

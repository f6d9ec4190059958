"""Scalar helpers over scores, probabilities and closed tag sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Closed tag vocabularies (index = position in the list)
# ---------------------------------------------------------------------------
POS_TAGS = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "PROPN", "AUX", "CCONJ", "SCONJ",
            "ADP", "DET", "NUM", "PART", "INTJ", "PUNCT", "SYM", "X", "ROOT_0"]
DEP_TAGS = ["ROOT", "nsubj", "obj", "iobj", "obl", "nmod", "amod", "advmod", "aux",
            "cop", "mark", "cc", "conj", "det", "case", "compound", "xcomp", "ccomp",
            "acl", "appos", "nummod", "punct", "dep", "parataxis"]
# Label names of the 6-class task.
LABEL_NAMES = [(0, "fully human-written"), (1, "human-written, then machine-polished"),
               (2, "machine-written, then machine-humanized"),
               (3, "human-initiated, then machine-continued"),
               (4, "deeply-mixed text; where some parts are written by a human and some are generated by a machine"),
               (5, "machine-written, then human-edited")]
UNDECIDED = 0.5
UNDECIDED_MARGIN = 0.05


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _index_map(tags: list[str]) -> Column:
    kv = []
    for i, t in enumerate(tags):
        kv += [F.lit(t), F.lit(i)]
    return F.create_map(*kv)


# B13
def softmax(logits) -> Column:
    """Array of logits -> array of probabilities (max-shifted)."""
    a = _c(logits)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


# B14
def decide(p, margin: float = UNDECIDED_MARGIN) -> Column:
    """Scores within ``margin`` of 0.5 become 0.5 (unanswered), the rest are
    rounded to 4 decimals."""
    p = _c(p)
    return (F.when(F.abs(p - F.lit(UNDECIDED)) <= F.lit(margin), F.lit(UNDECIDED))
            .otherwise(F.round(p, 4))).cast("double")


# B15
def argmax(probs) -> Column:
    a = _c(probs)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


# B16
def pos_id(node) -> Column:
    """Node key ``word_POS`` -> index of POS in POS_TAGS; unknown -> index of X."""
    n = _c(node)
    suffix = F.when(F.instr(n, "_") > 0, F.substring_index(n, "_", -1)).otherwise(F.lit("X"))
    return F.coalesce(F.try_element_at(_index_map(POS_TAGS), suffix),
                      F.lit(POS_TAGS.index("X"))).cast("int")


# B17
def pos_one_hot(node) -> Column:
    n = _c(node)
    suffix = F.when(F.instr(n, "_") > 0, F.substring_index(n, "_", -1)).otherwise(F.lit("X"))
    idx = F.try_element_at(_index_map(POS_TAGS), suffix)
    return F.transform(F.sequence(F.lit(0), F.lit(len(POS_TAGS) - 1)),
                       lambda k: F.when(k == idx, F.lit(1.0)).otherwise(F.lit(0.0)))


# B18
def dep_id(dep) -> Column:
    return F.coalesce(F.try_element_at(_index_map(DEP_TAGS), _c(dep)),
                      F.lit(DEP_TAGS.index("dep"))).cast("int")


# B20
def clip01(p) -> Column:
    return F.least(F.greatest(_c(p), F.lit(0.0)), F.lit(1.0))

"""Packing: minimum bin slack.

Documents become token ids plus an end id. A document longer than the capacity
is cut into full sequences; what remains of each is shorter than the capacity.
How many remainders there are of each length is a table of at most ``capacity``
rows, whatever the corpus. From it, window after window is planned: the largest
remaining length opens the window, and a bitset subset-sum dynamic programme
over the remaining multiset finds the fill closest to the capacity; walking it
back gives how many pieces of each length to take. A plan is repeated while its
lengths last, so there are few plans. Each remainder is then numbered within
its length in Spark, and the plans' ranges of numbers say where it goes.

Defined results: a null or empty text is the end id alone; a null doc_id is
packed like any other; repeated rows are packed once each; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import materialized, small_batches

CAPACITY = 4096
END_ID = 2
CACHE = 300_000
NUMBERING_ROWS = 1 << 16

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")

# blanks by Python's str.split() that the tokenizer's \s may see otherwise
_ODD_BLANK = re.compile("[\x1c-\x1f\x85᠎​﻿]")
# marks that the tokenizer parts from letters before them
_MARKS = ".,;:!?%&$#*"


class Tokens:
    """Ids of texts as little-endian bytes. The tokenizer splits at white space
    first, so every stretch between blanks is looked up by itself. Stretches
    seen before come from two bounded generations: when the newer one is full
    it becomes the older one, and what is still in use moves on. The tokenizer
    lower-cases and parts letters from what follows them, so a stretch of
    letters with marks behind it is the two looked up one after the other."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)      # tokens that end a word
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many in one text. Each has at least one
        token that ends a word; where a text has as many of these as words,
        they part it, and otherwise its words are encoded singly."""
        out = []
        chunks = [words[k:k + 256] for k in range(0, len(words), 256)]
        texts = [" ".join(c) for c in chunks]
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(c) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [raw[x:y] for x, y in zip(at, at[1:])]
            else:
                out += self._encode(c)
        return out

    def _unseen(self, stretches: Iterable[str]) -> list[str]:
        """Those in neither generation; those in the older one move on."""
        unseen = []
        for w in stretches:
            if w not in self.cache:
                ids = self.older.get(w)
                if ids is None:
                    unseen.append(w)
                else:
                    self.cache[w] = ids
        return unseen

    def _learn(self, stretches: set[str]) -> None:
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {"": b""}
        halves = {}
        for w in self._unseen(stretches):
            letters = w.rstrip(_MARKS)
            if letters.isalpha():
                halves[w] = letters.encode().lower().decode(), w[len(letters):]
            else:
                halves[w] = w, ""
        new = self._unseen({x for pair in halves.values() for x in pair})
        for words, encode in (([w for w in new if w.isalpha()], self._encode_letters),
                              ([w for w in new if not w.isalpha()], self._encode)):
            for k in range(0, len(words), 4096):
                some = words[k:k + 4096]
                self.cache.update(zip(some, encode(some)))
        for w, (letters, marks) in halves.items():
            self.cache[w] = self.cache[letters] + self.cache[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = []
        for t in texts:
            t = (t or "").encode("utf-8", "replace").decode()
            parts.append(None if _ODD_BLANK.search(t) else t.split())
        whole = iter(self._encode([t for t, p in zip(texts, parts) if p is None]))
        need: set[str] = set()
        for p in parts:
            need.update(p or ())
        self._learn(need)
        get = self.cache.__getitem__
        return [next(whole) if p is None else b"".join(map(get, p)) for p in parts]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: full ones from its start, then the remainder.
    ``tokenizer`` is the vocabulary file's path, there on every executor."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(tokenizer)
        for b in batches:
            out = []
            for doc, ids in zip(b[key], tokens.encode(list(b[text]))):
                ids += end
                n = len(ids) // 4
                out += [(doc, s, min(capacity, n - s), zlib.crc32(ids[4 * s:4 * (s + capacity)]), n)
                        for s in range(0, n, capacity)]
            got = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    return docs.select(F.col(key).cast("long").alias(key), text).mapInPandas(cut, PIECE)


# ---- the plan ------------------------------------------------------------

def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of the lengths that fill one window closest to ``capacity``, the
    largest remaining length among them. Bit s of a set says that sum s can be
    reached; the sets after each length are kept and walked back."""
    order = sorted((x for x, n in counts.items() if n), reverse=True)
    first = order[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, kept = 1, []
    for x in order:
        if x > room:
            continue
        have = min(counts[x] - (x == first), room // x)
        kept.append((x, have, reach))
        step = 1
        while have > 0:
            take = min(step, have)
            reach |= (reach << (x * take)) & mask
            have -= take
            step *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {first: 1}
    for x, have, before in reversed(kept):
        n = 0
        while not before >> at & 1:
            at -= x
            n += 1
        if n:
            used[x] = used.get(x, 0) + n
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts of a window, number of such windows) until nothing remains."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        used = fill(left, capacity)
        times = min(left[x] // n for x, n in used.items())
        out.append((used, times))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def ranges(plans: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, pieces a window, first sequence,
    offset in it): numbers from the first on go to that plan's windows."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    base = 0
    for used, times in plans:
        offset = 0
        for x in sorted(used, reverse=True):
            out.setdefault(x, []).append((taken.get(x, 0), used[x], base, offset))
            taken[x] = taken.get(x, 0) + used[x] * times
            offset += x * used[x]
        base += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def place(table: dict[int, np.ndarray], length: np.ndarray,
          number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, from their numbers within their lengths."""
    seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for x in np.unique(length):
        m = length == x
        rows = table[int(x)]
        r = rows[np.searchsorted(rows[:, 0], number[m], side="right") - 1]
        k = number[m] - r[:, 0]
        seq[m] = r[:, 2] + k // r[:, 1]
        off[m] = r[:, 3] + (k % r[:, 1]) * x
    return seq, off


def numbered(df: DataFrame, group: str, out: str, tie: list[str], rows: int) -> DataFrame:
    """Gapless numbers from 0 within ``group``, without sorting a group in one
    task: rows are dealt to hash buckets of about NUMBERING_ROWS rows, buckets
    are counted, and each bucket starts where the ones before it end."""
    buckets = 32 + rows // NUMBERING_ROWS
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(group, "_b", (F.sum("_n").over(
        Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*tie)) - 1
    return (dealt.withColumn("_i", inside).join(before, [group, "_b"])
            .withColumn(out, (F.col("_before") + F.col("_i")).cast("long"))
            .drop("_b", "_i", "_before"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset. Only the table of lengths (at most
    ``capacity`` rows) and the plan made from it pass the driver."""
    cut = materialized(pieces(docs, tokenizer, capacity, end_id, key, text))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    table = ranges(plan(counts, capacity))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["sequence_id"], b["offset"] = place(table, b.length.to_numpy(), b.number.to_numpy())
            b["doc_id"] = b["doc_id"].astype("Int64")
            yield b.drop(columns="number")

    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    return (numbered(cut, "length", "number", order, sum(counts.values()))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "number")
            .mapInPandas(assign, PIECE + ", sequence_id long, offset long"))

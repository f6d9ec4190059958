"""Cross-tokenizer alignment: groups of tokens that two tokenizers cut alike.

A text's token ends under tokenizer A and B are cumulated in bytes; per
tokenizer a dictionary leads from end to token index, the key sets are
intersected, and the sorted common ends cut both id lists into groups. All
A-B pairs of a group are links.

Where a blank follows a visible character both tokenizers cut, so that place
is always a common end. Texts are therefore cut there into segments, a segment
(usually a word with its blank) is encoded and aligned by the dictionaries,
and the result is kept for its next occurrence in bounded caches.

How many documents hold a pair of ids linked is counted over the corpus:
documents are taken in blocks, a block stores each of its distinct pairs once
with the number of its documents that hold it, Spark sums those over the
blocks, and the totals return to the blocks that asked for them. The highest
total of an A id is a table bounded by the vocabulary of A.

Defined results: texts that are null or empty, and texts whose joined bytes
differ from blank + text under a tokenizer (those with U+2581, which B writes
for a blank), have no tokens: zeros and an empty ``groups_sha256``. Strings of
special tokens are ordinary text. Repeated rows and repeated ids are documents
of their own; a null id is kept; an empty table gives no rows; other columns
are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import materialized

BLOCK_LINKS = 1 << 22       # links after which a block of documents is closed
CHUNK_CHARS = 1 << 17
CACHED, CACHED_CHARS = 1 << 16, 48
BIG = 4096                  # links of a group that are listed one by one
# a blank after a visible character: no token of A or B reaches over it. White
# space at the end stays with the word before it, since B gives no token to an
# empty text after its blank
CUT = re.compile(r"(?<=\S)(?= )(?!\s+\Z)")
IRREGULAR = re.compile(r"\s |\s\Z")
# fixed value: how byte-level vocabularies of this kind cut a text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
B_IDS = 1 << 32             # a pair of ids as one number: a * B_IDS + b


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: the
    visible ones of Latin-1 for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: a byte-level vocabulary file. Where its merges are in the
    order of their ids, as the file says, they serve as ranks of the quicker
    of two encoders that give the same ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        self.bytes = [b""] * (max(tok.get_vocab().values()) + 1)
        for t, i in tok.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if all(model["vocab"].get(t) == 256 + k for k, t in enumerate(merged)):
            import tiktoken
            ranks = {self.bytes[i]: i for i in range(256 + len(merged))}
            self.encode = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks,
                                            special_tokens={}).encode_ordinary
        else:
            self.encode = lambda text: tok.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B: a model of pieces that puts a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece
        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.tok.is_byte(i) else p.replace("▁", " ").encode()
                      for i in range(self.tok.get_piece_size()) for p in [self.tok.id_to_piece(i)]]

    def encode(self, text: str) -> list[int]:
        return self.tok.encode(text[1:])


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common ends, and the numbers of A and of B tokens up to each."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    return tuple(np.array(x, np.int64) for x in (common, [at_a[e] for e in common], [at_b[e] for e in common]))


def before(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def links_of(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """(pairs, times, rows): the linked pairs of all groups in order, how often
    each is linked, and how many rows a group has. All pairs of a small group
    are listed; one with over BIG links is expanded by its distinct ids, so a
    long stretch without common ends costs their product."""
    rows, start_a, start_b = na * nb, before(na), before(nb)
    large = {}
    for g in np.flatnonzero(rows > BIG).tolist():
        ids_a, n = np.unique(a[start_a[g]:start_a[g] + na[g]], return_counts=True)
        ids_b, m = np.unique(b[start_b[g]:start_b[g] + nb[g]], return_counts=True)
        large[g] = (ids_a[:, None] * B_IDS + ids_b).ravel(), (n[:, None] * m).ravel()
        rows[g] = len(large[g][0])
    group = np.repeat(np.arange(len(rows)), rows)
    at = np.arange(len(group)) - before(rows)[group]
    width = nb[group]
    pairs = a[np.minimum(start_a[group] + at // width, len(a) - 1)] * B_IDS + b[start_b[group] + at % width]
    times = np.ones(len(pairs), np.int64)
    for g, (p, t) in large.items():
        lo = int(rows[:g].sum())
        pairs[lo:lo + len(p)], times[lo:lo + len(p)] = p, t
    return pairs, times, rows


class Aligner:
    """Aligns texts; segments seen before come from two generations of cache.
    A segment is (counts, written, pairs, times): the bytes of its numbers of A
    tokens, B tokens, groups and links, of its groups in decimals, of its
    linked pairs and how often each is linked; None where the tokenizers do not
    give its bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.tok = ByteLevel(path_a), Pieces(path_b)
        self.sizes = [np.array([len(x) for x in t.bytes]) for t in self.tok]
        # decimals of the ids within a group and at its end
        self.decimals = [np.array([[f"{i}{end}" for i in range(len(t.bytes))] for end in (",", last)], object)
                         for t, last in zip(self.tok, "|;")]
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def segments(self, text: str) -> list[str]:
        text = " " + text
        if IRREGULAR.search(text):
            return CUT.split(text)
        return [" " + w for w in text[1:].split(" ")]

    def cut(self, texts: list[str]) -> list[tuple] | None:
        """Segments that follow each other in one text, None where that does
        not give their bytes."""
        joined = "".join(texts)
        whole = joined.encode("utf-8", "surrogatepass")
        ids = [t.encode(joined) for t in self.tok]
        if any(b"".join([t.bytes[i] for i in x]) != whole for t, x in zip(self.tok, ids)):
            return None
        a, b = (np.array(x, np.int64) for x in ids)
        common, cut_a, cut_b = common_cuts(*(np.cumsum(s[x]) for s, x in zip(self.sizes, (a, b))))
        ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts])
        last = np.searchsorted(common, ends)
        if last[-1] >= len(common) or not np.array_equal(common[last], ends):
            return None
        na, nb = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        pairs, times, rows = links_of(a, b, na, nb)
        groups = np.arange(len(common))
        in_a, in_b = np.repeat(groups, na), np.repeat(groups, nb)
        end_a, end_b = np.zeros(len(a), int), np.zeros(len(b), int)
        end_a[cut_a - 1] = end_b[cut_b - 1] = 1
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + before(nb)[in_a]] = self.decimals[0][end_a, a]
        shown[np.arange(len(b)) + cut_a[in_b]] = self.decimals[1][end_b, b]
        shown = shown.tolist()
        reach = np.concatenate([[0], np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))])
        chars = reach[cut_a[last] + cut_b[last]].tolist()
        upto = np.cumsum(rows)[last].tolist()
        links = np.cumsum(na * nb)
        counts = np.diff(np.stack([cut_a[last], cut_b[last], last + 1, links[last]], axis=1), axis=0,
                         prepend=np.zeros((1, 4), np.int64)).tobytes()
        written, pairs = "".join(shown).encode(), pairs.tobytes()
        times = None if (times == 1).all() else times.tobytes()
        out, x, y = [], 0, 0
        for k, (p, q) in enumerate(zip(chars, upto)):
            out.append((counts[32 * k:32 * k + 32], written[x:p], pairs[8 * y:8 * q], times and times[8 * y:8 * q]))
            x, y = p, q
        return out

    def encoded(self, texts: list[str]) -> list[tuple | None]:
        """Segments that were not seen before. They may follow each other in
        one text, as each begins with a blank and ends visibly; one that ends
        in white space is cut by itself."""
        rest = [t for t in texts if not t[-1].isspace()]
        found = self.cut(rest) if rest else []
        out = dict(zip(rest, [(self.cut([t]) or [None])[0] for t in rest] if found is None else found))
        return [out[t] if t in out else (self.cut([t]) or [None])[0] for t in texts]

    def aligned(self, keys: list[str]) -> list[tuple | None]:
        """The segments, in order."""
        young, old, new = self.young, self.old, {}
        for k in keys:
            if k not in young and k not in new:
                new[k] = None
        if new:
            unseen = [k for k in new if k not in old]
            new.update((k, old[k]) for k in new if k in old)
            new.update(zip(unseen, self.encoded(unseen) if unseen else ()))
            found = [new[k] if k in new else young[k] for k in keys]
            young.update((k, s) for k, s in new.items() if len(k) <= CACHED_CHARS)
            if len(young) > CACHED:
                self.old, self.young = young, {}
            return found
        return [young[k] for k in keys]


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted numbers and their times, as differences and compressed."""
    both = np.concatenate([np.diff(pairs, prepend=0), times]).astype(np.uint32)
    if int(times.max(initial=0)) >> 32:
        raise ValueError("a pair is linked more than 2**32 times in one document")
    return zstandard.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(raw.T).view(np.uint32).ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


DOCUMENT = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                      ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                      ("held", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
DOCUMENT_DDL = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                "held binary, pairs array<long>, docs array<long>")


class Block:
    """Documents of one block and the distinct pairs of their links."""

    def __init__(self, name: int):
        self.name, self.rows, self.pairs, self.times, self.size = name, [], [], [], 0

    def add(self, doc_id: int | None, found: list[tuple | None]) -> None:
        if not found or None in found:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            self.pairs.append(np.zeros(0, np.int64))
            self.times.append(np.zeros(0, np.int64))
            return
        counts, written, links, times = zip(*found)
        sums = np.frombuffer(b"".join(counts), np.int64).reshape(-1, 4).sum(axis=0).tolist()
        self.rows.append((doc_id, *sums, hashlib.sha256(b"".join(written)[:-1]).hexdigest()))
        if any(times):
            times = np.concatenate([np.frombuffer(t, np.int64) if t else np.ones(len(p) // 8, np.int64)
                                    for p, t in zip(links, times)])
        else:
            times = None
        links = np.frombuffer(b"".join(links), np.int64)
        if times is None:
            links = np.sort(links)
        else:
            order = np.argsort(links)
            links, times = links[order], times[order]
        first = np.flatnonzero(np.diff(links, prepend=-1))
        self.pairs.append(links[first])
        self.times.append(np.diff(first, append=len(links)) if times is None else np.add.reduceat(times, first))
        self.size += len(first)

    def tables(self) -> Iterator[pa.RecordBatch]:
        known, at, docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(p) for p in self.pairs])
        for lo in range(0, len(self.rows), 1024):
            rows = self.rows[lo:lo + 1024]
            held = [pack(at[ends[lo + i] - len(self.pairs[lo + i]):ends[lo + i]], self.times[lo + i])
                    for i in range(len(rows))]
            columns = [[self.name] * len(rows), *map(list, zip(*rows)), held]
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, none, none], DOCUMENT)],
                                             schema=DOCUMENT)
        if len(known):
            listed = [[self.name], *[[None]] * 7, [known], [docs.astype(np.int64)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(listed, DOCUMENT)], schema=DOCUMENT)


def blocks_of(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(path_a, path_b), None
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "name")])
            for part in chunks(rows):
                cut = [aligner.segments(text) if text else [] for _, text, _ in part]
                found = aligner.aligned([k for keys in cut for k in keys])
                at = 0
                for (doc_id, _, name), keys in zip(part, cut):
                    # a block bears the number of its first row
                    block = block or Block(name)
                    block.add(doc_id, found[at:at + len(keys)])
                    at += len(keys)
                    if block.size >= BLOCK_LINKS:
                        yield from block.tables()
                        block = None
        if block:
            yield from block.tables()
    return run


def chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose texts are encoded together."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[1] or "")
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def valued(documents: pa.Table, values: pa.Table) -> pa.Table:
    """Digest of each document of a block from the totals of its pairs."""
    order = np.argsort(values["at"].to_numpy())
    total = values["total"].to_numpy()[order].astype(np.int64)
    top = values["top"].to_numpy()[order].astype(np.int64)
    best, sums = [], []
    for data in documents["held"].to_pylist():
        at, times = unpack(data)
        best.append(int((times * top[at]).sum()))
        sums.append(int((times * total[at]).sum()))
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return (kept.append_column("n_best", pa.array(best, pa.int64()))
            .append_column("count_sum", pa.array(sums, pa.int64())))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum),
    a row for each document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("name"))
    written = materialized(rows.mapInArrow(blocks_of(path_a, path_b), DOCUMENT_DDL))
    documents = written.where("pairs IS NULL").select(
        "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held")
    asked = (written.where("pairs IS NOT NULL")
             .select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p"))
             .select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs")))
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("total"))
    totals = materialized(counts)
    # a row for each id of A at most
    highest = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("total").alias("highest"))
    totals = (totals.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(highest), "a")
              .select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("top")))
    # joined by shuffles at every size: the pairs grow with the corpus
    values = (asked.select("block", "at", "pair").join(totals.hint("merge"), "pair")
              .select(F.col("block").alias("v_block"), "at", "total", "top"))
    return (documents.groupBy("block").cogroup(values.groupBy("v_block"))
            .applyInArrow(valued, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                  "groups_sha256 string, n_best long, count_sum long"))

"""Benchmark decontamination: template canonicalisation.

A text becomes a template: numbers, names and units are replaced with typed
placeholders (<num>, <name>, <unit>), other words are in lower case without
punctuation. Adjacent names, or numbers, are one ('Mary Ann', '1 000').
Windows of WINDOW template tokens are hashed, and a document's
windows are joined with the windows of the benchmark items. A joined run of
windows counts only if its slots are consistent: along the run, each filler of
the item always faces the same filler of the document. So an item is found
when its wording is copied, and also when its numbers, names or units were
exchanged for others throughout.

A run may go on at a neighbouring shift (at most DRIFT tokens away, in the order
of item and document): a word was inserted, dropped or exchanged there. The
windows that one such word breaks count as matched if the run goes on right
after them.

A document is contaminated by an item if a run covers at least COVERAGE of the
item's windows, or if it holds RUN tokens of the item in a row with the same
fillers, whatever their share of the item (matched_windows is then what the
best run covers). An item with fewer tokens than WINDOW is one
window, its whole template. A window with fewer than WORDING words besides its
slots has no wording to tell it by and matches only with equal fillers, so the
item '42' is found where 42 stands, not where any number does.

The benchmark's window hashes are compressed to a table of 2**FILTER_BITS bits
that travels in a broadcast of fixed size; only document windows that pass it
are joined, exactly, with the benchmark.

Defined results: null or empty texts and items, and null ids, match nothing;
repeated items or documents match once per id; an empty benchmark leaves all
documents clean; columns of the documents pass through ``clean`` unchanged.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import (LIGHT_ROWS, encoded, materialized, mix, segment_hashes, signed, small_batches,
                                  spans)
from lexiscope.llm.features import LETTERS

WINDOW = 8
WORDING = 2                   # words, other than slots, that a window needs to match by its template
COVERAGE = 0.5
RUN = 13
DRIFT = 8
FILTER_BITS = 24

# fixed values: measuring units that a template leaves open
UNITS = frozenset("""mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram
kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds
minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros
percent degree degrees volt volts watt watts joule joules newton newtons""".split())

_U = np.uint64
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?:\n\r", np.uint8))
_GAP = np.isin(np.arange(256), np.frombuffer(b" \t-\xc2\xa0", np.uint8))   # within a name or number
_POINT = np.isin(np.arange(256), np.frombuffer(b".,", np.uint8))
_NUM, _NAME, _UNIT = (_U(x) for x in (0x1000000000000001, 0x2000000000000003, 0x3000000000000005))
_FACTORS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | _U(1)


def _word(text: str) -> np.ndarray:
    data = np.frombuffer(encoded(text), np.uint8)
    return segment_hashes(data, np.array([0]), np.array([len(data)]))


_UNIT_HASHES = np.sort(np.concatenate([_word(u) for u in sorted(UNITS)]))


def lowered(text: str) -> tuple[bytes, bytes]:
    """UTF-8 of the text and of its lower case, byte for byte in step; a letter
    whose lower case has another length stays as it is."""
    raw, low = encoded(text), encoded(text.lower())
    if len(raw) != len(low):
        low = b"".join(x if len(x) == len(y) else y
                       for x, y in ((encoded(c.lower()), encoded(c)) for c in text))
    return raw, low


@dataclasses.dataclass
class Template:
    """Token ids in order (placeholders for slots), which tokens are slots, and
    where the tokens lie in the lower-case bytes."""
    ids: np.ndarray
    slot: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    low: bytes

    def windows(self, width: int) -> np.ndarray:
        """Hash of the window of that width at each position."""
        n = len(self.ids) - width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = np.full(n, width, np.uint64)
            for k in range(width):
                h += self.ids[k:k + n] * _FACTORS[k]
            words = np.concatenate([[0], np.cumsum(~self.slot)])
            few = np.flatnonzero(words[width:] - words[:-width] < WORDING)
            if len(few):
                as_written = np.where(self.slot, segment_hashes(np.frombuffer(self.low, np.uint8), self.starts, self.ends),
                                      self.ids)
                h[few] = width
                for k in range(width):
                    h[few] += as_written[few + k] * _FACTORS[k]
        return mix(h)

    def fillers(self, at: int, width: int) -> str:
        """What fills the slots of a window, tab between tokens."""
        return "\t".join(self.low[self.starts[k]:self.ends[k]].decode("utf-8", "replace") if self.slot[k] else ""
                         for k in range(at, at + width))


def template(text: str | None) -> Template:
    """Words are runs of letters and digits. One that begins with a digit is a
    number (with decimal point or thousands comma one number), a unit's word
    after a number is a unit, and a word with a capital at its head alone is a
    name unless a sentence begins there (and it is no name elsewhere in the
    text) or the word before it is in capitals."""
    raw, low = lowered(text or "")
    upper = np.frombuffer(raw, np.uint8)
    lower = np.frombuffer(low, np.uint8)
    plain = np.frombuffer(low.translate(LETTERS), np.uint8)
    starts, ends = spans(plain)
    if not len(starts):
        return Template(np.zeros(0, np.uint64), np.zeros(0, bool), starts, ends, low)
    ids = segment_hashes(plain, starts, ends)
    number = (lower[starts] >= 48) & (lower[starts] <= 57)
    if number.any():                     # 3.5 and 1,000 are one number
        joins = np.zeros(len(starts), bool)
        joins[1:] = (number[1:] & number[:-1] & (starts[1:] == ends[:-1] + 1)
                     & _POINT[upper[np.minimum(ends[:-1], len(upper) - 1)]])
        ends = ends[np.concatenate([~joins[1:], [True]])]
        starts, ids, number = starts[~joins], ids[~joins], number[~joins]
    changed = np.concatenate([[0], np.cumsum(upper != lower)])
    capitals = changed[ends] - changed[starts]
    head = changed[np.minimum(starts + 2, ends)] - changed[starts]
    stops = np.concatenate([[0], np.cumsum(_ENDS[upper])])
    inside = np.zeros(len(starts), bool)
    inside[1:] = (stops[starts[1:]] == stops[ends[:-1]]) & (capitals[:-1] < 2)
    titled = ~number & (capitals == 1) & (head == 1) & (ends - starts > 2)
    name = titled & inside
    if name.any():                       # a name heads a sentence if it is one elsewhere
        name |= titled & np.isin(ids, ids[name])
    unit = np.zeros(len(starts), bool)
    if number.any():
        place = np.minimum(np.searchsorted(_UNIT_HASHES, ids), len(_UNIT_HASHES) - 1)
        unit[1:] = (_UNIT_HASHES[place] == ids)[1:] & number[:-1]
    ids = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, ids)))
    slot = number | unit | name
    if (name | number).any():
        other = np.concatenate([[0], np.cumsum(~_GAP[upper])])
        joins = np.zeros(len(starts), bool)
        joins[1:] = ((name[1:] & name[:-1] | number[1:] & number[:-1])
                     & (other[starts[1:]] == other[ends[:-1]]))
        ends = ends[np.concatenate([~joins[1:], [True]])]
        starts, ids, slot = starts[~joins], ids[~joins], slot[~joins]
    return Template(ids, slot, starts, ends, low)


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """(id, windows, width, at, hash, slots): the windows of every item."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b.id, b.t):
                x = template(t)
                width = min(WINDOW, len(x.ids))
                h = signed(x.windows(width)) if width else np.zeros(0, np.int64)
                out += [(i, len(h), width, k, v, x.fillers(k, width)) for k, v in enumerate(h.tolist())]
            yield pd.DataFrame(out, columns=["id", "windows", "width", "at", "hash", "slots"])

    small_batches(items.sparkSession)
    return (items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
            .where("id is not null and t is not null").distinct()
            .mapInPandas(run, "id long, windows int, width int, at int, hash long, slots string"))


def doc_windows(docs: DataFrame, key: str, text: str, widths: list[int], mask: np.ndarray) -> DataFrame:
    """(doc_id, at, hash, doc_slots): the documents' windows whose bit in the
    mask is set, a small part of all."""
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b.id, b.t):
                x = template(t)
                for width in widths:
                    h = x.windows(width)
                    bit = (h >> _U(64 - FILTER_BITS)).astype(np.int64)
                    at = np.flatnonzero(shared.value[bit >> 3] >> (bit & 7) & 1)
                    out += [(i, k, v, x.fillers(k, width))
                            for k, v in zip(at.tolist(), signed(h)[at].tolist())]
            yield pd.DataFrame(out, columns=["doc_id", "at", "hash", "doc_slots"])

    small_batches(docs.sparkSession)
    return (docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
            .where("id is not null and t is not null")
            .mapInPandas(run, "doc_id long, at int, hash long, doc_slots string"))


def mask_of(items: DataFrame) -> np.ndarray:
    """One bit per value of a hash's top bits: at most 2**FILTER_BITS bits reach
    the driver, whatever the size of the benchmark."""
    block = 1 << 15
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    got = (items.select(F.floor(top / block).alias("k"), (top % block).alias("p"))
           .groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    mask = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in got:
        mask[r.k * block // 8:(r.k + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    return mask


def consistent(item_slots: str, doc_slots: str) -> dict[str, str] | None:
    """Which filler of the document stands for each of the item's; None if one
    of them would need two."""
    found: dict[str, str] = {}
    for x, y in zip(item_slots.split("\t"), doc_slots.split("\t")):
        if x and found.setdefault(x, y) != y:
            return None
    return found


def chain(hits: list, first: int, drift: int) -> tuple[int, dict[str, str]]:
    """Windows that a run covers which begins at shift ``first`` and moves at most
    ``drift`` tokens at a time, and its fillers. ``hits`` come by item_at."""
    fillers: dict[str, str] = {}
    covered, last, at, shift = 0, None, -1, first
    for where, group in hits:
        for h in sorted(group, key=lambda h: abs(h[0] - shift)):
            if abs(h[0] - shift) > (0 if last is None else drift):
                break
            got = consistent(h[1], h[2]) if where + h[0] > at else None
            if got is None or any(fillers.get(x, y) != y for x, y in got.items()):
                continue
            fillers.update(got)
            broken = last is not None and drift and 1 < where - last <= WINDOW + 1
            covered += where - last if broken else 1
            last, at, shift = where, where + h[0], h[0]
            break
    return covered, fillers


def verbatim(hits: list) -> int:
    """Most windows in a row at one shift whose fillers are the same."""
    best, runs = 0, {}
    for where, group in hits:
        runs = {h[0]: runs.get(h[0], (0, 0)) if runs.get(h[0], (0, where))[1] == where else (0, where)
                for h in group if h[1] == h[2]}
        runs = {k: (n + 1, where + 1) for k, (n, _) in runs.items()}
        best = max([best, *(n for n, _ in runs.values())])
    return best


def best_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every group of neighbouring shifts of a document and an item: the best
    run along one shift or over several, and the longest verbatim one."""
    for b in batches:
        out = []
        for doc, item, hits in zip(b.doc_id, b.item_id, b.hits):
            by: dict[int, list] = {}
            for h in hits:
                by.setdefault(h["item_at"], []).append((h["shift"], h["item_slots"], h["doc_slots"]))
            rows = sorted(by.items())
            runs = [chain(rows, s, d) for s in {h["shift"] for h in hits} for d in (0, DRIFT)]
            taken, slots, changed = max((n, len(f), sum(x != y for x, y in f.items())) for n, f in runs)
            out.append((doc, item, taken, verbatim(rows), slots, changed))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "matched", "verbatim", "slots", "changed"])


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
            item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, slots, changed_slots):
    the best alignment of every contaminated document with each item."""
    items = materialized(item_windows(benchmark, item, item_text))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # 1 to WINDOW
    hits = materialized(doc_windows(docs, key, text, widths, mask_of(items))).distinct()
    small_batches(docs.sparkSession, LIGHT_ROWS)
    joined = hits.join(items.select(F.col("id").alias("item_id"), "windows", F.col("at").alias("item_at"),
                                    "hash", F.col("slots").alias("item_slots")), "hash")
    # groups of shifts twice as wide as the item, twice, the second time moved by
    # half: a run whose shifts differ by less than the item's length is whole in one
    shift, half = F.col("at") - F.col("item_at"), F.greatest(F.col("windows"), F.lit(DRIFT))
    groups = F.array(F.floor(shift / (2 * half)) * 2, F.floor((shift + half) / (2 * half)) * 2 + 1)
    long_run = RUN - WINDOW + 1
    # a hit covers at most itself and the WINDOW windows that a word broke before it
    runs = (joined.withColumn("shift", shift).withColumn("near", F.explode(groups))
            .groupBy("doc_id", "item_id", "near")
            .agg(F.max("windows").alias("item_windows"),
                 F.sort_array(F.collect_list(F.struct("item_at", "shift", "item_slots", "doc_slots"))).alias("hits"))
            .where((F.size("hits") * (WINDOW + 1) >= F.lit(coverage) * F.col("item_windows"))
                   | (F.size("hits") >= long_run)))
    sizes = items.select(F.col("id").alias("item_id"), F.col("windows").alias("item_windows")).distinct()
    best = (runs.select("doc_id", "item_id", "hits")
            .mapInPandas(best_run, "doc_id long, item_id long, matched int, verbatim int, slots int, changed int")
            .join(sizes, "item_id")
            .where((F.col("matched") >= F.lit(coverage) * F.col("item_windows")) | (F.col("verbatim") >= long_run))
            .groupBy("doc_id", "item_id").agg(
                F.max(F.struct("matched", "item_windows", "slots", "changed")).alias("m")))
    return best.select("doc_id", "item_id", F.col("m.matched").cast("long").alias("matched_windows"),
                       F.col("m.item_windows").cast("long").alias("item_windows"),
                       F.col("m.slots").cast("long").alias("slots"),
                       F.col("m.changed").cast("long").alias("changed_slots"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that no item contaminates, unchanged."""
    found = materialized(matches(docs, benchmark, key, text).select(F.col("doc_id").alias(key)).distinct())
    return docs.join(found, key, "left_anti")

"""Hashed features of a text for the linear classifiers."""

from __future__ import annotations

import numpy as np

from lexiscope.llm.common import distinct, encoded, segment_hashes, spans

_U = np.uint64

# ASCII letters and digits keep their place, other ASCII becomes a blank;
# bytes of other characters count as letters.
LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BLANKS = bytes(32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))
# classes of bytes for word shapes: lower case, upper case, digit, else itself
_SHAPE = np.array([ord("a") if c >= 128 or chr(c).islower() else ord("A") if chr(c).isupper()
                   else ord("0") if chr(c).isdigit() else c for c in range(256)], np.uint8)


_FACTORS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def _index(*parts: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Feature index of a sequence of token hashes (the parts, already mixed)."""
    with np.errstate(over="ignore"):
        h = parts[0] * _FACTORS[0] + _U(salt * 0x27D4EB2F165667C5 % (1 << 64))
        for p, f in zip(parts[1:], _FACTORS[1:]):
            h += p * f
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        return (h >> _U(64 - bits)).astype(np.int32)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the text's lower-case words, punctuation removed."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(encoded(text.lower()).translate(LETTERS), np.uint8)
    return segment_hashes(data, *spans(data))


def skipgram_features(text: str | None, bits: int, ngrams: int = 2, skip: int = 2) -> np.ndarray:
    """Indices of word n-grams (1..ngrams) and of word pairs with 1..skip words
    between them; one entry per occurrence."""
    h = word_hashes(text)
    parts = [_index(h, salt=1, bits=bits)]
    for n in range(2, ngrams + 1):
        if len(h) >= n:
            parts.append(_index(*(h[i:len(h) - n + 1 + i] for i in range(n)), salt=n, bits=bits))
    for gap in range(1, skip + 1):
        if len(h) > gap + 1:
            parts.append(_index(h[:-gap - 1], h[gap + 1:], salt=100 + gap, bits=bits))
    return np.concatenate(parts)


def ngram_indicators(text: str | None, bits: int) -> np.ndarray:
    """Distinct indices of n-grams (1 and 2) over three token streams of the
    text: words with their punctuation, word shapes (runs of upper case, lower
    case, digits and signs) in n-grams up to 3, and whether a word repeats
    the one before it in n-grams up to 3. A text without words has none."""
    if not text:
        return np.zeros(0, np.int32)
    raw = np.frombuffer(encoded(text).translate(_BLANKS), np.uint8)
    starts, ends = spans(raw)
    if len(starts) == 0:
        return np.zeros(0, np.int32)
    low = np.frombuffer(encoded(text.lower()).translate(_BLANKS), np.uint8)
    s2, e2 = (starts, ends) if len(low) == len(raw) else spans(low)
    words = segment_hashes(low, s2, e2)
    cls = _SHAPE[raw]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = segment_hashes(cls[keep], at[starts], at[ends])
    out = []
    for stream, top, salt in ((words, 2, 10), (shape, 3, 20)):
        for n in range(1, top + 1):
            if len(stream) >= n:
                out.append(_index(*(stream[i:len(stream) - n + 1 + i] for i in range(n)),
                                  salt=salt + n, bits=bits))
    again = np.zeros(len(words), np.int64)
    again[1:] = words[1:] == words[:-1]
    for n in range(1, 4):  # at most 2 + 4 + 8 patterns
        if len(again) >= n:
            code = sum(again[i:len(again) - n + 1 + i] << i for i in range(n))
            out.append(_index(np.flatnonzero(np.bincount(code)).astype(np.uint64) + _U(1),
                              salt=30 + n, bits=bits))
    return distinct(np.concatenate(out))

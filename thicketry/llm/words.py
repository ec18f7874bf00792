"""Hashes of all words of a batch of texts at once, from the bytes of its Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import bytes_of, mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers, kept from call to call."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(1 << max(19, int(n).bit_length()), base, np.uint64)
        known[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[int(base)] = known = np.multiply.accumulate(known)
    return known[:n]


def byte_table(word: np.ndarray, fold: bool = True) -> np.ndarray:
    """256 random 64-bit values, A-Z as a-z if folded, 0 where a byte belongs to no word."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        values[65:91] = values[97:123]
    values[~word] = 0
    return values


#: Bytes of words that end at white space (space, tab to carriage return), and of words of letters, digits and non-ASCII bytes.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
for _span in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_span[0] : _span[1]] = True
TABLES = {"spaced": byte_table(SPACED), "alnum": byte_table(ALNUM)}


#: Every byte's own value, for spans that hold white space and keep case.
RAW = byte_table(np.ones(256, bool), fold=False)


def word_spans(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first byte of each word and of the byte after its last one; words never cross texts."""
    begins = np.empty(len(data), bool)
    begins[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=begins[1:])
    firsts = ends[:-1][ends[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    stops = np.empty(len(data) + 1, bool)  # after a byte of a word: no more of it, or the text's end
    stops[0] = False
    stops[1:-1] = inside[:-1] & ~inside[1:]
    stops[-1] = inside[-1]
    lasts = ends[1:][ends[1:] > 0]
    stops[lasts] = inside[lasts - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops)


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes: the polynomial of the bytes' values, from running sums."""
    with np.errstate(over="ignore"):
        sums = np.empty(len(values) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * _powers(_BASE, len(values)), out=sums[1:])
        return mix64((sums[stop] - sums[start]) * _powers(_INVERSE, len(values))[start] + (stop - start).astype(np.uint64))


def word_hashes(texts: pa.Array, kind: str = "spaced") -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, n + 1 offsets of the texts in them). Case of A-Z doesn't count."""
    data, ends = bytes_of(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    values = TABLES[kind][data]
    start, stop = word_spans(data, ends, values != 0)
    return span_hashes(values, start, stop), np.searchsorted(start, ends)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of `size` words, offsets of the texts in them); texts of fewer words have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, size):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : n + k]
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    keep = np.zeros(n + 1, np.int32)
    full = counts > 0
    keep[offsets[:-1][full]] += 1
    keep[(offsets[:-1] + counts)[full]] -= 1
    return mix64(out[np.cumsum(keep[:-1]) > 0]), np.concatenate([[0], np.cumsum(counts)])

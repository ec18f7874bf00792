"""A bounded table from spans of text to their token ids, all in arrays: found for a whole batch at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import words


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    """x, with room for `size` elements at least."""
    if size <= len(x):
        return x
    return np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


def _equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of these sizes (none empty) hold the same bytes."""
    if not len(sizes):
        return np.zeros(0, bool)
    first = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum()))
    differ = a[np.repeat(a_at - first, sizes) + inside] != b[np.repeat(b_at - first, sizes) + inside]
    return ~np.logical_or.reduceat(differ, first)


class IdCache:
    """Open addressing over 64-bit hashes of spans; their bytes, which decide, and their ids lie in pools.

    At `capacity` spans the table is emptied. A batch that alone has more (one text is never parted) makes the table grow for as long as
    that takes, so that a quarter of the slots is always free. Spans of one hash and different bytes have entries of their own.
    """

    def __init__(self, capacity: int, dtype: np.dtype):
        self.capacity, self.dtype = capacity, dtype
        self.clear()

    def clear(self) -> None:
        self._slots(1 << min(16, int(self.capacity * 3 // 2).bit_length()))  # grows with what it holds: a worker keeps its table for other stages' tasks
        self.n = self.used = self.letters = 0
        self.at, self.text_at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.size, self.text_size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.pool, self.text = np.zeros(1 << 18, self.dtype), np.zeros(1 << 20, np.uint8)

    def _slots(self, n: int) -> None:
        self.mask = np.int64(n - 1)
        self.keys, self.entry = np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        self.filled = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry under each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int32)
        open_, place = np.arange(len(hashes)), hashes.astype(np.int64) & self.mask
        h = hashes
        while len(open_):
            own = self.entry[place]
            hit = (own >= 0) & (self.keys[place] == h)
            out[open_[hit]] = own[hit]
            more = ~hit & (own >= 0)
            open_, place, h = open_[more], (place[more] + 1) & self.mask, h[more]
        return out

    def _enter(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Distinct hashes that have no entry yet."""
        if 4 * (self.filled + len(hashes)) > 3 * len(self.keys):
            old = np.flatnonzero(self.entry >= 0)
            hashes, entries = np.concatenate([self.keys[old], hashes]), np.concatenate([self.entry[old], entries])
            self._slots(1 << int(len(hashes) * 2).bit_length())
        self.filled += len(hashes)
        h, place, entry = hashes, hashes.astype(np.int64) & self.mask, entries
        while len(h):
            free = self.entry[place] < 0
            self.keys[place[free]], self.entry[place[free]] = h[free], entry[free]
            lost = self.entry[place] != entry
            h, place, entry = h[lost], (place[lost] + 1) & self.mask, entry[lost]

    def entries(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The entry of each span of the bytes (none empty). `learn` gives new spans' ids, one after the other, and their counts."""
        hashes = words.span_hashes(words.RAW[data], start, stop)
        sizes = stop - start
        out = self._find(hashes)
        met = np.flatnonzero(out >= 0)
        same = _equal(data, start[met], self.text, self.text_at[out[met]], np.minimum(sizes[met], self.text_size[out[met]])) & (sizes[met] == self.text_size[out[met]])
        odd, fresh = met[~same], np.flatnonzero(out < 0)
        if not len(odd) and not len(fresh):
            return out
        distinct, first, back = np.unique(hashes[fresh], return_index=True, return_inverse=True)
        if self.n and self.n + len(distinct) + len(odd) > self.capacity:
            self.clear()
            return self.entries(data, start, stop, learn)
        lead = fresh[first]
        twin = (sizes[fresh] == sizes[lead[back]]) & _equal(data, start[fresh], data, start[lead[back]], np.minimum(sizes[fresh], sizes[lead[back]]))
        odd = np.concatenate([odd, fresh[~twin]])
        own = np.concatenate([lead, odd])
        raw = data.tobytes()
        ids, counts = learn([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[own].tolist(), stop[own].tolist())])
        numbers = np.arange(self.n, self.n + len(own), dtype=np.int32)
        out[fresh[twin]] = numbers[back[twin]]
        out[odd] = numbers[len(lead) :]
        self._enter(distinct, numbers[: len(lead)])
        self._keep(ids, counts, data, start[own], sizes[own])
        return out

    def _keep(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> None:
        n, k = self.n, self.n + len(counts)
        self.at, self.size, self.text_at, self.text_size = (_grown(x, k) for x in (self.at, self.size, self.text_at, self.text_size))
        self.at[n:k], self.size[n:k] = self.used + np.cumsum(counts) - counts, counts
        self.text_at[n:k], self.text_size[n:k] = self.letters + np.cumsum(sizes) - sizes, sizes
        letters = int(sizes.sum())
        self.pool, self.text = _grown(self.pool, self.used + len(ids)), _grown(self.text, self.letters + letters)
        self.pool[self.used : self.used + len(ids)] = ids
        self.text[self.letters : self.letters + letters] = data[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(letters)]
        self.n, self.used, self.letters = k, self.used + len(ids), self.letters + letters

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries one after the other, n + 1 offsets of the entries in them)."""
        sizes = self.size[entries].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if not ends[-1]:
            return np.zeros(0, self.dtype), ends
        return self.pool[np.repeat(self.at[entries] - ends[:-1], sizes) + np.arange(ends[-1])], ends

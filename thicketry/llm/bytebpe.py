"""Byte-level BPE by ranks, with a segment tree over byte positions.

A piece of text starts as its bytes. Leaf i of the tree holds the rank of the pair that starts at position i and
the position itself; inner nodes hold the minimum, so the root is the leftmost pair of the least rank. A merge
takes that pair, links the neighbours past the consumed position, and updates the three leaves it touches, each
along one path to the root. No step looks at the whole piece again.

Short pieces, all but a few, go through the same trees side by side: one array per level, a row a piece. Long
ones have a tree of their own. A bounded table keeps the ids of the spans of text met before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .idcache import IdCache

#: Pieces of at most this many bytes are merged side by side.
WIDE = 256
NONE = np.int64(1) << np.int64(60)
#: White space to the pattern but not to the split into spans.
_ODD_SPACE = regex.compile(r"[^\S \t\n\r\x0b\x0c]")

_LOADED: dict[tuple, "ByteEncoder"] = {}


def encoder(path: str, pattern: str, capacity: int = 2_000_000) -> "ByteEncoder":
    """The worker's encoder for a rank file: loaded once, its table kept between tasks."""
    key = (path, pattern, capacity)
    if key not in _LOADED:
        _LOADED[key] = ByteEncoder(path, pattern, capacity)
    return _LOADED[key]


class ByteEncoder:
    """Encodes and decodes by a file of `base64 rank` lines and a pattern whose matches are encoded separately."""

    def __init__(self, path: str, pattern: str, capacity: int = 2_000_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.size = max(self.tokens) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        slots = 1 << (4 * len(pairs)).bit_length()
        self.pair_mask = np.uint64(slots - 1)
        self.pair_key, self.pair_rank = np.full(slots, -1, np.int64), np.full(slots, NONE, np.int64)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        place = self._place(keys)
        while len(keys):
            free = self.pair_key[place] == -1
            self.pair_key[place[free]] = keys[free]
            won = free & (self.pair_key[place] == keys)
            self.pair_rank[place[won]] = values[won]
            keys, values, place = keys[~won], values[~won], (place[~won] + 1) & np.int64(self.pair_mask)
        self.cache = IdCache(capacity, np.dtype("<u4"))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) & self.pair_mask).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge."""
        keys = a * self.size + b
        out = np.full(len(keys), NONE, np.int64)
        open_, place = np.arange(len(keys)), self._place(keys)
        while len(open_):
            there = self.pair_key[place]
            hit = there == keys
            out[open_[hit]] = self.pair_rank[place[hit]]
            more = ~hit & (there != -1)
            open_, keys, place = open_[more], keys[more], (place[more] + 1) & np.int64(self.pair_mask)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece by one segment tree."""
        n, size, get = len(piece), self.size, self.pairs.get
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = get(ids[i] * size + ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low

        def value(i: int) -> int:
            j = after[i]
            rank = get(ids[i] * size + ids[j]) if j < n else None
            return none if rank is None else rank * width + i

        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            update(j, none)
            update(i, value(i))
            if before[i] >= 0:
                update(before[i], value(before[i]))
        return [x for x in ids if x >= 0]

    def merge_side_by_side(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces of at most `width` bytes, a power of two, one after the other; their counts)."""
        m = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(m), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full((m, width + 1), -1, np.int64)
        ids[row, col] = self.of_byte[flat]
        after = np.tile(np.arange(1, width + 2), (m, 1))
        before = np.tile(np.arange(-1, width), (m, 1))
        tree = np.full((m, 2 * width), NONE, np.int64)
        inner = col < lengths[row] - 1
        r, c = row[inner], col[inner]
        rank = self.pair_ranks(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(rank < NONE, rank * width + c, NONE)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2

        def update(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            k = width + at
            tree[rows, k] = values
            for _ in range(width.bit_length() - 1):
                k >>= 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        def values(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            j = after[rows, at]
            last = j >= lengths[rows]
            rank = self.pair_ranks(ids[rows, at], ids[rows, np.where(last, width, j)])  # column `width` is empty: no pair
            return np.where((rank < NONE) & ~last, rank * width + at, NONE)

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            top = tree[live, 1]
            rank, i = top // width, top % width
            j = after[live, i]
            ids[live, i], ids[live, j] = rank, -1
            nxt = after[live, j]
            after[live, i] = nxt
            linked = nxt < lengths[live]
            before[live[linked], nxt[linked]] = i[linked]
            update(live, j, NONE)
            update(live, i, values(live, i))
            prev = before[live, i]
            some = prev >= 0
            update(live[some], prev[some], values(live[some], prev[some]))
            live = live[tree[live, 1] < NONE]
        kept = ids[:, :width] >= 0
        return ids[:, :width][kept].astype(np.uint32), kept.sum(1)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if len(p) > WIDE:
                out[k] = np.array(self.merge_long(p), np.uint32)
            else:
                by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                ids, counts = self.merge_side_by_side([pieces[k] for k in part], width)
                for k, x in zip(part, np.split(ids, np.cumsum(counts)[:-1])):
                    out[k] = x
        return out

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array without nulls.

        A span is a word with the white space before it; the pattern never matches across the end of a word. A text with white space
        that only the pattern knows (no-break spaces and such) is matched as a whole.
        """
        data, ends = common.bytes_of(texts)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        start, stop = words.word_spans(data, ends, words.SPACED[data])
        stop = np.unique(np.concatenate([stop, ends[1:][ends[1:] > ends[:-1]]]))  # what follows the last word is a span as well
        owner = np.searchsorted(ends, stop, "left") - 1
        start = np.maximum(np.concatenate([[0], stop[:-1]]), ends[owner])
        entries = self.cache.entries(data, start, stop, self._learn)
        ids, places = self.cache.gather(entries)
        cuts = places[np.searchsorted(stop, ends, "right")].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        odd = np.flatnonzero(self.cache.size[entries] == 0)  # marks a span with such white space
        for k in set(owner[odd].tolist()):
            pieces = [p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(texts[k].as_py())]
            out[k] = np.concatenate([np.zeros(0, np.uint32), *self.merge(pieces)])
        return out

    def _learn(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the spans one after the other, their counts; 0 for a span that a text can't be split at)."""
        found = [[] if _ODD_SPACE.search(s) else self.pattern.findall(s) for s in spans]
        known: dict[str, int] = {}
        order = [[known.setdefault(p, len(known)) for p in f] for f in found]
        merged = self.merge([p.encode("utf-8", "surrogatepass") for p in known])
        sizes = np.array([len(x) for x in merged] or [0])
        pool, at = np.concatenate([np.zeros(0, np.uint32), *merged]), np.concatenate([[0], np.cumsum(sizes)])
        parts = np.fromiter((k for o in order for k in o), np.int64)
        per = sizes[parts] if len(parts) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(per)])
        ids = pool[np.repeat(at[parts] - ends[:-1], per) + np.arange(ends[-1])] if len(parts) else pool[:0]
        counts = np.diff(ends[np.concatenate([[0], np.cumsum([len(o) for o in order])])])
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit words), and, if asked for, the bytes that the ids decode to.

    Null counts as empty and has no ids. Rows with null or repeated ids are kept. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for part in common.chunks(batches):
            found = enc.encode_batch(part.column("text"))
            columns = [part.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if decoded:
                columns.append(pa.array([enc.decode(x) for x in found], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode(common.table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

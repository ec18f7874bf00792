"""Ids of the tokenizers library for whole texts, with each distinct word encoded once per worker.

The vocabulary file splits at white space before anything else looks at the text, so the ids of a text are the
ids of its space-separated chunks, one after the other. A bounded table keeps the ids of chunks seen
before; only new chunks reach the library. Chunks of plain Latin letters, digits and signs go to the file's own
BPE model in long joined strings (the library's per-call costs are most of its time); every other chunk goes
through the library's whole pipeline.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import regex

from . import words
from .common import bytes_of
from .idcache import IdCache

#: The split pattern that the word-level vocabulary file states; the shortcut holds for it alone.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Chunks that lower-casing and splitting treat alike in Python and in the library: printable Latin-1.
_PLAIN = regex.compile(r"[!-~¡-¬®-ÿ]+")
_PIECES = regex.compile(WORD_PATTERN)
_LOADED: dict[tuple[str, int], "WordEncoder"] = {}


def encoder(path: str, capacity: int = 2_000_000) -> "WordEncoder":
    """The worker's encoder for a file: loaded once, its cache kept between tasks."""
    if (path, capacity) not in _LOADED:
        _LOADED[path, capacity] = WordEncoder(path, capacity)
    return _LOADED[path, capacity]


class WordEncoder:
    """Encodes texts by a tokenizers file without special tokens; strings that look like special tokens are ordinary text."""

    def __init__(self, path: str, capacity: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.vocab_size = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        self.cache = IdCache(capacity, self.dtype)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cached = self._splits_at_space(spec)
        if self.cached:
            self.light = Tokenizer(self.whole.model)
            self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = spec["model"]["end_of_word_suffix"]
            self.closes = np.zeros(self.vocab_size, bool)
            for token, i in spec["model"]["vocab"].items():
                self.closes[i] = token.endswith(suffix)

    @staticmethod
    def _splits_at_space(spec: dict) -> bool:
        """Whether the file has the known shape in which words never depend on their neighbours."""
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [s["type"] for s in norm.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"] == {"Regex": WORD_PATTERN}
            and parts[0]["invert"]
            and not parts[1]["add_prefix_space"]
            and not parts[1]["use_regex"]
            and bool(spec["model"].get("end_of_word_suffix"))
        )

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """For each text of a string array (no nulls) its ids as little-endian words of self.dtype."""
        if not self.cached:
            found = self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.asarray(e.ids, self.dtype).tobytes() for e in found]
        data, ends = bytes_of(texts)
        if not len(data):
            return [b""] * len(texts)
        start, stop = words.word_spans(data, ends, words.SPACED[data])
        entries = self.cache.entries(data, start, stop, self._learn)
        ids, places = self.cache.gather(entries)
        cuts = places[np.searchsorted(start, ends)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks one after the other, their counts)."""
        plain = [_PLAIN.fullmatch(c) is not None for c in chunks]
        found = [_PIECES.findall(c.lower()) if p else [] for c, p in zip(chunks, plain)]
        pieces = [x for f in found for x in f]
        step = 256
        joined = [" ".join(pieces[i : i + step]) for i in range(0, len(pieces), step)]
        ids = np.concatenate([np.asarray(e.ids, self.dtype) for e in self.light.encode_batch_fast(joined, add_special_tokens=False)] or [np.zeros(0, self.dtype)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pieces):  # a piece without an end of its own: the library's whole pipeline decides
            plain, ids, ends, found = [False] * len(chunks), ids[:0], ends[:0], [[]] * len(chunks)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(f) for f in found])])]
        if all(plain):
            return ids, np.diff(ends)
        odd = iter(self.whole.encode_batch_fast([c for c, p in zip(chunks, plain) if not p], add_special_tokens=False))
        parts = [ids[a:b] if p else np.asarray(next(odd).ids, self.dtype) for p, a, b in zip(plain, ends.tolist(), ends[1:].tolist())]
        return np.concatenate(parts), np.array([len(x) for x in parts])

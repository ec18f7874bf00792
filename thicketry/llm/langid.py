"""Language identification with hyperdimensional profiles.

Every symbol (a letter, or the gap between words) has a fixed random vector of +1 and -1. A trigram's vector binds
(multiplies) its symbols' vectors, the first permuted twice, the second once, so order counts. A text's vector bundles (adds) the vectors of its trigrams, once for each occurrence; a language's prototype
bundles those of its training texts. A document goes to the prototype with the greatest cosine.

Symbols are the gap and all letters, by their code points in lower case; marks that combine with letters belong to words and are symbols
as well. A symbol's vector comes from a hash of its code point, made when it is met, so every script has its own. All arithmetic is on
counts of trigrams: a text's vector is one product of its counts with the vectors of the trigrams.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1024
SEED = 7
#: Bits of a code point in a trigram's key.
POINT = 21
#: Classes of lengths, the rows a class needs to have a least score of its own, and which part of what quantile that is.
SIZES = 32
ENOUGH = 50
QUANTILE = 0.01
PART = 0.5
#: Weights of trigrams that a task holds before it multiplies them with their vectors.
HELD = 1 << 19

_TABLE: np.ndarray | None = None


def symbols() -> np.ndarray:
    """Symbol of every code point: 0 for what belongs to no word, letters folded to lower case."""
    global _TABLE
    if _TABLE is None:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
            elif cp >= 0x300 and unicodedata.category(c)[0] == "M":
                table[cp] = cp
        _TABLE = table
    return _TABLE


class Letters:
    """The vectors of symbols: random signs, the same for a code point everywhere."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        if dimensions % 64:
            raise ValueError("dimensions go by 64")
        self.dimensions, self.seed = dimensions, seed
        self.order = np.random.default_rng(seed).permutation(dimensions)

    def of(self, points: np.ndarray) -> np.ndarray:
        """A row of +1 and -1 for each code point."""
        words = self.dimensions // 64
        with np.errstate(over="ignore"):
            at = (points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)) + (np.uint64(self.seed) << np.uint64(40))
            bits = common.mix64((at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> Letters:
    return Letters(dimensions, seed)


def trigram_vectors(grams: np.ndarray, letters: Letters) -> np.ndarray:
    """Bound vectors: the first symbol's permuted twice, the second's once, the third's not at all."""
    grams = grams.astype(np.int64)
    parts = np.stack([grams >> 2 * POINT, grams >> POINT & (1 << POINT) - 1, grams & (1 << POINT) - 1])
    points, place = np.unique(parts, return_inverse=True)
    place = place.reshape(parts.shape)
    base = letters.of(points)
    once = base[:, letters.order]
    return once[:, letters.order][place[0]] * once[place[1]] * base[place[2]]


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, trigram as a number in base len(points), points), for every trigram with a letter in its middle or at
    both sides of a gap.

    Every document is set between gaps; runs of gaps are one gap.
    """
    every = np.frombuffer("\x00".join(["", *texts.to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = symbols()[every]
    ends = np.flatnonzero(every == 0)
    if len(ends) != len(texts) + 1:  # texts hold NULs of their own
        lengths = np.array([len(t) for t in texts.to_pylist()], np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    doc = np.zeros(len(found), np.int32)
    keep[ends] = True
    doc[ends[1:-1]] = 1
    doc = np.cumsum(doc, dtype=np.int32)[keep]
    kept = found[keep]
    met = np.zeros(0x110000, bool)
    met[kept] = True
    met[0] = True
    points = np.flatnonzero(met)
    local = np.zeros(0x110000, np.int32)
    local[points] = np.arange(len(points))
    s = local[kept].astype(np.int32 if len(points) ** 3 < 1 << 31 else np.int64)
    grams = (s[:-2] * len(points) + s[1:-1]) * len(points) + s[2:]
    within = (doc[:-2] == doc[2:]) & ((s[1:-1] != 0) | ((s[:-2] != 0) & (s[2:] != 0)))
    within |= (doc[:-2] != doc[2:]) & (doc[:-2] == doc[1:-1]) & (s[1:-1] != 0)  # a last word's end
    return doc[:-2][within], grams[within], points


def _keys(grams: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Trigrams in base len(points) as keys of three code points."""
    n = len(points)
    points = points.astype(np.int64)
    return points[grams // (n * n)] << 2 * POINT | points[grams // n % n] << POINT | points[grams % n]


def trigram_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document number, trigram's key) of every trigram."""
    doc, grams, points = _grams(texts)
    return doc, _keys(grams, points)


def vectors(texts: pa.Array, letters: Letters, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Each text's vector, and the number of its trigrams."""
    n = len(texts)
    out, totals = np.zeros((n, letters.dimensions), np.float32), np.zeros(n, np.int64)
    doc, grams, points = _grams(texts)
    dense = len(points) ** 3 <= 1 << 22
    cuts = np.searchsorted(doc, np.arange(0, n + block, block))
    for first, a, b in zip(range(0, n, block), cuts, cuts[1:]):
        rows = min(block, n - first)
        if dense:
            seen = np.zeros(len(points) ** 3, bool)
            seen[grams[a:b]] = True
            used = np.flatnonzero(seen)
            place = np.zeros(len(seen), np.int32)
            place[used] = np.arange(len(used))
            place = place[grams[a:b]]
        else:
            used, place = np.unique(grams[a:b], return_inverse=True)
        totals[first : first + rows] = np.bincount(doc[a:b] - first, minlength=rows)
        for at in range(0, len(used), 4096):
            step = min(4096, len(used) - at)
            mine = slice(None) if step == len(used) else (place >= at) & (place < at + step)
            counts = np.bincount((doc[a:b][mine] - first) * step + (place[mine] - at), minlength=rows * step).reshape(rows, step).astype(np.float32)
            out[first : first + rows] += counts @ trigram_vectors(_keys(used[at : at + step], points), letters)
    return out, totals


def _weights(texts: pa.Array, langs: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each language its texts' trigrams, by key, and their weights: a text's trigrams weigh 1 together."""
    doc, grams, points = _grams(texts)
    totals = np.bincount(doc, minlength=len(texts))
    names = sorted(set(langs))
    place = {name: k for k, name in enumerate(names)}
    own = np.array([place[x] for x in langs], np.int64)[doc]
    for k, name in enumerate(names):
        mine = np.flatnonzero(own == k)
        used, place = np.unique(grams[mine], return_inverse=True)
        yield name, _keys(used, points), np.bincount(place, 1 / totals[doc[mine]], len(used))


def _bundled(held: list[tuple[str, np.ndarray, np.ndarray]], letters: Letters, sums: dict[str, np.ndarray], block: int = 1024) -> None:
    """Adds the trigrams' vectors, by their weights, to the sums of their languages: one product for many texts."""
    if not held:
        return
    names = sorted({lang for lang, _, _ in held})
    for name in names:
        sums.setdefault(name, np.zeros(letters.dimensions))
    used, place = np.unique(np.concatenate([keys for _, keys, _ in held]), return_inverse=True)
    row = np.repeat([names.index(lang) for lang, _, _ in held], [len(keys) for _, keys, _ in held])
    weights = np.concatenate([w for _, _, w in held])
    order = np.argsort(place, kind="stable")
    place, row, weights = place[order], row[order], weights[order]
    for at in range(0, len(used), block):
        step = min(block, len(used) - at)
        mine = slice(*np.searchsorted(place, [at, at + step]))
        some = np.bincount(row[mine] * step + place[mine] - at, weights[mine], len(names) * step).reshape(len(names), step)
        for name, x in zip(names, some @ trigram_vectors(used[at : at + step], letters).astype(np.float64)):
            sums[name] += x


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes of all languages in the rows; rows without a language or text are left out.

    Each task bundles its documents' vectors for each language, every document at the same weight, so that long texts don't
    decide alone, and sends the sums once; Spark adds them up. What comes to the driver is languages times dimensions.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        held: list[tuple[str, np.ndarray, np.ndarray]] = []
        n = 0
        for part in common.chunks(batches):
            for lang, keys, weights in _weights(part.column("text"), part.column("lang").to_pylist()):
                held.append((lang, keys, weights))
                n += len(keys)
            if n > HELD:
                _bundled(held, letters, sums)
                held, n = [], 0
        _bundled(held, letters, sums)
        for lang, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(x)], ["lang", "place", "part"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    # rounded, so that the order in which tasks end can't change a prediction
    found = rows.mapInArrow(bundle, "lang string, place int, part double").groupBy("lang", "place").agg(F.sum(F.round("part", 9).cast("decimal(28,9)")).cast("double").alias("total")).toArrow()
    lang, place, total = np.array(found["lang"].to_pylist(), object), found["place"].to_numpy(), found["total"].to_numpy()
    out = {}
    for name in sorted(set(lang)):
        mine = lang == name
        x = np.zeros(dimensions)
        x[place[mine]] = total[mine]
        out[name] = x / (np.linalg.norm(x) or 1)
    return out


def _best(texts: pa.Array, names: list[str], matrix: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's language, score and number of trigrams."""
    n = len(texts)
    lang, score, totals = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64)
    if names:
        x, totals = vectors(texts, letters)
        cosines = (x @ matrix.T) / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
        best = cosines.argmax(1)
        known = totals > 0
        lang[known] = np.array(names, object)[best[known]]
        score[known] = np.clip(cosines[np.arange(n), best][known], 0, 1)
    return lang, score, totals


def _size(totals: np.ndarray) -> np.ndarray:
    """Class of a number of trigrams: its binary digits."""
    return np.minimum(np.frexp(totals.astype(np.float64))[1], SIZES - 1)


def least_scores(docs: DataFrame, prototypes: dict[str, np.ndarray], quantile: float = QUANTILE, part: float = PART, seed: int = SEED, lang_col: str = "lang", text_col: str = "text") -> np.ndarray:
    """For each class of the number of trigrams the score that a text has to exceed, learned from all labelled rows.

    It is `part` of the low `quantile` of the cosines that texts of about that length have with their own language. Classes
    of fewer than ENOUGH rows use that of the next shorter one that has them (0 if there is none), as short texts score less.
    What comes to the driver is bounded by classes times thousandths.
    """
    out = np.zeros(SIZES)
    names = sorted(prototypes)
    if not names:
        return out
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32)
    place = {k: i for i, k in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(matrix.shape[1], seed)
        for rows in common.chunks(batches):
            x, totals = vectors(rows.column("text"), letters)
            own = np.array([place.get(k, -1) for k in rows.column("lang").to_pylist()])
            cosines = (x * matrix[own]).sum(1) / np.maximum(np.linalg.norm(x, axis=1), 1e-9)
            good = (own >= 0) & (totals > 0)
            yield pa.RecordBatch.from_arrays([pa.array(v[good].astype(np.int32)) for v in (_size(totals), np.floor(np.clip(cosines, 0, 1) * 1000))], ["size", "score"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    found = rows.mapInArrow(run, "size int, score int").groupBy("size", "score").count().toArrow()
    size, score, count = (found[c].to_numpy() for c in ("size", "score", "count"))
    for k in range(1, SIZES):
        out[k] = out[k - 1]
        mine = np.flatnonzero(size == k)
        mine = mine[np.argsort(score[mine])]
        sums = np.cumsum(count[mine])
        if len(sums) and sums[-1] >= ENOUGH:
            out[k] = part * score[mine][np.searchsorted(sums, quantile * sums[-1])] / 1000
    return out


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float | np.ndarray = 0.0, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """The documents with a language, at a score over `least` (one number, or those of least_scores); all columns as they were.

    Null and empty texts and those without a letter go. Where no language was learned none can be rejected: all
    documents stay. An empty table gives no rows.
    """
    names = sorted(prototypes)
    if not names:
        return docs
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32)
    least = np.broadcast_to(least, SIZES)
    held: list[np.ndarray] = []

    def keep(texts: pa.Array) -> np.ndarray:
        if not held:
            held.append(letter_vectors(matrix.shape[1], seed))
        lang, score, totals = _best(texts, names, matrix, held[0])
        return (lang != "und") & (score > least[_size(totals)])

    return common.kept_rows(docs, keep, text_col)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row a document. The prototypes (languages times dimensions) go with the tasks.

    score: the greatest cosine, 0 where it is negative. A text that is null, empty or without a letter is `und` with score 0, as is every
    text if no language was learned. Equal cosines go to the language first in the alphabet. Other columns are ignored.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(matrix.shape[1], seed) if names else None
        for part in common.chunks(batches):
            lang, score, _ = _best(part.column("text"), names, matrix, letters)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    prototypes = train(docs.where(~held_out()))
    return predict(docs, prototypes).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Substring deduplication: passages that repeat, exactly or nearly, from compact windows over min-hashes.

Tokens are shingles of SHINGLE words, and a run is MIN_WORDS words: WIDTH tokens. For each of FUNCTIONS hash functions the Cartesian tree of a
text's token hashes gives its compact windows (l, c, r): every run within l..r that holds c has c for its min-hash. So all runs
of a text are parted among its windows, and two runs share a function's min-hash only if their windows have one value.

1. Windows meet by (function, min-hash). Values of one document alone go.
2. Each document's windows are joined as intervals: a run's count is the number of functions whose window of a shared value covers it. An exact
   copy has all FUNCTIONS. Such runs meet by the hash of their words, so equality itself is the evidence: whatever run an
   earlier document has is found, however other documents share parts of it.
3. Runs with at least ENOUGH functions that are no exact copy are sought among the nearly equal. Two such runs share ENOUGH values, so
   they meet in a group of all but the last ENOUGH - 1 of theirs in order of value. Rows carry the tokens around the
   min-hash, and members are compared with the earlier ones of their group there, shingle by shingle: no
   text of another document is fetched. In large groups an index of their tokens leaves out pairs that can't be alike, or that could add
   nothing to what is covered; what it covers is what all pairs do. Still larger ones are cut into blocks, which meet pairwise in tasks of their own.
4. Exact and near runs of a document are joined to passages; of passages that overlap the longest stays whole.

No group is capped, and none moves to the driver. Documents that lie together in a task settle their shared values and runs there and
send one row for each on, so a value that a third of all documents have reaches its group once a task.
Words and runs are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

SHINGLE = 5
MIN_WORDS = 50
WIDTH = MIN_WORDS - SHINGLE + 1
SIMILARITY = 0.8
#: Two runs alike to 0.8 share a function's min-hash with that chance: at least 2 of 4 in 97 % of cases, and longer passages have more runs.
FUNCTIONS = 4
ENOUGH = 2
#: How far a passage's words may be shifted by words inserted or dropped, and how far its parts may lie apart.
SHIFT = 8
GAP = 16
#: Windows or runs that a task holds to settle among themselves.
HELD = 1 << 19
#: Groups up to this size compare every member with all earlier ones; in larger ones an index tells which of them can add something.
SMALL = 64
#: Members of a block: a larger group is cut into blocks of about so many, and any two of them meet in a task.
BLOCK = 1 << 14
#: Earlier members that those of a large group try before the index is asked.
TRIES = 8
#: Tokens equal in place that a pair needs before it is compared at all shifts.
ALIGNED = 10
#: Pairs compared at once.
PAIRS = 1 << 14
#: Rows of a large group, and candidates of theirs, that are settled together.
ROWS = 1 << 10
CANDIDATES = 1 << 18
_BITS = 23
_SPAN = 2 * WIDTH - 1
#: Tokens of a run that alike ones may lack, whatever their length: of any one more than these a partner has one.
LACKS = WIDTH - min(e for e in range(WIDTH + 1) for n in range(WIDTH - 2 * SHIFT, WIDTH + 2 * SHIFT + 1) if e / max(WIDTH + n - e, 1) >= SIMILARITY)


def _sliding(x: np.ndarray, width: int, combine: np.ufunc) -> np.ndarray:
    """combine over x[i : i + width] for each i where that fits."""
    step = 1
    while step * 2 <= width:
        x = combine(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return combine(x[: len(x) - rest], x[rest:]) if rest else x


def compact_windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all windows of at least `width` tokens, inclusive, for texts laid end to end (n + 1 offsets).

    The tokens that are least in some run of `width` are the roots of the subtrees kept; an ancestor of one is one
    itself, so the tree of these alone has the same nearest smaller tokens on both sides. Of equal tokens the first is the root.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    least = _sliding(hashes, width, np.minimum)
    text = np.searchsorted(offsets, np.arange(n), "right")
    crossing = text[: len(least)] != text[width - 1 :]
    least = np.where(crossing, np.uint64(0), least)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    inner = np.concatenate([np.ones(width - 1, bool), crossing, np.ones(width - 1, bool)])
    roots = np.flatnonzero((_sliding(around, width, np.maximum) == hashes) & ~_sliding(inner, width, np.logical_and))
    own_text = text[roots] - 1
    first, last = offsets[own_text], offsets[own_text + 1] - 1
    left, right = first.tolist(), last.tolist()
    stack: list[int] = []
    h, t, c = hashes[roots].tolist(), own_text.tolist(), roots.tolist()
    for k in range(len(c)):
        if stack and t[stack[-1]] != t[k]:
            stack.clear()
        while stack and h[stack[-1]] > h[k]:
            right[stack.pop()] = c[k] - 1
        if stack:
            left[k] = c[stack[-1]] + 1
        stack.append(k)
    l, r = np.array(left, np.int64), np.array(right, np.int64)
    wide = r - l >= width - 1
    return l[wide], roots[wide], r[wide]


def salted(tokens: np.ndarray, function: int) -> np.ndarray:
    """The tokens' values under a hash function; never 0."""
    with np.errstate(over="ignore"):
        return common.mix64(tokens ^ (np.uint64(0x9E3779B97F4A7C15) * np.uint64(function + 1))) | np.uint64(1)


def _spots(function: int, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Windows as one number: place of the min-hash, and how far the window reaches, as far as runs with that min-hash do."""
    return (c << 16) | (function << 12) | (np.minimum(c - l, WIDTH - 1) << 6) | np.minimum(r - c, WIDTH - 1)


def _unspot(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function, l, c, r)."""
    c = spots >> 16
    return spots >> 12 & 15, c - (spots >> 6 & 63), c, c + (spots & 63)


def _starts(l: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last run (by first token) of a window, inclusive."""
    return np.maximum(l, c - WIDTH + 1), np.minimum(c, r - WIDTH + 1)


def _numbers(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def _sent(columns: dict[str, np.ndarray], spec: str, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    schema = _numbers(spec)
    table = pa.Table.from_arrays([pa.array(columns[f.name]).cast(f.type) for f in schema], schema=schema)
    yield from table.to_batches(step)


_WINDOW = "value long, salt int, known boolean, doc_id long, tk int, spot long"


def _shared_windows(texts: DataFrame) -> DataFrame:
    """doc_id, tk, windows (value, spot): of each document the windows whose value another one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            value, doc, tk, spot = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, value))
            value, doc, tk, spot = value[order], doc[order], tk[order], spot[order]
            begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            ends = np.concatenate([begins[1:], [len(value)]])
            known = np.repeat(doc[begins] != doc[ends - 1], ends - begins)
            salt = np.where(known, 1 + (common.mix64(doc) >> np.uint64(54)).astype(np.int64), 0)
            salt[begins] = 0  # one row stands for the others where tasks meet
            yield from _sent({"value": value.view(np.int64), "salt": salt, "known": known, "doc_id": doc, "tk": tk, "spot": spot}, _WINDOW)

        for part in common.chunks(batches):
            hashes, offsets = words.word_hashes(part.column("text"))
            tokens, ends = words.shingles(hashes, offsets, SHINGLE)
            ids, keys = part.column("doc_id").to_numpy(), part.column("tk").to_numpy()
            for k in range(FUNCTIONS):
                own = salted(tokens, k)
                l, c, r = compact_windows(own, ends, WIDTH)
                if not len(c):
                    continue
                text = np.searchsorted(ends, c, "right") - 1
                at = ends[text]
                held.append((own[c], ids[text], keys[text], _spots(k, l - at, c - at, r - at)))
                n += len(c)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    rows = texts.mapInArrow(run, _WINDOW)
    group = Window.partitionBy("value", "salt")
    met = rows.withColumn("low", F.min("doc_id").over(group)).withColumn("high", F.max("doc_id").over(group))
    shared = met.where("known or low != high")
    return shared.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("value", "spot")).alias("windows"))


def _flat(part: pa.RecordBatch, column: str, *fields: str) -> tuple[np.ndarray, ...]:
    """(row of each element, its fields) of a list column."""
    lists = part.column(column)
    inner = lists.flatten()
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(part.num_rows), sizes), *(inner.field(f).to_numpy(zero_copy_only=False) for f in fields)


def counts(row: np.ndarray, spots: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each token place of documents laid end to end (base: n + 1 offsets) the number of functions whose windows cover the run that starts there."""
    function, l, c, r = _unspot(spots)
    lo, hi = _starts(l, c, r)
    total, n = np.zeros(int(base[-1]), np.int8), int(base[-1]) + 1
    for k in range(FUNCTIONS):
        mine = function == k
        at = base[row[mine]]
        edge = np.bincount(lo[mine] + at, minlength=n) - np.bincount(hi[mine] + 1 + at, minlength=n)
        total += np.cumsum(edge[:-1]) > 0
    return total


def _bases(row: np.ndarray, spots: np.ndarray, n: int) -> np.ndarray:
    """Offsets of documents of which only windows are known: room for all that these reach."""
    room = np.zeros(n, np.int64)
    np.maximum.at(room, row, (spots >> 16) + WIDTH + 1)
    return np.concatenate([[0], np.cumsum(room)])


_RUN = "run long, doc_id long, tk int, place int, source_id long, source_place int"


def _exact(members: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, tk, runs (place, source_id, source_place): runs that an earlier document has word for word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            value, doc, tk, place = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, doc, value))
            value, doc, tk, place = value[order], doc[order], tk[order], place[order]
            begins = np.concatenate([[True], value[1:] != value[:-1]])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(value)), 0))
            later = doc != doc[first]  # has its source here
            yield from _sent({"run": value.view(np.int64), "doc_id": doc, "tk": tk, "place": place, "source_id": np.where(later, doc[first], 0), "source_place": np.where(later, place[first], -1)}, _RUN)

        for part in common.chunks(batches):
            hashes, offsets = words.word_hashes(part.column("text"))
            runs, at = words.shingles(hashes, offsets, MIN_WORDS)
            row, spot = _flat(part, "windows", "spot")
            base = np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - SHINGLE + 1, 0))])
            whole = np.flatnonzero(counts(row, spot, base) == FUNCTIONS)
            text = np.searchsorted(base, whole, "right") - 1
            place = whole - base[text]
            held.append((runs[at[text] + place], part.column("doc_id").to_numpy()[text], part.column("tk").to_numpy()[text], place))
            n += len(place)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    joined = members.join(texts, ["doc_id", "tk"]).select("doc_id", "tk", "text", "windows")
    rows = joined.mapInArrow(run, _RUN)
    # runs with a source need none of another task; a salt keeps them from meeting in one
    settled = F.col("source_place") >= 0
    group = Window.partitionBy("run", "salt").orderBy("doc_id", "place", "tk")
    met = rows.withColumn("salt", F.when(settled, 1 + F.pmod(F.hash("doc_id", "place"), F.lit(1 << 20))).otherwise(0))
    first = met.withColumn("first_id", F.first("doc_id").over(group)).withColumn("first_place", F.first("place").over(group))
    found = first.select("doc_id", "tk", "place", F.when(settled, F.col("source_id")).otherwise(F.col("first_id")).alias("source_id"), F.when(settled, F.col("source_place")).otherwise(F.col("first_place")).alias("source_place"))
    return found.where("source_id < doc_id").groupBy("doc_id", "tk").agg(F.collect_list(F.struct("place", "source_id", "source_place")).alias("runs"))


_OPEN = "value long, doc_id long, tk int, spot long"


def _open_windows(members: DataFrame, exact: DataFrame) -> DataFrame:
    """value, doc_id, tk, spot: windows by which runs that are no exact copy, with ENOUGH shared values, may meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                row, value, spot = _flat(part, "windows", "value", "spot")
                value = value.view(np.uint64)
                base = _bases(row, spot, part.num_rows)
                open_ = counts(row, spot, base) >= ENOUGH
                of, place = _flat(part, "runs", "place")
                open_[base[of] + place] = False
                function, l, c, r = _unspot(spot)
                lo, hi = _starts(l, c, r)
                values = np.zeros((FUNCTIONS, int(base[-1])), np.uint64)
                for k in range(FUNCTIONS):
                    mine = np.flatnonzero(function == k)
                    size = (hi - lo + 1)[mine]
                    at = np.repeat((lo + base[row])[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    values[k, at] = np.repeat(value[mine], size)
                limit = np.sort(values, axis=0)[FUNCTIONS - ENOUGH + 1] if ENOUGH > 1 else np.full(int(base[-1]), np.iinfo(np.uint64).max, np.uint64)
                keep = np.zeros(len(spot), bool)
                for k in range(FUNCTIONS):
                    mine = np.flatnonzero(function == k)
                    sums = np.concatenate([[0], np.cumsum(open_ & (values[k] < limit))])
                    keep[mine] = sums[(hi + 1 + base[row])[mine]] > sums[(lo + base[row])[mine]]
                if keep.any():
                    yield from _sent({"value": value[keep].view(np.int64), "doc_id": part.column("doc_id").to_numpy()[row[keep]], "tk": part.column("tk").to_numpy()[row[keep]], "spot": spot[keep]}, _OPEN)

    both = members.join(exact, ["doc_id", "tk"], "left").select("doc_id", "tk", "windows", "runs")
    return both.mapInArrow(run, _OPEN).distinct()


_AROUND = "value long, part int, doc_id long, tk int, place int, first int, tokens binary"
_MEMBER = _AROUND + ", known binary"
_NEAR = "doc_id long, tk int, start int, n_words int, source_id long, source_start int, source_words int, similarity double"


def _around(sought: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """The windows (of groups of n) with the tokens of all runs that hold the min-hash, 4 bytes each.

    known: in large groups the tokens (bits, from WIDTH - 1 before the min-hash on) that exact runs cover; else empty. part: which two blocks of the group meet, whether these are two (bit 1), and on which side the window is (bit 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            hashes, offsets = words.word_hashes(part.column("text"))
            tokens, ends = words.shingles(hashes, offsets, SHINGLE)
            row, value, spot, n = _flat(part, "windows", "value", "spot", "n")
            c, base = spot >> 16, ends[row]
            l, r = np.maximum(c - WIDTH + 1, 0), np.minimum(c + WIDTH - 1, ends[row + 1] - base - 1)
            short = np.maximum(tokens >> np.uint64(32), np.uint64(1)).astype(np.uint32)
            ids, keys = part.column("doc_id").to_numpy(), part.column("tk").to_numpy()
            # a member of `many` blocks stands once for each block that its own one meets
            many = -(-n // block)
            own = (common.mix64(ids[row]) % many.astype(np.uint64)).astype(np.int64)
            every = np.repeat(np.arange(len(spot)), many)
            other = np.arange(len(every)) - np.repeat(np.cumsum(many) - many, many)
            own, low, high = own[every], np.minimum(own[every], other), np.maximum(own[every], other)
            part_of = (low * many[every] + high) << 2 | (low != high).astype(np.int64) << 1 | (own > other)
            of, place = _flat(part, "places", "place")
            edge = np.zeros(len(tokens) + 1, np.int32)
            np.add.at(edge, ends[of] + place, 1)
            np.add.at(edge, ends[of] + place + WIDTH, -1)
            exact = np.concatenate([np.zeros(WIDTH, bool), np.cumsum(edge[:-1]) > 0, np.zeros(WIDTH, bool)])
            known = []
            for k in range(0, len(spot), 1 << 12):
                around = (base + c)[k : k + (1 << 12), None] + np.arange(1, _SPAN + 1)
                bits = np.packbits(exact[around], axis=1)
                known += [x.tobytes() if big else b"" for x, big in zip(bits, (n[k : k + (1 << 12)] > SMALL).tolist())]
            known = [known[k] for k in every.tolist()]
            row, value, c, l, r, base = (v[every] for v in (row, value, c, l, r, base))
            size = r - l + 1
            at = np.repeat(base + l - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ends_ = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends_), pa.py_buffer(short[at].tobytes())])
            columns = [value, part_of, ids[row], keys[row], c, l, data, known]
            if len(size):
                schema = _numbers(_MEMBER)
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    joined = sought.join(texts, ["doc_id", "tk"]).select("doc_id", "tk", "text", "windows", "places")
    return joined.mapInArrow(run, _MEMBER)


_ORDER = np.array(sorted(range(-SHIFT, SHIFT + 1), key=abs))


def near_pairs(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Alike runs of pairs of token rows, both with the min-hash in the middle (0: no token).

    For each pair that has one: (pair, first and last column of the passage, first and last column in the other,
    similarity). A run counts if its first and last token are in the other, and its tokens and those between
    their counterparts are alike to SIMILARITY.
    """
    real = own != 0
    may = np.flatnonzero(((own == other) & real).sum(1) >= ALIGNED)
    own, real = own[may], real[may]
    wide = np.zeros((len(may), _SPAN + 2 * SHIFT), np.uint32)
    wide[:, SHIFT : SHIFT + _SPAN] = other[may]
    shift = np.full(own.shape, 127, np.int8)
    for s in _ORDER:
        shift[(own == wide[:, SHIFT + s : SHIFT + s + _SPAN]) & real & (shift == 127)] = s
    hit = shift != 127
    sums = np.zeros((len(may), _SPAN + 1), np.int32)
    np.cumsum(hit, axis=1, out=sums[:, 1:])
    equal = sums[:, WIDTH:] - sums[:, :WIDTH]
    other_size = WIDTH + shift[:, WIDTH - 1 :].astype(np.int32) - shift[:, :WIDTH]
    alike = equal / np.maximum(WIDTH + other_size - equal, 1)
    good = hit[:, :WIDTH] & hit[:, WIDTH - 1 :] & (other_size > 0) & (alike >= SIMILARITY)
    k = np.flatnonzero(good.any(1))
    a, b = good[k].argmax(1), 2 * (WIDTH - 1) - good[k][:, ::-1].argmax(1)
    least = np.where(good[k], alike[k], 2).min(1)
    # what goes on equal on either side belongs to it
    hit, shift, at = hit[k], shift[k], np.arange(_SPAN)
    goes_on = hit[:, 1:] & hit[:, :-1] & (shift[:, 1:] == shift[:, :-1])
    none = np.zeros((len(k), 1), bool)
    since = np.maximum.accumulate(np.where(np.hstack([none, goes_on]), 0, at), axis=1)
    until = np.minimum.accumulate(np.where(np.hstack([goes_on, none]), _SPAN, at)[:, ::-1], axis=1)[:, ::-1]
    k, i = may[k], np.arange(len(k))
    a, b = since[i, a], until[i, b]
    return k, a, b, a + shift[i, a], b + shift[i, b], np.minimum(least, 1)


def reaches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether near_pairs may find something, first and last column that it may cover at most) of rows of which no more than `hit` have a counterpart."""
    sums = np.zeros((len(hit), _SPAN + 1), np.int8)
    np.cumsum(hit, axis=1, out=sums[:, 1:])
    runs = hit[:, :WIDTH] & hit[:, WIDTH - 1 :] & (sums[:, WIDTH:] - sums[:, :WIDTH] >= WIDTH - LACKS)
    i, at = np.arange(len(hit)), np.arange(_SPAN, dtype=np.int8)
    a, b = runs.argmax(1), 2 * (WIDTH - 1) - runs[:, ::-1].argmax(1)
    # what goes on with counterparts on either side belongs to it
    since = np.maximum.accumulate(np.where(hit, np.int8(0), at + np.int8(1)), axis=1)
    until = np.minimum.accumulate(np.where(hit, np.int8(_SPAN), at)[:, ::-1], axis=1)[:, ::-1] - np.int8(1)
    return runs.any(1), since[i, a], until[i, b]


class _Index:
    """The rows of a large group in order of (doc, tk, c), by their tokens.

    Only places that no exact run, other window of the document or earlier row covers yet are sought (known: those that exact runs cover). All alike
    runs of two rows hold the min-hash, so what was found for a row lies around it, and a row that adds an open place on one side has a
    token at that place or beyond, at most SHIFT away. It also has one of any LACKS + 1 tokens of the run that it is alike to, so of the rarest
    of each run. Whichever of the two has the shorter lists names the candidates. A candidate is told once which places it may cover at most;
    it goes when all of these are covered.
    """

    def __init__(self, doc: np.ndarray, tk: np.ndarray, c: np.ndarray, matrix: np.ndarray, side: np.ndarray | None, known: np.ndarray | None = None):
        n = len(doc)
        self.matrix, self.side, self.real = matrix, side, matrix != 0
        self.before = np.searchsorted(doc, doc)  # rows of earlier documents
        step = np.full(n, _SPAN)
        same = (doc[1:] == doc[:-1]) & (tk[1:] == tk[:-1])
        step[1:][same] = np.minimum(c[1:] - c[:-1], _SPAN)[same]
        self.base = np.cumsum(step) - step[0]
        self.covered = np.zeros(int(self.base[-1]) + _SPAN, bool)
        if known is not None:
            row, column = np.nonzero(known)
            self.covered[self.base[row] + column] = True
        centre = matrix == matrix[0, WIDTH - 1]  # the min-hash, which all have
        self.first, self.last = centre.argmax(1), _SPAN - 1 - centre[:, ::-1].argmax(1)
        self.low, self.high = np.full(n, WIDTH - 1), np.full(n, WIDTH - 1)  # found for the row itself
        distinct, ids = np.unique(matrix, return_inverse=True)
        self.ids = ids.reshape(matrix.shape).astype(np.int32)
        count = np.bincount(self.ids.ravel(), minlength=len(distinct))
        self.starts = np.concatenate([[0], np.cumsum(count)])
        order = np.argsort(self.ids.ravel(), kind="stable").astype(np.int32)
        self.row, self.column = order // _SPAN, (order % _SPAN).astype(np.int8)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        # entries of a token's list before a row's own one; those of earlier rows are among them
        self.earlier = place.reshape(matrix.shape) - self.starts[self.ids].astype(np.int32)
        self.df = np.where(self.real, count.astype(np.int32)[self.ids], np.iinfo(np.int32).max)
        # tokens that an earlier document has; without enough of them in a run, nothing is alike
        alive = self.real & (self.row[self.starts[self.ids]] < self.before[:, None])
        self.likely, self.least, self.most = reaches(alive)
        self.alive, self.rare = alive, np.zeros(matrix.shape, bool)
        self.found: list[tuple] = []

    def seek(self, rows: np.ndarray) -> None:
        """Marks the rarest tokens of the rows' runs."""
        for first in range(WIDTH):
            own = rows[self.real[rows, first] & self.real[rows, first + WIDTH - 1]]
            rarest = np.argpartition(self.df[own, first : first + WIDTH], LACKS, axis=1)[:, : LACKS + 1] + first
            self.rare[own[:, None], rarest] = True
        self.rare &= self.alive

    def open(self, i: int) -> np.ndarray:
        """Columns of a row that nothing covers yet."""
        return np.flatnonzero(self.real[i] & ~self.covered[self.base[i] : self.base[i] + _SPAN])

    def unsettled(self) -> np.ndarray:
        """Rows with open columns that an earlier one may cover."""
        rows = np.flatnonzero(self.likely)
        at = np.arange(_SPAN)
        reached = (at >= self.least[rows, None]) & (at <= self.most[rows, None])
        return rows[(self.real[rows] & reached & ~self.covered[self.base[rows][:, None] + at]).any(1)]

    def adding(self, i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of these spans of columns of row i hold an open one."""
        sums = np.zeros(_SPAN + 1, np.int64)
        np.cumsum(self.real[i] & ~self.covered[self.base[i] : self.base[i] + _SPAN], out=sums[1:])
        return sums[high.astype(np.int64) + 1] > sums[low]

    def candidates(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Earlier rows that may cover more of row i, likely ones first, and the first and last column that each may cover."""
        none = (np.zeros(0, np.int64),) * 3
        n, open_, rare = int(self.before[i]), self.open(i), np.flatnonzero(self.rare[i])
        if not n or not len(open_) or not len(rare):
            return none
        left, right = open_[open_ < self.low[i]], open_[open_ > self.high[i]]
        beyond = np.flatnonzero(self.real[i])
        if len(left) + len(right) == len(open_):
            beyond = beyond[(beyond <= left.max(initial=-1)) | (beyond >= right.min(initial=_SPAN))]
        spans = self.earlier[i]
        columns = min(beyond, rare, key=lambda x: int(spans[x].sum(dtype=np.int64)))
        n_hits = spans[columns].sum(dtype=np.int64)
        if n_hits > 64 * len(self.matrix):  # long lists: all rows
            may = np.arange(n)
        else:
            row, column = self._hits(i, columns)
            may = np.flatnonzero(np.bincount(row, minlength=n))
        if self.side is not None:
            may = may[self.side[may] != self.side[i]]
        if not len(may):
            return none
        # what each row may have in common with this one
        centre = self.matrix[i] == self.matrix[i, WIDTH - 1]
        row, column = self._hits(i, np.flatnonzero(self.real[i] & ~centre))
        may = may[np.bincount(row, minlength=n)[may] + centre.sum() >= WIDTH - LACKS]
        hit = centre & (np.arange(_SPAN) >= self.first[may, None] - SHIFT) & (np.arange(_SPAN) <= self.last[may, None] + SHIFT)
        at = np.full(n, -1)
        at[may] = np.arange(len(may))
        row = at[row]
        hit[row[row >= 0], column[row >= 0]] = True
        likely, low, high = reaches(hit)
        kept = np.flatnonzero(likely & self.adding(i, low, high))
        kept = kept[np.argsort(-hit[kept].sum(1), kind="stable")]
        return may[kept], low[kept], high[kept]

    def _hits(self, i: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(earlier row, column) where these columns' tokens of row i are, at most SHIFT away."""
        size = self.earlier[i, columns].astype(np.int64)
        at = np.repeat(self.starts[self.ids[i, columns]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row, column = self.row[at], np.repeat(columns, size)
        near = (row < self.before[i]) & (np.abs(self.column[at] - column) <= SHIFT)
        return row[near], column[near]

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), PAIRS):
            p, q = i[at : at + PAIRS], j[at : at + PAIRS]
            k, a, b, x, y, alike = near_pairs(self.matrix[p], self.matrix[q])
            if not len(k):
                continue
            p, q = p[k], q[k]
            self.found.append((p, q, a, b, x, y, alike))
            np.minimum.at(self.low, p, a)
            np.maximum.at(self.high, p, b)
            size = b - a + 1
            self.covered[np.repeat(self.base[p] + a - (np.cumsum(size) - size), size) + np.arange(size.sum())] = True

    def settle(self, waiting: list[tuple]) -> None:
        """Compares rows with their candidates, few at first, as long as these may add something."""
        quota = 1
        while waiting:
            pairs, more = [], []
            for i, may, low, high in waiting:
                if quota > 1:
                    adds = self.adding(i, low, high)
                    may, low, high = may[adds], low[adds], high[adds]
                if len(may):
                    pairs.append((i, may[:quota]))
                if len(may) > quota:
                    more.append((i, may[quota:], low[quota:], high[quota:]))
            if pairs:
                self.compare(np.repeat([i for i, _ in pairs], [len(j) for _, j in pairs]), np.concatenate([j for _, j in pairs]))
            waiting, quota = more, quota * 4

    def run(self) -> list[tuple]:
        """(row, earlier row, and what near_pairs says of them) of pairs that cover all that all pairs do."""
        left = self.unsettled()
        for k in range(TRIES if len(left) else 0):
            j = (common.mix64(left * TRIES + k) % self.before[left].astype(np.uint64)).astype(np.int64) if k else np.zeros(len(left), np.int64)
            real = np.full(len(left), True) if self.side is None else self.side[left] != self.side[j]
            self.compare(left[real], j[real])
            left = left[~self.covered[self.base[left] + WIDTH - 1]]
        left = self.unsettled()
        self.seek(left)
        waiting, n = [], 0
        for i in left.tolist():
            found = self.candidates(i)
            if len(found[0]):
                waiting.append((i, *found))
                n += len(found[0])
            if len(waiting) >= ROWS or n >= CANDIDATES:
                self.settle(waiting)
                waiting, n = [], 0
        self.settle(waiting)
        return self.found


def _small(doc: np.ndarray, matrix: np.ndarray, first: np.ndarray, side: np.ndarray) -> list[tuple]:
    """As _Index.run, of many small groups: every row against all earlier ones of its group, whose first row is given."""
    found = []
    left = np.flatnonzero(doc[first] < doc)
    back = 1
    while len(left := left[left - back >= first[left]]):
        j = left - back
        real = (doc[j] < doc[left]) & ((side[left] < 0) | (side[left] != side[j]))
        i, j = left[real], j[real]
        for at in range(0, len(i), PAIRS):
            p, q = i[at : at + PAIRS], j[at : at + PAIRS]
            k, *rest = near_pairs(matrix[p], matrix[q])
            found.append((p[k], q[k], *rest))
        back += 1
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near repeats among rows of _AROUND in order of (value, blocks of the part)."""

    def compared(columns: tuple) -> Iterator[pa.RecordBatch]:
        value, part, doc, tk, c, matrix, known = columns
        order = np.lexsort((c, tk, doc, part >> 2, value))
        value, part, doc, tk, c, matrix, known = (x[order] for x in columns)
        side = np.where(part & 2, part & 1, -1)
        begins = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (part[1:] >> 2 != part[:-1] >> 2)]))
        sizes = np.diff(np.concatenate([begins, [len(value)]]))
        first = np.repeat(begins, sizes)
        small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        found = []
        if len(small):
            place = np.cumsum(np.repeat(sizes <= SMALL, sizes)) - 1
            found += [(small[p], small[q], *rest) for p, q, *rest in _small(doc[small], matrix[small], place[first[small]], side[small])]
        for at, size in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            mine = slice(at, at + size)
            if doc[at] != doc[at + size - 1]:
                pairs = _Index(doc[mine], tk[mine], c[mine], matrix[mine], side[mine] if side[at] >= 0 else None, known[mine]).run()
                found += [(p + at, q + at, *rest) for p, q, *rest in pairs]
        if found:
            d, s, a, b, x, y, alike = map(np.concatenate, zip(*found))
            columns = (doc[d], tk[d], c[d] - WIDTH + 1 + a, b - a + SHINGLE, doc[s], c[s] - WIDTH + 1 + x, y - x + SHINGLE, alike)
            yield from _sent(dict(zip((f.name for f in _numbers(_NEAR)), columns)), _NEAR)

    held: list[tuple] = []  # of the last group, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        value, part, doc, tk, c, l = (batch.column(i).to_numpy() for i in range(6))
        data, ends = common.bytes_of(batch.column("tokens"))
        size = np.diff(ends) // 4
        matrix = np.zeros((len(value), _SPAN), np.uint32)
        row = np.repeat(np.arange(len(value)), size)
        matrix[row, np.arange(len(row)) - (ends[:-1] // 4)[row] + (WIDTH - 1 - (c - l))[row]] = np.frombuffer(data.tobytes(), np.uint32)
        known = np.zeros((len(value), _SPAN), bool)
        if batch.num_columns > 7:
            bits, bit_ends = common.bytes_of(batch.column("known"))
            told = np.flatnonzero(np.diff(bit_ends))
            known[told] = np.unpackbits(bits.reshape(len(told), (_SPAN + 7) // 8), axis=1, count=_SPAN).astype(bool)
        columns = (value, part, doc, tk, c, matrix, known)
        other = np.flatnonzero((value != value[-1]) | (part >> 2 != part[-1] >> 2))
        last = int(other[-1]) + 1 if len(other) else 0
        if held and (last or value[0] != held[0][0][0] or part[0] >> 2 != held[0][1][0] >> 2):
            held.append(tuple(x[:last] for x in columns))
            yield from compared(tuple(map(np.concatenate, zip(*held))))
            held = []
        elif last:
            yield from compared(tuple(x[:last] for x in columns))
        held.append(tuple(x[last:].copy() for x in columns))
    if held:
        yield from compared(tuple(map(np.concatenate, zip(*held))))


def _near(members: DataFrame, exact: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, tk, near: passages that an earlier document has nearly."""
    rows = common.written(_open_windows(members, exact), "passage-open")
    groups = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high")
    sought = rows.join(groups.select("value", "n"), "value").groupBy("doc_id", "tk").agg(F.collect_list(F.struct("value", "spot", "n")).alias("windows"), F.max("n").alias("most"))
    places = exact.select("doc_id", "tk", F.expr("transform(runs, x -> struct(x.place as place))").alias("places"))
    sought = sought.where(f"most <= {SMALL}").withColumn("places", F.lit(None).cast(places.schema["places"].dataType)).unionByName(sought.where(f"most > {SMALL}").join(places, ["doc_id", "tk"], "left"))
    sought = common.written(sought.drop("most"), "passage-sought")
    common.discard(rows)
    common.free(texts.sparkSession)
    around = _around(sought, _active(texts, sought.select("doc_id")), block)
    keys = [F.col("value"), F.shiftright("part", 2)]
    found = around.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare, _NEAR)
    names = [f.name for f in _numbers(_NEAR)][2:]
    return found.groupBy("doc_id", "tk").agg(F.collect_list(F.struct(*names)).alias("near"))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Marks of the ids' low bits: 1 MB at most, made in the cluster. Marks of other ids only cost a join."""
    low = ids.select(F.pmod(F.col("doc_id"), F.lit(1 << _BITS)).alias("low"))
    found = low.groupBy(F.shiftright("low", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 31 as int))")).alias("marks")).toArrow()
    out = np.zeros(1 << (_BITS - 5), np.uint32)
    out[found["word"].to_numpy()] = found["marks"].to_numpy().astype(np.uint32)
    return out


def _active(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids, and a few others."""
    marks = texts.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column("doc_id").to_numpy() % (1 << _BITS)
            hit = marks.value[low >> 5] >> (low & 31).astype(np.uint32) & np.uint32(1)
            if hit.any():
                yield batch.filter(pa.array(hit.astype(bool)))

    return texts.mapInArrow(pick, texts.schema)


#: A passage: start, end, source_id, source start, source end, similarity.
Passage = tuple[int, int, int, int, int, float]


def exact_passages(place: np.ndarray, source: np.ndarray, source_place: np.ndarray) -> list[Passage]:
    """Runs with their sources, as longest passages of one source and distance."""
    if not len(place):
        return []
    shift = place - source_place
    order = np.lexsort((place, shift, source))
    place, source, shift = place[order], source[order], shift[order]
    cut = np.concatenate([[True], (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] - place[:-1] > MIN_WORDS)])
    begins = np.flatnonzero(cut)
    start, end = place[begins], place[np.concatenate([begins[1:] - 1, [len(place) - 1]])] + MIN_WORDS
    source, shift = source[begins], shift[begins]
    return list(zip(start.tolist(), end.tolist(), source.tolist(), (start - shift).tolist(), (end - shift).tolist(), [1.0] * len(start)))


def _equal_tokens(p: Passage) -> float:
    """How many tokens a passage has in common with its source, from its similarity."""
    both = p[1] - p[0] + p[4] - p[3] - 2 * (SHINGLE - 1)
    return both * p[5] / (1 + p[5])


def joined(passages: list[Passage]) -> list[Passage]:
    """Passages of one source that overlap, or follow each other closely and are alike together, as one."""
    out: list[Passage] = []
    for p in sorted(passages, key=lambda p: (p[2], p[0], -p[1])):
        if out and out[-1][2] == p[2]:
            q = out[-1]
            if p[1] <= q[1] and (p[5] <= q[5] or p[1] - p[0] < MIN_WORDS):
                continue
            gap, other_gap = p[0] - q[1], p[3] - q[4]
            if max(gap, other_gap) <= GAP and abs((p[0] - p[3]) - (q[1] - q[4])) <= SHIFT and p[4] >= q[4]:
                whole = (q[0], max(p[1], q[1]), q[2], min(p[3], q[3]), p[4])
                if gap <= 0:
                    out[-1] = (*whole, min(p[5], q[5]))
                    continue
                equal = _equal_tokens(p) + _equal_tokens(q)
                both = whole[1] - whole[0] + whole[4] - whole[3] - 2 * (SHINGLE - 1)
                if equal >= SIMILARITY * (both - equal):
                    out[-1] = (*whole, equal / (both - equal))
                    continue
        out.append(p)
    return out


def disjoint(passages: list[Passage]) -> list[Passage]:
    """Those that cover what all of them cover, without overlap: longest first, of the others what sticks out."""
    covered = np.zeros(max((p[1] for p in passages), default=0) + 2, bool)
    out: list[Passage] = []
    for p in sorted(passages, key=lambda p: (p[0] - p[1], p[2], p[0], p[3])):
        inside = covered[p[0] : p[1]]
        if inside.all():
            continue
        if not inside.any():
            out.append(p)
        else:
            edges = np.flatnonzero(np.diff(np.concatenate([[True], inside, [True]]).astype(np.int8)))
            for x, y in zip((edges[::2] + p[0]).tolist(), (edges[1::2] + p[0]).tolist()):
                at = min(p[3] + x - p[0], p[4] - 1)
                out.append((x, y, p[2], at, min(at + y - x, p[4]), p[5]))
        covered[p[0] : p[1]] = True
    return sorted(out)


_DDL = "doc_id long, start int, n_words int, source_id long, source_start int, source_words int, similarity double, text_key int"


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _numbers(_DDL)
    for batch in batches:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("tk").to_pylist()
        row, *exact = _flat(batch, "runs", "place", "source_id", "source_place")
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        near_row, *near = _flat(batch, "near", "start", "n_words", "source_id", "source_start", "source_words", "similarity")
        near_cuts = np.searchsorted(near_row, np.arange(batch.num_rows + 1))
        rows = []
        for k, (doc_id, key) in enumerate(zip(ids, keys)):
            place, source, source_place = (x[cuts[k] : cuts[k + 1]].astype(np.int64) for x in exact)
            found = exact_passages(place, source, source_place)
            part = slice(near_cuts[k], near_cuts[k + 1])
            found += {(a, a + n, s, x, x + m, sim) for a, n, s, x, m, sim in zip(*(v[part].tolist() for v in near))}
            rows += [(doc_id, a, b - a, s, x, y - x, sim, key) for a, b, s, x, y, sim in disjoint(joined(found))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_words, source_id, source_start, source_words, similarity, text_key: passages that repeat an earlier document's.

    Places count words (runs of bytes other than ASCII white space; case of A-Z doesn't count) from 0. Earlier: of a smaller
    doc_id, so of all copies of a passage the first document's are not listed; repetitions within one document don't count. Every run of MIN_WORDS
    words that an earlier document has is covered. similarity: 1.0 for those, else the least of the runs'. Passages of
    one document are disjoint: where several sources cover it, the longest passage is kept whole, and of the others the
    parts that stick out, which may be shorter than MIN_WORDS. Null, empty and short texts, and rows without an id, have none.
    Different texts under one id are told apart by text_key, and are no sources of each other; equal rows are
    listed once. An empty table gives no rows. Other columns are ignored.
    """
    texts = common.id_text(docs, id_col, text_col).where("doc_id is not null").withColumn("tk", F.hash("text"))
    members = common.written(_shared_windows(texts).where(F.size("windows") >= ENOUGH), "passage-windows")
    common.free(docs.sparkSession)
    exact = common.written(_exact(members, _active(texts, members.select("doc_id"))), "passage-exact")
    common.free(docs.sparkSession)
    near = common.written(_near(members, exact, texts, block), "passage-near")
    common.discard(members)
    common.free(docs.sparkSession)
    return exact.join(near, ["doc_id", "tk"], "full").select("doc_id", "tk", "runs", "near").mapInArrow(_assembled, _DDL)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The documents without the passages that repeat earlier ones; the same columns.

    What is left of a text keeps its white space; where a passage went, one line break stands. The count column, if
    there, gets the new number of code points. A document of which nothing is left goes; those without repetitions, also null and empty
    texts and rows without an id, are untouched. Repeated rows are treated alike. An empty table gives no rows.
    """
    spans = repeats(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("__spans"))
    spans = common.written(spans, "passage-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, "__text"):
            data, ends = common.bytes_of(part.column("__text"))
            start, stop = words.word_spans(data, ends, words.SPACED[data]) if len(data) else (np.zeros(0, np.int64),) * 2
            first = np.searchsorted(start, ends)
            raw, out = data.tobytes(), []
            there, listed = part.column("__text").is_valid().to_pylist(), part.column("__spans").to_pylist()
            for k, spans in enumerate(listed):
                if spans is None:  # marked by chance
                    out.append(raw[ends[k] : ends[k + 1]].decode("utf-8", "surrogatepass") if there[k] else None)
                    continue
                pieces, at = [], int(ends[k])
                for s in spans:
                    a, b = first[k] + s["start"], first[k] + s["start"] + s["n_words"] - 1
                    pieces.append(raw[at : start[a]].rstrip())
                    at = int(stop[b])
                pieces.append(raw[at : int(ends[k + 1])])
                kept = [p.strip() for p in pieces if p.strip()]
                out.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(out, pa.string()), pa.array([x is not None for x in listed])], ["__row", "__text", "__cut"])

    text = F.col(f"`{text_col}`").cast("string")
    packed = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.hash(F.coalesce(text, F.lit(""))).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text.alias("__text"))
    keys = ["__id", "__key"]
    # most rows stay where they lie; of the others the text moves once, not in the row as well
    packed = common.marked(packed, spans.select("__id"))
    whole = packed.where("not __marked").select("__row.*")
    touched = packed.where("__marked").select(*keys, F.col("__row").dropFields(f"`{text_col}`").alias("__row"), "__text")
    touched = touched.join(spans, keys, "left").select("__row", "__text", "__spans")
    row = touched.schema["__row"].dataType.simpleString()
    done = touched.mapInArrow(cut, f"__row {row}, __text string, __cut boolean").where(~F.col("__cut") | (F.length(F.trim("__text")) > 0))
    kept = []
    for c in docs.columns:
        if c == text_col:
            kept.append(F.col("__text").alias(c))
        elif c == count_col:
            kept.append(F.when(F.col("__cut"), F.length("__text").cast(docs.schema[c].dataType)).otherwise(F.col(f"__row.`{c}`")).alias(c))
        else:
            kept.append(F.col(f"__row.`{c}`").alias(c))
    return whole.unionByName(done.select(*kept))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.table(spark, sf_dir, "documents"))

"""Nearest neighbours by largest inner product with a hash-prefix forest.

Vectors of one number of dimensions and of nearly one length form a class (within a class, larger products are smaller angles).
Every vector has a long hash string in each of TREES trees: one symbol for the signed axis of a random rotation that
it lies nearest to, then symbols for a few axes of further rotations. A tree is its vectors in order of these strings. It lies in
cells, one for each first symbol, as sorted arrays; rows of all blocks and the queries meet there by an equi-join.

1. Descent: in each tree a query goes to the run of strings that share its first bits, for every number of bits at once (two binary searches each).
   The sizes of these runs are added up over the trees.
2. Synchronous ascent: all trees of a query go up, bit by bit, one after the other at the last bit, until the runs hold `wanted` rows, counted with
   repetitions among trees: a number that grows with the 3/4th power of the class. Runs are never cut.
3. The rows found go to their blocks, queries with them, each to those blocks alone; there each is scored once, exactly.

Equal vectors are one row with the k + 1 smallest ids, which is all that a result can show. Classes of FEW vectors, and queries that found fewer
than k rows, are compared with all vectors, block by block. All rows are indexed; nothing is fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a block; their places take POS bits of a row's number.
POS = 12
BLOCK = 1 << POS
TREES = 128
#: Axes that each symbol of a string chooses among, at most.
AXES = (64, 8, 8)
#: wanted = BREADTH * n ** 0.75 for a class of n vectors.
BREADTH = 3.8
#: Classes of up to this many vectors are scored whole.
FEW = 512
#: Lengths of a class differ by this factor at most; the last of CLASSES holds all that are shorter.
RATIO = 1.15
CLASSES = 8
#: Queries of a block that one task scores.
QUERIES = 2048
SEED = 11


def _bits(dims: int) -> list[int]:
    """Bits of each symbol."""
    return [max(1, (2 * min(a, dims) - 1).bit_length()) for a in AXES]


_PLANES: dict[tuple[int, int], list[np.ndarray]] = {}


def planes(dims: int, trees: int) -> list[np.ndarray]:
    """For each symbol the axes of all trees, dims x (trees * axes), drawn from a fixed seed."""
    if (dims, trees) not in _PLANES:
        rng = np.random.default_rng([SEED, dims])
        _PLANES[dims, trees] = [np.hstack([np.linalg.qr(rng.normal(size=(dims, min(a, dims))))[0] for _ in range(trees)]).astype(np.float32) for a in AXES]
    return _PLANES[dims, trees]


def strings(x: np.ndarray, trees: int = TREES) -> np.ndarray:
    """rows x trees: the hash strings as numbers, first symbol highest."""
    n, dims = x.shape
    x = (x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)).astype(np.float32)
    out = np.zeros((n, trees), np.int32)
    for bits, axes in zip(_bits(dims), planes(dims, trees)):
        width = axes.shape[1] // trees
        for at in range(0, n, 1024):
            p = (x[at : at + 1024] @ axes).reshape(-1, trees, width)
            best = np.abs(p).argmax(2)
            sign = np.take_along_axis(p, best[..., None], 2)[..., 0] > 0
            out[at : at + 1024] = (out[at : at + 1024] << bits) | (2 * best + sign)
    return out


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding, dims, size (length): whole rows with finite vectors other than zero."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = rows.where("forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v != 0)")
    # scaled by the greatest part, so that no square overflows
    top = F.expr("array_max(transform(embedding, v -> abs(v)))")
    return finite.withColumn("top", top).select("vec_id", "embedding", F.size("embedding").alias("dims"), F.expr("ln(top) + 0.5 * ln(aggregate(embedding, 0D, (a, v) -> a + v / top * v / top))").alias("size"))


_BLOCKS = "block long, dims int, class int, n int, ids binary, ends binary, data binary"


def _blocks(rows: DataFrame, k: int, tasks: int) -> DataFrame:
    """Distinct vectors in blocks of near strings (of the first tree): for each vector its k + 1 smallest ids (ids, n + 1 ends), and the numbers (data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 24, 0
        open_: dict[tuple[int, int], tuple[list, list, list]] = {}
        last = None

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal count
            vectors, ids, sizes = open_.pop(key)
            count += 1
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = [base + count - 1, *key, len(vectors), np.array(ids, np.int64).tobytes(), ends.tobytes(), np.concatenate(vectors).tobytes()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            column = batch.column("embedding")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            for i, (vec_id, dims, class_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dims", "class")))):
                vector = flat[ends[i] : ends[i + 1]] + 0.0  # -0.0 is 0.0
                key = (dims, class_)
                vectors, ids, sizes = open_.setdefault(key, ([], [], []))
                if last is not None and key == last[0] and vectors and np.array_equal(vector, last[1]):
                    sizes[-1] += 1
                else:
                    if len(vectors) == BLOCK:
                        yield block(key)
                        vectors, ids, sizes = open_.setdefault(key, ([], [], []))
                    vectors.append(vector)
                    sizes.append(1)
                ids.append(vec_id)
                last = (key, vector)
        for key in list(open_):
            yield block(key)

    def first_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("dims").to_numpy()
            for dims in np.unique(every).tolist():
                some = batch.take(pa.array(np.flatnonzero(every == dims)))
                yield some.append_column("string", pa.array(strings(some.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), 1)[:, 0]))

    same = Window.partitionBy("dims", "class", "embedding").orderBy("vec_id")
    least = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).select("vec_id", "embedding", "dims", "class")
    keys = ["dims", "class", "string", "embedding"]
    placed = least.mapInArrow(first_strings, "vec_id long, embedding array<double>, dims int, class int, string int").repartitionByRange(*keys)
    # few rows a partition would make many small blocks
    whole = placed.sortWithinPartitions(*keys, "vec_id").select("vec_id", "embedding", "dims", "class").coalesce(tasks)
    return whole.mapInArrow(run, _BLOCKS)


_CELL = "dims int, class int, tree int, cell int, kind int, codes binary, numbers binary, ups binary"


def _in_cells(codes: np.ndarray, numbers: np.ndarray, dims: int, class_: int, steps: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Strings (rows x trees) and numbers, one piece for each tree and first symbol. With steps they are queries: each step takes
    the next tree one bit up."""
    trees = codes.shape[1]
    rest = sum(_bits(dims)[1:])
    names = [c.split()[0] for c in _CELL.split(", ")]
    kinds = (pa.int32(),) * 5 + (pa.binary(),) * 3
    for t in range(trees):
        order = np.argsort(codes[:, t], kind="stable")
        own, who = codes[order, t], numbers[order].astype(np.int64)
        up = None if steps is None else (steps[order] // trees + (t < steps[order] % trees)).astype(np.int8)
        first = own >> rest
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]]))
        rows = [(dims, class_, t, int(first[a]), int(up is not None), own[a:b].tobytes(), who[a:b].tobytes(), None if up is None else up[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def _index(blocks: DataFrame, trees: int) -> DataFrame:
    """The forest: every vector in its cell of every tree. Blocks that lie in one task share pieces, some BLOCK vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            codes, numbers = (np.concatenate(x) for x in zip(*held.pop(key)))
            yield from _in_cells(codes, numbers, *key)

        for batch in batches:
            for number, dims, class_, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "dims", "class", "n", "data"))):
                some = held.setdefault((dims, class_), [])
                some.append((strings(np.frombuffer(data, np.float64).reshape(n, dims), trees), (number << POS) + np.arange(n)))
                if sum(len(x) for _, x in some) >= BLOCK:
                    yield from flush((dims, class_))
        for key in list(held):
            yield from flush(key)

    return blocks.select("block", "dims", "class", "n", "data").mapInArrow(run, _CELL)


def _probes(asked: DataFrame, trees: int) -> DataFrame:
    """Queries (vec_id, embedding, dims, targets: class, steps) in the cells of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("dims").to_numpy()
            for dims in np.unique(every).tolist():
                some = batch.take(pa.array(np.flatnonzero(every == dims)))
                codes = strings(some.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), trees)
                who, targets = some.column("vec_id").to_numpy(), some.column("targets")
                row = np.repeat(np.arange(len(who)), targets.value_lengths().to_numpy())
                class_, steps = (targets.flatten().field(f).to_numpy() for f in ("class", "steps"))
                for c in np.unique(class_).tolist():
                    mine = class_ == c
                    yield from _in_cells(codes[row[mine]], who[row[mine]], dims, c, steps[mine])

    return asked.where("targets is not null").select("vec_id", "embedding", "dims", "targets").mapInArrow(run, _CELL)


class _Cell:
    """One sorted array of a tree, and what queries find in it."""

    def __init__(self, dims: int, pieces: list[tuple[bytes, bytes]]):
        codes = np.frombuffer(b"".join(p[0] for p in pieces), np.int32)
        numbers = np.frombuffer(b"".join(p[1] for p in pieces), np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.numbers, self.rest = codes[order], numbers[order], sum(_bits(dims)[1:])

    def runs(self, codes: np.ndarray, up: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of the strings that share all but the last `up` bits (the cell at most), and the one after the last."""
        up = np.minimum(up, self.rest)
        low = codes >> up << up
        return np.searchsorted(self.codes, low), np.searchsorted(self.codes, low + (1 << up))


Work = Callable[[int, int, _Cell, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _visit(pieces: DataFrame, work: Work, ddl: str) -> DataFrame:
    """Calls work(dims, class, cell, codes, ids, levels) for the queries that meet rows in a cell."""
    keys = ["dims", "class", "tree", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None
        for batch in batches:
            for *place, kind, codes, numbers, ups in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if place != key:
                    key, held, cell = place, [], None
                if kind == 0:
                    held.append((codes, numbers))
                elif held or cell:
                    if cell is None:
                        cell, held = _Cell(key[0], held), []
                    yield from work(key[0], key[1], cell, np.frombuffer(codes, np.int32), np.frombuffer(numbers, np.int64), np.frombuffer(ups, np.int8))

    return pieces.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, ddl)


def _levels(pieces: DataFrame, classes: DataFrame, trees: int) -> DataFrame:
    """vec_id, targets (class, steps): how many steps of a tree and a bit each query ascends from whole strings."""
    names = [f"n{up}" for up in range(1 + sum(max(1, (2 * a - 1).bit_length()) for a in AXES[1:]))]

    def work(dims: int, class_: int, cell: _Cell, codes: np.ndarray, who: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = [np.subtract(*cell.runs(codes, up)[::-1]).astype(np.int64) for up in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (who, np.full(len(who), dims, np.int32), np.full(len(who), class_, np.int32), *sizes)], ["vec_id", "dims", "class", *names])

    found = _visit(pieces, work, "vec_id long, dims int, class int, " + ", ".join(f"{n} long" for n in names))
    sums = found.groupBy("vec_id", "dims", "class").agg(*(F.sum(n).alias(n) for n in names)).join(classes, ["dims", "class"])
    steps = F.lit((len(names) - 1) * trees)
    for up in reversed(range(len(names))):
        reached = F.col(names[up]) >= F.col("wanted")
        if up:
            below = F.col(names[up - 1])
            part = F.ceil((F.col("wanted") - below) / (F.col(names[up]) - below) * trees)
            steps = F.when(reached, (up - 1) * trees + F.least(part, F.lit(trees))).otherwise(steps)
        else:
            steps = F.when(reached, 0).otherwise(steps)
    return sums.groupBy("vec_id").agg(F.collect_list(F.struct("class", steps.cast("int").alias("steps"))).alias("targets"))


_FOUND = "block long, part int, queries binary, places binary"


def _parted(rows: np.ndarray, who: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a row's number and a query, as pieces for (block, part of the queries)."""
    part = (common.mix64(who) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((who, part, rows >> POS))
    rows, who, part = rows[order], who[order], part[order]
    block = rows >> POS
    place = (rows & (BLOCK - 1)).astype(np.int16)
    cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (part[1:] != part[:-1]), [True]])) if len(rows) else []
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(part[cuts[:-1]].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (who, place))], ["block", "part", "queries", "places"])


def _candidates(pieces: DataFrame, parts: int) -> DataFrame:
    """The rows of the runs, as places in their blocks."""

    def work(dims: int, class_: int, cell: _Cell, codes: np.ndarray, who: np.ndarray, ups: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = cell.runs(codes, ups.astype(np.int32))
        size = b - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        yield from _parted(cell.numbers[at], np.repeat(who, size), parts)

    return _visit(pieces, work, _FOUND)


def _whole(blocks: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """All rows of the blocks (block, dims) for the queries of their dimensions: pieces without places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _parted(batch.column("block").to_numpy() << POS, batch.column("vec_id").to_numpy(), parts):
                yield found.set_column(3, "places", pa.array([b""] * found.num_rows, pa.binary()))

    return blocks.select("block", "dims").join(asked.select("vec_id", "dims"), "dims").select("block", "vec_id").mapInArrow(run, _FOUND)


def _best(who: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids, each at its best score; ties to smaller ids."""
    order = np.lexsort((-scores, who))
    who, scores = who[order], scores[order]
    first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
    who, scores = who[first], scores[first]
    order = np.lexsort((who, -scores))[:k]
    return who[order], scores[order]


_SCORED = "query_id long, vec_id long, score double"
_MET = "block long, part int, kind int, n int, a binary, b binary, c binary"


def _scored(found: DataFrame, blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each block that it meets."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block and query once a task."""
        held: dict[tuple[int, int], list[bytes]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (block, part), queries in held.items():
                who = np.unique(np.frombuffer(b"".join(queries), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), block)), pa.array(np.full(len(who), part, np.int32)), pa.array(who)], ["block", "part", "vec_id"])
            held.clear()

        for batch in batches:
            for block, part, queries in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "queries"))):
                who = np.unique(np.frombuffer(queries, np.int64))
                held.setdefault((block, part), []).append(who.tobytes())
                n += len(who)
                if n > 1 << 23:
                    yield from flush()
                    n = 0
        yield from flush()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in np.split(flat, ends[1:-1])], pa.binary())], ["vec_id", "data"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, queries, hits = None, None, {}, None

        def close() -> Iterator[pa.RecordBatch]:
            if hits is None:
                return
            ids, ends, rows, repeated = block
            out: list[tuple] = []
            for own, row in zip(queries, hits):
                places = np.flatnonzero(row)
                if not len(places):
                    continue
                scores = (rows[places] * queries[own]).sum(1)  # row by row in the same order: equal vectors, equal scores
                fine = np.isfinite(scores)
                places, scores = places[fine], scores[fine]
                if len(places) > k + 1 and not repeated:  # one of them may be the query's own
                    high = scores >= np.partition(scores, -k - 1)[-k - 1]
                    places, scores = places[high], scores[high]
                size = ends[places + 1] - ends[places]
                who = ids[np.repeat(ends[places] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                scores = np.repeat(scores, size)
                who, scores = _best(who[who != own], scores[who != own], k)
                out.append((np.full(len(who), own), who, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for block_no, part, kind, n, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (block_no, part) != key:
                    yield from close()
                    key, block, queries, hits = (block_no, part), None, {}, None
                if kind == 0:
                    ids = np.frombuffer(a, np.int64)
                    block = ids, np.frombuffer(b, np.int32), np.frombuffer(c, np.float64).reshape(n, -1), len(np.unique(ids)) < len(ids)
                elif kind == 1:
                    queries[int(np.frombuffer(a, np.int64)[0])] = np.frombuffer(b, np.float64)
                else:
                    if hits is None:
                        known = np.array(list(queries), np.int64)
                        order = np.argsort(known)
                        hits = np.zeros((len(known), len(block[2])), bool)
                    row = order[np.searchsorted(known[order], np.frombuffer(a, np.int64))]
                    if b:
                        hits[row, np.frombuffer(b, np.int16)] = True
                    else:
                        hits[row] = True
        yield from close()

    def id_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c.split()[0] for c in _MET.split(", ")]
            n, ids = batch.num_rows, batch.column("vec_id").to_numpy().astype(np.int64)
            columns = [batch.column("block"), batch.column("part"), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), batch.column("data"), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    who = found.mapInArrow(met, "block long, part int, vec_id long").distinct()
    who = common.written(who, "ann-met")
    with_vectors = who.join(asked.select("vec_id", "embedding").mapInArrow(packed, "vec_id long, data binary"), "vec_id").select("block", "part", "vec_id", "data").mapInArrow(id_bytes, _MET)
    data = blocks.join(who.select("block", "part").distinct(), "block").select("block", "part", F.lit(0).alias("kind"), "n", F.col("ids").alias("a"), F.col("ends").alias("b"), F.col("data").alias("c"))
    pairs = found.select("block", "part", F.lit(2).alias("kind"), F.lit(None).cast("int").alias("n"), F.col("queries").alias("a"), F.col("places").alias("b"), F.lit(None).cast("binary").alias("c"))
    keys = ["block", "part"]
    every = data.unionByName(with_vectors).unionByName(pairs)
    return every.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(score, _SCORED)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, breadth: float = BREADTH, few: int = FEW, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows found, its own id left out.

    score: inner product in double precision. Ties go to the smaller vec_id. Rows with a null id, and vectors that are null, zero or hold a null or a
    number that is not finite, take no part. A query's candidates are the vectors of as many dimensions as it has. Of repeated
    query ids the least vector asks; a row repeated under one id is found once, at its best score. Fewer than k candidates:
    all. Empty tables give no rows.
    """
    rows = _valid(vectors, id_col, vector_col).distinct()
    most = common.written(rows.groupBy("dims").agg(F.max("size").alias("most"), F.count("*").alias("n")), "ann-dims")
    tasks = max(1, -(-(most.agg(F.sum("n")).first()[0] or 0) // (2 * BLOCK)))
    class_ = F.least(F.floor((F.col("most") - F.col("size")) / float(np.log(RATIO))), F.lit(CLASSES - 1)).cast("int")
    blocks = common.written(_blocks(rows.join(most, "dims").withColumn("class", class_), k, tasks), "ann-blocks")
    classes = common.written(blocks.groupBy("dims", "class").agg(F.sum("n").alias("n")).withColumn("wanted", F.ceil(breadth * F.pow("n", F.lit(0.75)))), "ann-classes")
    large = classes.where(F.col("n") > few)
    least = _valid(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dims", F.size("embedding"))
    targets = large.groupBy("dims").agg(F.collect_list(F.struct("class", F.lit(0).alias("steps"))).alias("targets"))
    asked = common.written(least.join(targets, "dims", "left").select("vec_id", "embedding", "dims", "targets"), "ann-queries")
    parts = max(1, -(-asked.count() // QUERIES))
    total = classes.agg(F.sum("n")).first()[0] or 0
    indexed = blocks.join(F.broadcast(large.select("dims", "class")), ["dims", "class"], "left_semi")  # as many rows as there are classes
    index = common.written(_index(indexed.coalesce(max(1, -(-total // (2 * BLOCK)))), trees), "ann-forest")
    levels = _levels(index.unionByName(_probes(asked, trees)), large, trees)
    risen = common.written(asked.drop("targets").join(levels, "vec_id").select("vec_id", "embedding", "dims", "targets"), "ann-levels")
    small = blocks.join(classes.where(F.col("n") <= few).select("dims", "class"), ["dims", "class"], "left_semi")
    found = common.written(_candidates(index.unionByName(_probes(risen, trees)), parts).unionByName(_whole(small, asked, parts)), "ann-found")
    best = common.written(_ranked(_scored(found, blocks, asked, k), k), "ann-best")
    short = asked.join(best.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k), "vec_id", "left_anti")
    short = common.written(short, "ann-short")
    if not short.take(1):
        return best
    again = _ranked(_scored(common.written(_whole(blocks, short, parts), "ann-found"), blocks, short, k), k)
    return best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*again.columns).unionByName(again)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))

"""Packing of documents into windows of a fixed number of tokens by multiway differencing.

Each document becomes its ids and an end id. Every full window's worth of a long document is a window of its
own; what remains (fewer tokens than a window) is cut evenly into items of at most GRAIN tokens, which balance
far better than items of nearly a window. Items are dealt to k windows by Karmarkar-Karp multiway differencing: a heap holds partial partitions, the two with the greatest imbalance are merged with
their imbalances opposed (fullest slot upon emptiest), until one partition is left, whose windows are nearly
equal. k starts at the least count that could hold the items and rises by one whenever a window exceeds its
capacity.

Items are packed in groups within a task, in the order of arrival: memory is bound by the group. What is too little for a group at the end of a
partition (a group's worth at most) is packed with that of the others in a second pass, so that padding doesn't grow
with the number of partitions; only these pieces are shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordbpe

WINDOW = 2048
END_ID = 1
#: Items that are balanced against each other at once. Waste falls as 1/GROUP, time grows a little.
GROUP = 1024
#: Longest item. On the test documents 512 pads 0.8 %, whole remainders (2048) 1.8 %.
GRAIN = 512

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items to k bins by multiway differencing; for each bin the item numbers. Bins may be empty; without items all are.

    A partial partition keeps its non-empty slots only, fullest first: (sums, nodes). Nodes are items or pairs of
    nodes, so a merge costs the number of its slots and no lists are copied.
    """
    left: list[int] = list(range(len(sizes)))
    right: list[int] = [-1] * len(sizes)
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a_sums, a_nodes = heapq.heappop(heap)
        _, _, b_sums, b_nodes = heapq.heappop(heap)
        over = len(a_sums) + len(b_sums) - k
        if over > 0:  # the last slots of a (least full) take the last of b in reverse: least upon fullest
            cut_a, cut_b = len(a_sums) - over, len(b_sums) - over
            new = np.arange(len(left), len(left) + over)
            left += a_nodes[cut_a:].tolist()
            right += b_nodes[cut_b:][::-1].tolist()
            both = a_sums[cut_a:] + b_sums[cut_b:][::-1]
            sums = np.concatenate([a_sums[:cut_a], both, b_sums[:cut_b]])
            nodes = np.concatenate([a_nodes[:cut_a], new, b_nodes[:cut_b]])
        else:
            sums, nodes = np.concatenate([a_sums, b_sums]), np.concatenate([a_nodes, b_nodes])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, turn, sums, nodes))
        turn += 1
    bins: list[list[int]] = []
    for node in heap[0][3].tolist() if heap else []:
        items, stack = [], [node]
        while stack:
            n = stack.pop()
            if right[n] < 0:
                items.append(n)
            else:
                stack += (right[n], left[n])
        bins.append(items)
    return bins + [[] for _ in range(k - len(bins))]


def windows(sizes: list[int], capacity: int, extra: int = 0) -> list[list[int]]:
    """Near-equal windows that all fit; every size is at most the capacity. Empty windows are left out.

    The first count tried is the least that could hold the items, plus extra.
    """
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity) + extra)
    while True:
        bins = difference(sizes, k)
        if max(sum(sizes[i] for i in b) for b in bins) <= capacity:
            return [b for b in bins if b]
        k += 1


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int | None = END_ID, group: int = GROUP, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents, each with its place in a window.

    doc_id; start: the document's ids before the piece; length; doc_tokens: the document's ids with the end id;
    sequence_id; offset: place in the sequence, gapless from 0; ids: the piece as little-endian unsigned 32-bit words.

    Null or empty text: the end id alone is a piece (without an end id: no piece). Null ids and repeated rows are
    kept, each row as a document of its own. Longer documents are cut at multiples of the window. An empty table
    gives no rows. Other columns are ignored.
    """

    def rows_of(found: list[list[int]], items: list[tuple], size: int, first: int) -> list[tuple]:
        rows = []
        for sequence, members in enumerate(found, first):
            offset = 0
            for i in members:
                doc_id, start, ids, total = items[i]
                rows.append((doc_id, start, ids, total, sequence, offset))
                offset += len(ids) // size
        return rows

    def batch(rows: list[tuple], dtype: np.dtype) -> pa.RecordBatch:
        doc, start, ids, total, seq, offset = zip(*rows)
        words = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in ids]
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([long(doc), long(start), long([len(x) // 4 for x in words]), long(total), long(seq), long(offset), pa.array(words, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    class Groups:
        """Items, packed as soon as there are `group` of them."""

        def __init__(self, dtype: np.dtype, base: int):
            self.dtype, self.sequence = dtype, base
            self.items: list[tuple] = []  # doc_id, start, ids, doc_tokens
            self.rise = 0  # by how much the last group's count exceeded the least one: where the next group starts, less one

        def flush(self) -> list[tuple]:
            sizes = [len(x[2]) // self.dtype.itemsize for x in self.items]
            found = windows(sizes, window, max(0, self.rise - 1))
            self.rise = len(found) + (sum(sizes) // -window)
            rows = rows_of(found, self.items, self.dtype.itemsize, self.sequence)
            self.sequence += len(found)
            self.items.clear()
            return rows

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = wordbpe.encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        size = enc.dtype.itemsize
        groups = Groups(enc.dtype, TaskContext.get().partitionId() << 32)
        for part in common.chunks(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode_batch(part.column("text"))):
                ids += tail
                total = len(ids) // size
                full = total // window * window
                for start in range(0, full, window):
                    rows.append((doc_id, start, ids[start * size : (start + window) * size], total, groups.sequence, 0))
                    groups.sequence += 1
                if rest := total - full:
                    parts = -(-rest // grain)
                    cuts = [full + rest * i // parts for i in range(parts + 1)]
                    groups.items += [(doc_id, a, ids[a * size : b * size], total) for a, b in zip(cuts, cuts[1:])]
                if len(groups.items) >= group:
                    rows += groups.flush()
            if rows:
                yield batch(rows, enc.dtype)
        if groups.items:  # too few for a group: left to the second pass
            yield batch([(*x, None, None) for x in groups.items], enc.dtype)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u4")
        groups = Groups(dtype, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for rows in batches:
            for at in range(0, rows.num_rows, group):
                groups.items += zip(*(rows.column(c).to_pylist()[at : at + group] for c in ("doc_id", "start", "ids", "doc_tokens")))
                if len(groups.items) >= group:
                    yield batch(groups.flush(), dtype)
        if groups.items:
            yield batch(groups.flush(), dtype)

    pieces = common.written(common.id_text(docs, id_col, text_col).mapInArrow(first, SCHEMA), "packing")
    left = pieces.where("sequence_id is null")
    tasks = max(1, left.count() // (8 * group))
    return pieces.where("sequence_id is not null").unionByName(left.repartition(tasks).mapInArrow(second, SCHEMA))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

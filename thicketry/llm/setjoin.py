"""N-gram Jaccard join: which documents' shingle sets are alike, and the components they form.

A document's set holds the hashes of its word shingles. Documents with equal sets are one node. The join is exact:

1. One pass marks the shingles that more than one document has, as bits. A set of n that is alike to another one shares
   ceil(t n) of its shingles with it, so only nodes with that many marked ones go on, with those alone. (The marks are a filter of bounded
   size: where they are full they let more through, and nothing else changes.)
2. Among these, exact document frequencies are counted; shingles of one node alone go nowhere. All sets are ordered by
   (frequency, hash), rarest first. Sets alike to the threshold share one of their first |x| - ceil(t |x|) + 1 shingles,
   so only these are candidates' keys, as (shingle, node, size). Sizes fall into classes, a factor of 1/t each: in each class of a shingle all point to the least node, and
   classes beside each other are linked by one row, if their nearest sizes allow. As many rows as nodes, never all pairs; counts and least nodes are combined
   before the shuffle, and joins on them can be split.
3. Components of these edges are candidate clusters. Whole sets are fetched for their nodes alone, and each cluster is
   searched by T-occurrence with DivideSkip: the short inverted lists of a document's shingles are merged, its long ones are
   probed by binary search for what the merge left, and documents that reach the required overlap are linked. Clusters too large for a task
   are cut by size, and what is still too large into blocks which meet pairwise.

Nodes are 64-bit digests of whole sets: among 10**8 different sets two share one with a chance of 3 in 10**4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words
from .components import components

WORDS = 3
#: Similarity as a fraction, kept in whole numbers.
THRESHOLD = (90, 100)
#: Shingles of a cluster that one task searches at once, 8 bytes each.
CLUSTER = 3_000_000


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted. Texts of fewer words have one shingle, all they have; without words none."""
    hashes, offsets = words.word_hashes(texts)
    found, ends = words.shingles(hashes, offsets, size)
    out = []
    for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        if a < b:
            own = np.sort(found[a:b])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif few := (hashes[offsets[k] : offsets[k + 1]]).tobytes():
            out.append(np.array([xxhash.xxh3_64_intdigest(few, 1)], np.uint64))
        else:
            out.append(found[:0])
    return out


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def overlap(x: int, y: int, t: tuple[int, int]) -> int:
    """Least intersection of sets of these sizes that are alike."""
    return -(-t[0] * (x + y) // (t[0] + t[1]))


def search(sets: list[np.ndarray], t: tuple[int, int] = THRESHOLD, apart: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first one it is connected with by links, by T-occurrence search.

    apart: a side (0 or 1) for each set; with it only sets of different sides are compared.
    """
    m = len(sets)
    root = np.arange(m)
    members: dict[int, list[int]] = {i: [i] for i in range(m)}
    sizes = np.array([len(s) for s in sets])
    rank = np.empty(m, np.int64)
    by_size = np.argsort(sizes, kind="stable")
    rank[by_size] = np.arange(m)
    # inverted lists: for each distinct shingle the sets that hold it, by rising size
    flat = np.concatenate([sets[i] for i in by_size] or [np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(m), sizes[by_size])
    distinct, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    lists, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(distinct)))])
    df = np.diff(starts)
    bounds = np.concatenate([[0], np.cumsum(sizes[by_size])])
    own_tokens = [np.sort(token[a:b]) for a, b in zip(bounds, bounds[1:])]
    side = None if apart is None else apart[by_size]

    for x in range(m):
        n = int(sizes[by_size[x]])
        mine = own_tokens[x]
        need = -(-t[0] * n // t[1])  # with the smallest set that could be alike
        least = int(np.searchsorted(sizes[by_size], need))
        if least >= x:
            continue
        lengths = df[mine]
        rising = np.argsort(lengths, kind="stable")
        total = np.cumsum(lengths[rising])
        short = n - (need - 1)  # with need - 1 lists set apart, one occurrence in the others is required
        if total[short - 1] <= short:
            continue  # all of the short lists hold this set alone
        merge_all = total[-1] * 3e-9
        probe = min(int(total[short - 1]), x - least) * (2e-5 + 5e-8 * need)
        taken = n if merge_all < probe else short
        apart_lists = n - taken
        picked = mine[rising[:taken]]
        spans = df[picked]
        places = np.repeat(starts[picked] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        hits = lists[places]
        hits = hits[(hits >= least) & (hits < x)]
        counts = np.bincount(hits - least, minlength=x - least)
        found = np.flatnonzero(counts >= max(1, need - apart_lists))
        counts, found = counts[found], found + least
        if side is not None:
            other = side[found] != side[x]
            counts, found = counts[other], found[other]
        long = np.sort(mine[rising[taken:]])
        for y, c in zip(found.tolist(), counts.tolist()):
            if root[x] == root[y]:
                continue
            theirs = own_tokens[y]
            if apart_lists:
                at = np.searchsorted(theirs, long)
                at[at == len(theirs)] = 0
                c += int((theirs[at] == long).sum())
            if c >= overlap(n, len(theirs), t):
                a, b = sorted((int(root[x]), int(root[y])))
                for i in members.pop(b):
                    root[i] = a
                    members[a].append(i)
    first = by_size[root]
    return first[rank]


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, tk, node, n_shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            sets = shingle_sets(part.column("text"), size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "tk", "node", "n_shingles"])

    return docs.mapInArrow(run, "doc_id long, tk long, node long, n_shingles long")


def _shared(docs: DataFrame, size: int, total: int) -> np.ndarray:
    """A mark for every shingle that two documents have, as bits: one for each shingle of the corpus, 128 MB at most.

    Documents send 32 bits of each shingle to the range of its first bits; there equal ones are found. Marks set for
    others by chance only cost rows later on, and a shingle without a mark is in one document alone. A range holds some 100,000
    shingles, each once a task, so what one task reads doesn't grow with the corpus until there are 2**24 ranges.
    """
    bits = min(30, max(16, int(total).bit_length()))
    lead = min(bits - 6, max(4, int(total >> 17).bit_length()))  # some 100,000 shingles a range, so that tasks get even shares

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            every, counts = np.unique(np.concatenate(held), return_counts=True)
            every = np.repeat(every, np.minimum(counts, 2))
            cuts = np.searchsorted(every >> np.uint64(64 - lead), np.arange((1 << lead) + 1, dtype=np.uint64))
            short = (every >> np.uint64(32 - lead)).astype(np.uint32)
            used = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([short[cuts[k] : cuts[k + 1]].tobytes() for k in used], pa.binary())], ["lead", "prints"])

        for part in common.chunks(batches):
            held += shingle_sets(part.column("text"), size)
            n += sum(map(len, held[-part.num_rows :]))
            if n > 1_000_000:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def mark(group: pa.Table) -> pa.Table:
        every = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in group["prints"].to_pylist()]))
        twice = every[1:][every[1:] == every[:-1]] >> np.uint32(32 - (bits - lead))
        own = np.zeros(1 << (bits - lead), bool)
        own[twice] = True
        return pa.table({"lead": group["lead"][:1], "marks": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(send, "lead int, prints binary").groupBy("lead").applyInArrow(mark, "lead int, marks binary").toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (bits - lead - 3)
    for k, x in zip(found["lead"].to_pylist(), found["marks"].to_pylist()):
        out[k * step : (k + 1) * step] = np.frombuffer(x, np.uint8)
    return out


def _prefix(n: int, known: int, t: tuple[int, int]) -> int:
    """How many of a set's `known` shared shingles, rarest first, are keys: the n - known others come before them and meet no other set."""
    return n + t[0] * n // -t[1] + 1 - (n - known)


def _keys(docs: DataFrame, marks: np.ndarray, size: int, t: tuple[int, int]) -> DataFrame:
    """shingle, node, size: the keys by which candidates meet."""
    repeated = docs.sparkSession.sparkContext.broadcast(marks)
    shift = np.uint64(64 - (len(marks).bit_length() + 2))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in common.chunks(batches):
            held, nodes, sizes = [], [], []
            for own in shingle_sets(part.column("text"), size):
                n = len(own)
                if not n or (node := node_of(own)) in seen:
                    continue
                seen.add(node)
                spot = (own >> shift).astype(np.int64)
                own = own[(repeated.value[spot >> 3] >> (spot & 7).astype(np.uint8) & np.uint8(1)).astype(bool)]
                if _prefix(n, len(own), t) > 0:
                    held.append(own)
                    nodes.append(node)
                    sizes.append(n)
            if held:
                each = [len(x) for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).astype(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["shingle", "node", "size"])

    rows = common.written(docs.select("text").mapInArrow(shared, "shingle long, node long, size int"), "shared-shingles")
    df = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    rarest = Window.partitionBy("node").orderBy("df", "shingle")  # a node may come from several tasks: equal rows have one rank
    ranked = rows.join(df.select("shingle", "df"), "shingle").withColumn("rank", F.dense_rank().over(rarest))
    known = ranked.withColumn("known", F.max("rank").over(Window.partitionBy("node")))
    keys = common.written(known.where(f"rank <= known + 1 - ({t[0]}L * size + {t[1] - 1}) div {t[1]}").select("shingle", "node", "size"), "join-keys")
    common.discard(rows)
    common.free(docs.sparkSession)
    return keys


def _class(size: Column, t: tuple[int, int]) -> Column:
    """Sets alike lie in one class of size or in neighbouring ones."""
    return F.floor(F.log(size) / float(np.log(t[1] / t[0]) * 1.0001)).cast("int")


def _edges(keys: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Edges (a, b) that hold every candidate cluster together."""
    rows = keys.withColumn("class", _class(F.col("size"), t))
    group = ["shingle", "class"]
    heads = rows.groupBy(*group).agg(F.min("node").alias("head"), F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("n"))
    heads = common.written(heads, "join-heads")
    inside = rows.join(heads.where("n > 1").select(*group, "head"), group).where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    after = heads.select("shingle", (F.col("class") - 1).alias("class"), F.col("head").alias("b"), F.col("least").alias("next"))
    beside = heads.join(after, group).where((F.col("most").cast("long") * t[1] >= F.col("next").cast("long") * t[0]) & (F.col("head") != F.col("b"))).select(F.col("head").alias("a"), "b")
    return inside.unionByName(beside).distinct()


def _bitmap(nodes: DataFrame, bits: int = 23) -> np.ndarray:
    """Marks of the nodes' low bits, made in the cluster: at most 2**bits / 8 bytes. Marks of other nodes only cost a join."""
    low = nodes.select((F.col("node").bitwiseAND((1 << bits) - 1)).alias("low"))
    words_ = low.groupBy(F.shiftright("low", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 31 as int))")).alias("marks")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words_["word"].to_numpy()] = words_["marks"].to_numpy().astype(np.uint32)
    return out


def _deal(clusters: DataFrame, nodes: DataFrame, t: tuple[int, int], limit: int) -> DataFrame:
    """node, component, part, i, j, side: where each node of a cluster is searched.

    Sets alike lie in one or in neighbouring classes of size (a factor of 1/t each). A cluster's classes, in order, form parts of
    about `limit` shingles; the last class of a part also visits the next one. A part that is larger still is cut into blocks by hash, and blocks meet
    pairwise. Only numbers move here, one row a node.
    """
    own = clusters.join(nodes.select("node", F.col("n_shingles").alias("n")).distinct(), "node").withColumn("class", _class(F.col("n"), t))
    own = common.written(own, "cluster-nodes")
    weights = own.groupBy("component", "class").agg(F.sum("n").alias("weight"))
    before = Window.partitionBy("component").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # a row a class
    parts = weights.withColumn("part", F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0)) / limit).cast("int"))
    after = parts.select("component", (F.col("class") - 1).alias("class"), F.col("part").alias("next"))
    parts = parts.join(after, ["component", "class"], "left").withColumn("parts", F.when(F.col("next") != F.col("part"), F.array("part", "next")).otherwise(F.array("part")))
    placed = own.join(parts.select("component", "class", "parts"), ["component", "class"]).select("node", "component", "n", F.explode("parts").alias("part"))
    placed = common.written(placed, "cluster-parts")
    blocks = placed.groupBy("component", "part").agg(F.ceil(F.sum("n") / limit).cast("int").alias("blocks"))
    placed = placed.join(blocks, ["component", "part"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return other.select("node", "component", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def _links(docs: DataFrame, clusters: DataFrame, nodes: DataFrame, size: int, t: tuple[int, int], limit: int) -> DataFrame:
    """Edges (a, b) between linked nodes that connect what is linked."""
    bits = 23
    marks = docs.sparkSession.sparkContext.broadcast(_bitmap(clusters, bits))
    deal = common.written(_deal(clusters, nodes, t, limit), "cluster-deal")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in common.chunks(batches):
            rows = []
            for own in shingle_sets(part.column("text"), size):
                node = node_of(own)
                low = node & ((1 << bits) - 1)
                if len(own) and marks.value[low >> 5] >> np.uint32(low & 31) & np.uint32(1) and node not in seen:
                    seen.add(node)
                    rows.append((node, own.tobytes()))
            if rows:
                node, own = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(own, pa.binary())], ["node", "own"])

    sets = docs.select("text").mapInArrow(fetch, "node long, own binary")
    dealt = sets.join(deal, "node").select("component", "part", "i", "j", "side", "node", "own")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def linked() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            nodes = np.array(list(held), np.int64)
            side = np.array([s for s, _ in held.values()]) if key[2] != key[3] else None
            first = search([x for _, x in held.values()], t, side)
            more = np.flatnonzero(first != np.arange(len(nodes)))
            if not len(more):
                return None
            return pa.RecordBatch.from_arrays([pa.array(nodes[first[more]]), pa.array(nodes[more])], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for c, part, i, j, side, node, own in zip(*(x.to_pylist() for x in batch.slice(at, 512).columns)):
                    if (c, part, i, j) != key:
                        if (out := linked()) is not None:
                            yield out
                        key, held = (c, part, i, j), {}
                    held[node] = (side, np.frombuffer(own, np.uint64))
        if (out := linked()) is not None:
            yield out

    keys = ["component", "part", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(find, "a long, b long")


def _joined(docs: DataFrame, size: int, threshold: tuple[int, int], limit: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tk (hash of the text), n_shingles, node, component (a node; null without shingles), component_id."""
    texts = common.id_text(docs, id_col, text_col).withColumn("tk", F.xxhash64("text"))
    nodes = common.written(_profile(texts, size), "profile")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    marks = _shared(texts, size, total)
    common.free(docs.sparkSession)
    keys = _keys(texts, marks, size, threshold)
    clusters = components(_edges(keys, threshold))
    clusters = common.written(clusters, "clusters")
    common.discard(keys)
    common.free(docs.sparkSession)
    linked = components(_links(texts, clusters, nodes, size, threshold, limit))
    some = nodes.where("n_shingles > 0").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    some = common.written(some, "nodes")
    least = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = some.join(least, "component").select("doc_id", "tk", "n_shingles", "node", "component", "component_id")
    none = nodes.where("n_shingles = 0").select("doc_id", "tk", "n_shingles", "node", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none)


def join(docs: DataFrame, size: int = WORDS, threshold: tuple[int, int] = THRESHOLD, limit: int = CLUSTER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (equal for equal sets), component_id: the least doc_id reachable by links.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing; their component is their own id.
    Every row keeps its place: repeated rows are copies in one component, a null id never names one (a component of null ids
    alone has a null id). An empty table gives no rows. Other columns are ignored.
    """
    return _joined(docs, size, threshold, limit, id_col, text_col).select("doc_id", "n_shingles", "node", "component_id")


def representatives(docs: DataFrame, size: int, threshold: tuple[int, int], limit: int = CLUSTER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the least id (of its texts there, the one of the least hash); the same columns.

    Documents without shingles or without an id stay. Of equal rows (id and text) one stays. Different texts under one id
    are different documents: each stays unless its own component has another one. An empty table gives no rows.
    """
    every = common.written(_joined(docs, size, threshold, limit, id_col, text_col).select("doc_id", "tk", "component", "component_id"), "joined")
    common.free(docs.sparkSession)
    # a document stays where it lies if its id is its own and no smaller one is linked with it
    alone = (F.count("*") == 1) & F.min(F.col("doc_id") == F.col("component_id"))
    others = every.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(alone.alias("alone")).where("not alone")
    rows = every.where("doc_id = component_id")
    first = rows.where("component is not null").groupBy("component", F.col("doc_id").alias("__id")).agg(F.min("tk").alias("__key")).select("__id", "__key")
    first = first.unionByName(rows.where("component is null").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__key"))).distinct()
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    keys = ["__id", "__key"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no name of theirs clashes
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), key.alias("__key"), whole.alias("__row"))
    keyed = common.marked(keyed, others)
    kept = keyed.where("__marked").join(first, keys, "left_semi").dropDuplicates(keys)
    return kept.unionByName(keyed.where("not __marked")).select("__row.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")

"""Operators on token ids: files, byte-level BPE, packing."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from thicketry.llm import bytebpe, common, packing, tokenfile, wordbpe

WORD = common.tokenizer_path("word_bpe_49k.json")
RANKS = common.tokenizer_path("byte_bpe_multi_50k.tiktoken")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    return t


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def texts(rows):
    return [t or "" for _, t in rows]


def test_cached_encoder_equals_library(edge_rows):
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\t\xa0\x1c\x85aB'sé1.日Σ́<|endoftext|>") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    every = texts(edge_rows) + odd + ["<|endoftext|> x<|startoftext|>", "don't I'LL we've 's't"]
    lib = library()
    wanted = [np.asarray(e.ids, "<u2").tobytes() for e in lib.encode_batch(every, add_special_tokens=False)]
    enc = wordbpe.WordEncoder(WORD)
    assert enc.encode_batch(pa.array(every)) == wanted
    assert enc.encode_batch(pa.array(every)) == wanted  # now from the table
    small = wordbpe.WordEncoder(WORD, capacity=50)  # emptied again and again
    for at in range(0, len(every), 5):
        assert small.encode_batch(pa.array(every[at : at + 5])) == wanted[at : at + 5]


def test_one_text_with_more_chunks_than_slots():
    text = " ".join(f"w{i}" for i in range(5000))
    want = np.asarray(library().encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    small = wordbpe.WordEncoder(WORD, capacity=20)
    for _ in range(2):
        assert small.encode_batch(pa.array([text, "w1 w2", text])) == [want, np.asarray(library().encode("w1 w2", add_special_tokens=False).ids, "<u2").tobytes(), want]


def test_a_table_takes_room_for_what_it_holds():
    from thicketry.llm.idcache import IdCache

    assert len(IdCache(2_000_000, np.dtype("<u2")).keys) <= 1 << 16
    enc = wordbpe.WordEncoder(WORD)
    text = " ".join(f"w{i}" for i in range(70_000))  # more than the first slots
    want = np.asarray(library().encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert [enc.encode_batch(pa.array([text])) for _ in range(2)] == [[want], [want]]
    assert len(enc.cache.keys) > 70_000


def test_what_a_task_freed_goes_back_before_the_next_one():
    import re

    from thicketry.llm import common

    def own_mb() -> float:
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024

    held = [np.ones(2000) for _ in range(10_000)]  # 160 MB in small pieces
    held = held[::100]
    before = own_mb()
    assert list(common.chunks([])) == []
    assert own_mb() < before - 100 and len(held) == 100


def test_chunks_of_one_hash_keep_their_ids(monkeypatch, edge_rows):
    from thicketry.llm import words

    whole = words.span_hashes
    monkeypatch.setattr(words, "span_hashes", lambda *a: whole(*a) & np.uint64(7))
    every = texts(edge_rows[:6] + edge_rows[9:]) + [" ".join(f"w{i}" for i in range(200))]
    wanted = [np.asarray(e.ids, "<u2").tobytes() for e in library().encode_batch(every, add_special_tokens=False)]
    enc = wordbpe.WordEncoder(WORD, capacity=300)
    for _ in range(3):
        assert enc.encode_batch(pa.array(every)) == wanted


def test_token_files(spark, edge, edge_rows, none):
    folder = common.shared_dir(spark, "t")
    manifest = tokenfile.write_tokens(edge, WORD, folder, length=16, file_tokens=500)
    got = [tuple(r) for r in tokenfile.read_tokens(manifest).orderBy("start").collect()]
    lib = library()
    rows = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (d, s, n, ids), (want_d, text) in zip(got, rows, strict=True):
        want = lib.encode(text or "", add_special_tokens=False).ids + [1]
        assert (d, s, n) == (want_d, start, len(want))
        assert np.frombuffer(ids, "<u4").tolist() == want
        start += n
    total = 0
    for r in manifest.collect():
        f = tokenfile.SequenceFile(r["path"])
        assert all(len(f.sequence(i)) == len(f.mask(i)) == 16 for i in range(len(f)))
        assert not f.sequence(0).flags.owndata  # a view of the map
        assert sum(int(f.mask(i).sum()) for i in range(len(f))) == r["n_tokens"]
        total += r["n_tokens"]
    assert total == start
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, WORD, common.shared_dir(spark, "t"))).count() == 0


def test_byte_bpe_equals_tiktoken(edge_rows):
    import public_tokenizers
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    odd = ["".join(rng.choice(" \n\t\xa0\r\x0bab'sé1.日") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    every = texts(edge_rows) + odd + ["ab" * 400, "  x", "x  ", "\n\n", "a\xa0\xa0 b"]
    enc = bytebpe.ByteEncoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(2):
        found = enc.encode_batch(pa.array(every))
        assert [x.tolist() for x in found] == [lib.encode_ordinary(t) for t in every]
    assert all(enc.decode(x) == t.encode() for x, t in zip(found, every))


def test_both_trees_agree():
    import public_tokenizers

    enc = bytebpe.ByteEncoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(7)
    pieces = [bytes(rng.choice(b"aabcdeth ing") for _ in range(rng.randint(1, 200))) for _ in range(200)] + [b"aaaa" * 50, b"x"]
    assert [x.tolist() for x in enc.merge(pieces)] == [enc.merge_long(p) for p in pieces]


def test_byte_bpe_rows(spark, edge, none, edge_rows):
    import public_tokenizers

    rows = bytebpe.encode(edge, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted(t.encode() for t in texts(edge_rows))
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert bytebpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_differencing_keeps_items_and_balances():
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 400):
        sizes = [rng.randint(1, 512) for _ in range(n)]
        found = packing.windows(sizes, 2048)
        assert sorted(i for w in found for i in w) == list(range(n))
        sums = [sum(sizes[i] for i in w) for w in found]
        assert max(sums, default=0) <= 2048
        if n == 400:
            assert max(sums) - min(sums) < 40 and len(found) <= -(-sum(sizes) // 2048) + 2
    assert len(packing.windows([2048, 2048, 1], 2048)) == 3
    assert len(packing.windows([1500, 1500, 1500], 2048)) == 3  # the count rises where two would hold the sum


def test_packing(spark, edge, edge_rows, none):
    lib = library()
    pieces = packing.pack(edge, WORD, window=256).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["length"] * 4 == len(p["ids"]) and p["length"] > 0
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
    for d in {d for d, _ in edge_rows}:
        want = [np.asarray(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in edge_rows if i == d]
        joined = sorted(by_doc[d])
        if len(want) == 1:
            assert b"".join(x for _, x, _ in joined) == want[0]
            assert {n for *_, n in joined} == {len(want[0]) // 4}
        else:
            assert sum(len(x) for _, x, _ in joined) == sum(map(len, want))
    assert packing.pack(none, WORD).count() == 0


def test_padding_does_not_grow_with_partitions(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    for n in (1, 211):
        rows = packing.pack(docs.repartition(n), WORD).selectExpr("length", "sequence_id").collect()
        used = sum(r["length"] for r in rows)
        assert len({r["sequence_id"] for r in rows}) * 2048 < 1.02 * used


def test_packing_query_holds_its_contract(spark):
    lib = library()
    docs = {r["doc_id"]: lib.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.op4_packing(spark, "/root/testdata/sf0.001").collect():
        own = docs[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, size in [(v, len(docs[k])) for k, v in by_doc.items()] + [(v, None) for v in by_sequence.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == size if size is not None else at <= 2048
    assert by_doc.keys() == docs.keys()


def test_byte_bpe_query_equals_tiktoken(spark):
    import hashlib

    import public_tokenizers
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    rows = bytebpe.op3_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("name", ["op1_token_files", "op3_byte_bpe", "op4_packing"])
def test_queries_read_every_document(spark, name):
    from thicketry.llm.catalog import QUERIES

    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r["doc_id"] for r in rows} == {r[0] for r in docs.select("doc_id").collect()}
    if name == "op1_token_files":
        lib = library()
        start = 0
        by_id = {r["doc_id"]: r for r in rows}
        for d, t in sorted(map(tuple, docs.select("doc_id", "text").collect())):
            ids = lib.encode(t, add_special_tokens=False).ids + [1]
            assert (by_id[d]["start"], by_id[d]["n_tokens"], by_id[d]["ids_crc32"]) == (start, len(ids), crc(ids))
            start += len(ids)

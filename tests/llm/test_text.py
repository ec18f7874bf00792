"""Fingerprints, similarity join, passages, shards, and the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from thicketry.llm import common, digest, passages, setjoin, sharding

SMALL = "/root/testdata/sf0.001"


# Fingerprints


def test_canonical_form():
    assert digest.canonical("  Ａ B\n\tc ") == "a b c"
    assert digest.fingerprint("Straße") == digest.fingerprint("STRASSE")
    assert digest.fingerprint("é") == digest.fingerprint("é")
    assert digest.fingerprint("ab") != digest.fingerprint("a b")


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), digest.fingerprint(t), digest.fingerprint(e), float(digest.fingerprint(t) == digest.fingerprint(e)), float(digest.fingerprint(t) == digest.fingerprint(after))))
    return out


def test_edit_test(spark, edge, edge_rows, none):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, digest.edit_test(edge).collect()), key=key) == sorted(edited(edge_rows), key=key)
    assert digest.edit_test(none).count() == 0
    one = spark.createDataFrame([(7, "abcd")], "doc_id long, text string")
    assert [tuple(r) for r in digest.edit_test(one).collect()] == edited([(7, "abcd")])
    docs = common.table(spark, SMALL, "documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = digest.op7_digest(spark, SMALL).collect()
    assert sorted(tuple(r)[:7] for r in map(lambda r: [r[c.split()[0]] for c in digest.EDITED.split(", ")], rows)) == sorted(edited(texts))
    groups = defaultdict(list)
    for d, text in texts:
        groups[digest.canonical(text)].append(d)
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows} == {d: (min(g), len(g)) for g in groups.values() for d in g}
    assert any(len(g) > 1 for g in groups.values())


def test_exact_groups(edge):
    rows = {(r["doc_id"], r["class_id"], r["class_size"]) for r in digest.exact_groups(edge).collect()}
    assert {(0, 0, 3), (4, 0, 3), (1, 1, 3), (2, 1, 3), (3, 1, 3), (None, None, 1)} <= rows


def test_one_fingerprint_of_different_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A  B"), (3, "c"), (4, "c"), (5, "d"), (None, "e"), (6, "xy")], "doc_id long, text string")
    wanted = {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1), None: (None, 1), 6: (6, 1)}
    for digest_of in (digest._digest, lambda form: f"{len(form):032x}"):  # the second gives c, d and e one fingerprint
        rows = digest.exact_groups(df, digest=digest_of).collect()
        assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows} == wanted and len(rows) == 7


# Similarity join


def brute_join(rows, size, t):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    lists = defaultdict(list)
    for k, x in enumerate(sets):
        both = Counter(y for g in x for y in lists[g])
        for y, n in both.items():
            if t[1] * n >= t[0] * (len(x) + len(sets[y]) - n):
                up[top(k)] = top(y)
        for g in x:
            lists[g].append(k)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    return sorted(((d, len(sets[k]), least.get(top(k))) for k, (d, _) in enumerate(rows)), key=str)


def joined(df, *args, **more):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.join(df, *args, **more).collect()), key=str)


def test_join_edges(edge, edge_rows, none):
    assert joined(edge) == brute_join(edge_rows, 3, (90, 100))
    assert joined(none) == []


@pytest.mark.parametrize("limit", [3_000_000, 800])
def test_join_equals_brute_force(spark, limit):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(12)]
    common_part = [rng.choice(words) for _ in range(15)]
    rows = []
    for i in range(150):
        w = list(base[i % 12]) + (common_part if i % 3 == 0 else [])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, t in ((3, (90, 100)), (5, (80, 100))):
        wanted = brute_join(rows, size, t)
        assert joined(df, size, t, limit) == wanted
        assert 1 < len({c for *_, c in wanted}) < 150


def test_search_equals_brute_force_with_sides():
    rng = np.random.default_rng(4)
    sets = []
    for k in range(80):
        own = np.unique(rng.integers(0, 40 if k % 2 else 4000, 30)).astype(np.uint64)
        sets.append(own)
        if k % 4 == 0:
            sets.append(own[: len(own) - rng.integers(0, 3)])
    for t in ((90, 100), (80, 100), (50, 100)):
        for sides in (None, np.arange(len(sets)) % 2):
            up = list(range(len(sets)))
            for i in range(len(sets)):
                for j in range(i):
                    if sides is not None and sides[i] == sides[j]:
                        continue
                    n = len(np.intersect1d(sets[i], sets[j]))
                    if t[1] * n >= t[0] * (len(sets[i]) + len(sets[j]) - n):
                        a, b = up[i], up[j]
                        up = [b if x == a else x for x in up]
            found = setjoin.search(sets, t, sides)
            groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == x)) for x in set(labels)}
            assert groups(up) == groups(found.tolist())


def test_representatives(edge):
    kept = setjoin.representatives(edge, 5, (80, 100))
    assert kept.columns == edge.columns and {r["__id"] for r in kept.collect()} == {1}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, None, 5, 6, 7, 8, 9, 10, 11, 12, 13], key=str)


def test_representatives_of_texts_under_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (3, b.upper()), (4, None), (4, ""), (None, a), (5, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, setjoin.representatives(df, 5, (80, 100)).collect()), key=str)
    assert found == sorted([(1, a), (2, b), (4, None), (None, a), (5, "x y")], key=str) or found == sorted([(1, a), (2, b), (4, ""), (None, a), (5, "x y")], key=str)


def test_join_query_equals_brute_force(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in setjoin.op8_ngram_join(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert found == brute_join(rows, 3, (90, 100))


# Passages


def test_compact_windows_equal_definition():
    rng = np.random.default_rng(1)
    lengths = [0, 3, 40, 7, 25]
    hashes = rng.integers(1, 1000, sum(lengths)).astype(np.uint64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    l, c, r = passages.compact_windows(hashes, offsets, 6)
    got = {(a, b): set() for a, b in zip(offsets, offsets[1:])}
    for x, y, z in zip(l.tolist(), c.tolist(), r.tolist()):
        assert hashes[x : z + 1].min() == hashes[y] and z - x + 1 >= 6
        got[next(k for k in got if k[0] <= y < k[1])].add((x, y, z))
    for (a, b), found in got.items():
        covered = {(i, j) for i in range(a, b) for j in range(i + 5, b) if any(x <= i <= y <= j <= z for x, y, z in found)}
        assert covered == {(i, j) for i in range(a, b) for j in range(i + 5, b)}


def planted(n_docs=40, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    near = list(passage)
    near[8] = "changed"
    rows = []
    for i in range(n_docs):
        own = [word() for _ in range(120)]
        at = rng.randint(0, 120)
        middle = passage if i % 4 == 0 else near if i % 4 == 1 and i > 4 else []
        rows.append((i, " ".join(own[:at] + middle + own[at:]), at, len(middle)))
    return rows


def test_planted_passages(spark):
    rows = planted()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    found = defaultdict(list)
    for r in passages.repeats(df).collect():
        found[r["doc_id"]].append(r)
    for i, _, at, n in rows:
        if n and i:
            assert sum(r["n_words"] for r in found[i]) == n, i
            assert min(r["start"] for r in found[i]) == at and all(r["source_id"] < i for r in found[i])
        else:
            assert not found[i], i
    left = {r["doc_id"]: r["text"] for r in passages.remove(df).collect()}
    for i, text, at, n in rows:
        w = text.split()
        assert left[i].split() == (w if not n or not i else w[:at] + w[at + n :])


def test_passages_cover_all_exact_repeats(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r["doc_id"], r["text"].encode().lower().split()) for r in docs.select("doc_id", "text").collect())
    first, wanted = {}, {}
    for i, w in rows:
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - passages.MIN_WORDS + 1):
            if first.setdefault(tuple(w[k : k + passages.MIN_WORDS]), i) < i:
                hit[k : k + passages.MIN_WORDS] = True
        wanted[i] = hit
    found = {i: np.zeros(len(w), bool) for i, w in rows}
    for r in passages.op5_passages(spark, "/root/testdata/sf0.01").collect():
        found[r["doc_id"]][r["start"] : r["start"] + r["n_words"]] = True
        assert r["similarity"] >= 0.8
    assert sum(h.any() for h in wanted.values()) > 50
    assert all((found[i] >= wanted[i]).all() for i in wanted)


def test_passages_edges(edge, none, spark):
    assert passages.repeats(edge).count() == 0  # short texts, and one row repeated under its id
    kept = passages.remove(edge, count_col=None)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert passages.repeats(none).count() == 0 and passages.remove(none, count_col=None).count() == 0
    text = " ".join(f"x{i}" for i in range(80))
    copies = spark.createDataFrame([(2, text, 9), (1, text, 9), (3, text + " more", 9)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, passages.remove(copies).collect())) == [(1, text, 9), (3, "more", 4)]


def test_passages_behind_boilerplate(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows, wanted = [], {}
    for k in range(40):
        common_part, before, after = some(rng.randint(44, 48)), some(rng.randint(0, 3)), some(rng.randint(6, 8))
        for j in range(4):  # the first and the third hold the common part alone, the others the same words around it
            own, more = some(80), j in (1, 3)
            middle = before + common_part + after if more else common_part
            at = rng.randint(0, 80)
            rows.append((4 * k + j, " ".join(own[:at] + middle + own[at:])))
            if j == 3:
                wanted[4 * k + j] = (at, len(middle), 4 * k + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["start"], r["n_words"], r["source_id"]) for r in passages.repeats(df).collect()}
    assert found == wanted


@pytest.mark.parametrize("kind", ["changed", "inserted", "dropped"])
def test_passages_with_one_edit_anywhere(spark, kind):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, wanted = [], {}
    for n in (50, 54, 60):
        for at in range(5, n - 5):
            passage = [word() for _ in range(n + (kind == "dropped"))]
            edit = passage[:at] + {"changed": [word()], "inserted": [word(), passage[at]], "dropped": []}[kind] + passage[at + 1 :]
            i = len(rows)
            for text in (passage, edit):
                rows.append((len(rows), " ".join([word() for _ in range(60)] + text + [word() for _ in range(60)])))
            wanted[i + 1] = (60, len(edit), i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["start"], r["n_words"], r["source_id"]) for r in passages.repeats(df).collect()}
    assert found == wanted


def test_passages_behind_their_parts(spark):
    """Two long pieces of a passage apart, the passage, the pieces again, the passage: the last repeats the second."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows = []
    for _ in range(60):
        p = some(60)
        for whole in (False, True, False, True):
            middle = p if whole else p[:49] + some(30) + p[11:]
            rows.append((len(rows), " ".join(some(40) + middle + some(40))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = defaultdict(list)
    for r in passages.repeats(df).collect():
        found[r["doc_id"]].append(r)
    for i in range(3, 240, 4):
        assert sum(r["n_words"] for r in found[i]) == 60 and min(r["start"] for r in found[i]) == 40


@pytest.mark.parametrize("n, changes", [(60, 1), (100, 2), (150, 3), (300, 5)])
def test_recall_of_near_passages(spark, n, changes):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows = []
    for _ in range(100):
        p = some(n)
        edit = list(p)
        for k in range(changes):
            edit[n * (k + 1) // (changes + 1)] = word()
        rows += [(len(rows) + k, " ".join(some(50) + x + some(50))) for k, x in enumerate((p, edit))]
    covered = Counter()
    for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert r["source_id"] == r["doc_id"] - 1 and r["start"] >= 50 and r["start"] + r["n_words"] <= 50 + n
        covered[r["doc_id"]] += r["n_words"]
    assert sum(covered[i] >= 0.9 * n for i in range(1, 200, 2)) >= 95


def test_near_passages_around_a_line_of_many(spark):
    """A line in more documents than a group holds whole; near repeats that contain it are found all the same."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    line = some(30)
    texts = [some(30) + line + some(30) for _ in range(1500)]
    for _ in range(50):
        p = some(15) + line + some(15)
        edit = list(p)
        edit[rng.choice([*range(5, 15), *range(45, 55)])] = word()
        texts += [some(30) + p + some(30), some(30) + edit + some(30)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    covered = Counter()
    for r in passages.repeats(df).collect():
        assert r["doc_id"] >= 1500 and r["doc_id"] % 2 and r["source_id"] == r["doc_id"] - 1
        covered[r["doc_id"]] += r["n_words"]
    assert sum(covered[i] >= 54 for i in range(1501, 1600, 2)) >= 45


@pytest.mark.parametrize("more", [{}, {"block": 200}])
def test_a_line_of_many_hides_no_near_passage(spark, more):
    """What is found among a few documents is found as well among many that share a line with them, in one block or in several."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    line = some(30)
    texts = []
    for _ in range(100):
        p = some(15) + line + some(15)
        edit = list(p)
        edit[rng.choice([*range(5, 15), *range(45, 55)])] = word()
        texts += [some(30) + p + some(30), some(30) + edit + some(30)]
    few = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    many = spark.createDataFrame([(1000 + i, " ".join(some(30) + line + some(30))) for i in range(1500)], "doc_id long, text string").repartition(4)

    def covered(df, **how):
        return {(r["doc_id"], k) for r in passages.repeats(df, **how).collect() for k in range(r["start"], r["start"] + r["n_words"])}

    wanted = covered(few)
    assert len({i for i, _ in wanted}) > 90
    assert covered(few.unionByName(many), **more) == wanted


def test_a_late_member_is_compared_after_its_first_match():
    """The first of 200 members has the right half of the last one, another has the left half: both count."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    middle = passages.WIDTH - 1
    rows = rng.integers(1, 1 << 32, (200, passages._SPAN)).astype(np.uint32)
    rows[:, middle] = 5
    rows[0, middle:], rows[50, : middle + 1] = rows[199, middle:], rows[199, : middle + 1]
    schema = passages._numbers(passages._AROUND)
    columns = zip(*((7, 0, i, 0, 1000, 1000 - middle, x.tobytes()) for i, x in enumerate(rows)))
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)
    found = {(r["doc_id"], r["source_id"]) for b in passages._compare(iter([batch])) for r in b.to_pylist()}
    assert found == {(199, 0), (199, 50)}


@pytest.mark.parametrize("sides", [False, True])
def test_index_covers_what_all_pairs_cover(sides):
    """Members of several templates with edits, two windows of a document overlapping, one token in long stretches."""
    rng = np.random.default_rng(6)
    span, middle = passages._SPAN, passages.WIDTH - 1
    templates = rng.integers(2, 1 << 32, (4, span + 40)).astype(np.uint32)
    templates[1, 20:70] = templates[2, 30:90] = 1
    doc, c, matrix = [], [], []
    for i in range(300):
        text = templates[rng.integers(4)].copy()
        for at in rng.integers(0, len(text), rng.integers(0, 5)):
            text[at : at + 5] = rng.integers(2, 1 << 32, len(text[at : at + 5]))
        for shift in sorted(rng.choice(30, 2, replace=False).tolist()):
            doc.append(i)
            c.append(100 + shift)
            matrix.append(text[shift : shift + span].copy())
            matrix[-1][middle] = 1
            if rng.random() < 0.3:
                matrix[-1][: rng.integers(0, 40)] = 0
    doc, c, matrix = np.array(doc), np.array(c), np.array(matrix)
    side = doc % 2 if sides else None
    index, every = (passages._Index(doc, np.zeros(600, np.int32), c, matrix, side) for _ in range(2))
    found = sum(len(x[0]) for x in index.run())
    i, j = np.nonzero(doc[:, None] > doc[None])
    keep = np.full(len(i), True) if side is None else side[i] != side[j]
    every.compare(i[keep], j[keep])
    assert every.covered.sum() > 5000 and (index.covered == every.covered).all()
    assert found < 0.5 * sum(len(x[0]) for x in every.found)


def test_lists_of_a_large_group_are_read_once(monkeypatch):
    """Members of four templates with words of their own, which nobody else has: a row's candidates are sought once, and only those that may add are compared."""
    rng = np.random.default_rng(8)
    span, middle = passages._SPAN, passages.WIDTH - 1
    matrix = rng.integers(2, 1 << 32, (4, span)).astype(np.uint32)[rng.integers(0, 4, 400)]
    for i in range(400):
        for at in rng.integers(0, span, 3):
            matrix[i, at : at + 5] = rng.integers(2, 1 << 32, len(matrix[i, at : at + 5]))
    matrix[:, middle] = 1
    asked, compared, plain, pairs = Counter(), [], passages._Index._hits, passages._Index.compare
    monkeypatch.setattr(passages._Index, "_hits", lambda self, i, columns: (asked.update([i]), plain(self, i, columns))[1])
    monkeypatch.setattr(passages._Index, "compare", lambda self, i, j: (compared.append(len(i)), pairs(self, i, j))[1])
    doc = np.arange(400)
    index, every = (passages._Index(doc, np.zeros(400, np.int32), np.full(400, 100), matrix, None) for _ in range(2))
    index.run()
    i, j = np.nonzero(doc[:, None] > doc[None])
    pairs(every, i, j)
    assert every.covered.sum() > 5000 and (index.covered == every.covered).all()
    assert max(asked.values()) <= 2 and sum(compared) < 15000


def test_pipeline_sends_a_text_to_workers_once(spark, monkeypatch):
    import corpus_pipeline

    text = " ".join(f"x{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "a", 9), (2, text + " more", "b", 9)], "doc_id long, text string, extra string, n_chars long")
    seen, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: (seen.append(self.schema), plain(self, *a, **k))[1])
    out = corpus_pipeline.cut_repeats(spark, df, "")
    assert sorted(map(tuple, out.collect())) == [(1, text, "a", 9), (2, "more", "b", 4)] and out.columns == df.columns
    rows = [x["__row"].dataType.names for x in seen if "__row" in x.names]
    assert rows == [["doc_id", "extra", "n_chars"]]


def test_cutting_moves_a_row_once(spark):
    """One join deals rows, those whose id is marked; rows with a mark by chance, null texts and counts stay as they are."""
    word = lambda k: " ".join(f"x{k}y{i}" for i in range(60))
    chance = 2 + (1 << 23)  # the low bits of 2
    rows = [(1, word(1), 7), (2, word(1) + " own", 7), (chance, "kept  as it\tis ", 7), (chance, None, 7), (chance, "", 7), (None, word(1), 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # no table counts as small enough to be sent whole
    try:
        out = passages.remove(df)
        joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortMergeJoin" in x]
        assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], (2, "own", 3), *rows[2:]], key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(joins) == 1


def test_representatives_move_rows_of_links_alone(spark, monkeypatch):
    """Rows that nothing is linked with are not joined; rows with a mark by chance stay."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    chance = 2 + (1 << 23)
    rows = [(1, a), (2, a), (chance, b), (3, "one two"), (4, "three"), (4, "three"), (None, "four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, plain = [], common.marked
    monkeypatch.setattr(common, "marked", lambda rows, ids, *x: (seen.extend(r["__id"] for r in ids.collect()), plain(rows, ids, *x))[1])
    found = sorted(map(tuple, setjoin.representatives(df, 5, (80, 100)).collect()), key=str)
    assert found == sorted([(1, a), (chance, b), (3, "one two"), (4, "three"), (None, "four")], key=str)
    assert sorted(seen) == [2, 4]


def test_different_texts_under_one_id(spark):
    word = lambda k: " ".join(f"x{k}y{i}" for i in range(60))
    rows = [(1, word(1)), (2, word(2)), (2, word(1) + " own"), (2, word(1) + " own"), (3, word(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["source_id"]) for r in passages.repeats(df).collect()) == [(2, 60, 1), (3, 60, 2)]
    assert sorted(map(tuple, passages.remove(df).collect())) == [(1, word(1)), (2, "own"), (2, "own"), (2, word(2))]


def test_members_of_a_group_are_compared_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 32, passages._SPAN).astype(np.uint32)
    rows = []
    for i in range(300):
        tokens = base.copy() if i % 3 == 0 else rng.integers(1, 1 << 32, len(base)).astype(np.uint32)
        tokens[passages.WIDTH - 1] = base[passages.WIDTH - 1]
        if i:
            tokens[i % 40] = i
        rows.append((7, 0, i, 0, 1000 + i, 1000 + i - passages.WIDTH + 1, tokens.tobytes()))
    schema = passages._numbers(passages._AROUND)
    batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + 70]), schema)], schema=schema) for a in range(0, 300, 70)]
    found = defaultdict(set)
    for b in passages._compare(iter(batches)):
        for r in b.to_pylist():
            found[r["doc_id"]].add(r["source_id"])
    assert set(found) == set(range(3, 300, 3)) and all(max(s) < d and not any(x % 3 for x in s) for d, s in found.items())


# Shards


def test_shards_equal_sql(spark, duck):
    got = sorted(map(tuple, sharding.shards(common.table(spark, SMALL, "documents"), 60_000).collect()))
    wanted = sorted(duck.sql(sharding.SQL.replace(str(sharding.MAX_BYTES), "60000")).fetchall())
    assert got == wanted and len({r[2] for r in got}) > 5


def test_shards_of_equal_ids_fit(spark, edge, none):
    same = spark.createDataFrame([(1, "x" * 100)] * 500 + [(None, "y" * 100)] * 300 + [(i, "z" * 50) for i in range(2, 200)] + [(200, "w" * 5000)], "doc_id long, text string").repartition(5)
    rows = sharding.shards(same, 2000).collect()
    assert len(rows) == 500 + 300 + 198 + 1
    sizes, counts = Counter(), Counter()
    for r in rows:
        sizes[r["shard"]] += r["n_bytes"]
        counts[r["shard"]] += 1
        assert len(r["shard"]) == r["depth"]
    for r in rows:
        assert (r["shard_bytes"], r["shard_docs"]) == (sizes[r["shard"]], counts[r["shard"]])
        assert r["shard_bytes"] <= 2000 or (r["oversized"] and r["doc_id"] == 200)
    assert sorted((r["doc_id"] for r in sharding.shards(edge, 1000).collect()), key=str) == sorted((r[0] for r in edge.select("doc_id").collect()), key=str)
    assert sharding.shards(none).count() == 0
    assert {r["shard"] for r in sharding.shards(edge, 10**9).collect()} == {""}


def test_sharding_stays_in_the_engine(spark):
    plan = sharding.op9_sharding(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_copies", "passages", "packing"]
    docs = common.table(spark, SMALL, "documents")
    start = {r["doc_id"]: r for r in docs.collect()}
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.written(stage(spark, before, SMALL), f"test-{name}")
        if name != "packing":
            assert after.columns == docs.columns
        if name == "toxicity":
            toxic = {r["doc_id"] for r in common.table(spark, SMALL, "labels").where("toxic = 1").collect()}
            gone = set(start) - {r["doc_id"] for r in after.collect()}
            assert len(gone) < 0.25 * len(start) and gone & toxic
        if name == "near_copies":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in after.collect()} == {c for *_, c in brute_join(rows, 5, (80, 100))}
        if name == "passages":
            assert all(r["n_chars"] == len(r["text"]) <= len(start[r["doc_id"]]["text"]) for r in after.collect())
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
            assert math.isclose(after.agg({"length": "sum"}).first()[0], sum(r["doc_tokens"] for r in after.select("doc_id", "doc_tokens").distinct().collect()))
        before = after


def test_pipeline_stages_equal_definitions(spark):
    """Each filtering stage again, document by document."""
    import corpus_pipeline
    import pyarrow as pa

    from thicketry.llm import langid, toxicity

    docs = common.table(spark, SMALL, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    model = toxicity.train(docs, common.table(spark, SMALL, "labels"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    clean = {d for d, r in rows.items() if model.bias + sum(weight.get(i, 0.0) for i in set(toxicity.features(pa.array([r["text"]]))[1].tolist())) < 0}
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["toxicity"](spark, docs, SMALL)) == clean and 0 < len(clean) < len(rows)

    odd = spark.createDataFrame([(10**6 + i, t, None, None, len(t)) for i, t in enumerate(["xq zvk wqj pfx kqz " * 30, "123 456", "", "жщ ыфц " * 40])], docs.schema)
    large = common.table(spark, "/root/testdata/sf0.01", "documents")  # enough of each length to judge by
    more = large.unionByName(odd)
    prototypes = langid.train(more)
    least = langid.least_scores(more, prototypes)
    letters = langid.letter_vectors()
    kept = set()
    for r in more.collect():
        v, n = langid.vectors(pa.array([r["text"]]), letters)
        if n[0] and max(v[0] @ p for p in prototypes.values()) / np.linalg.norm(v[0]) > least[langid._size(n)[0]]:
            kept.add(r["doc_id"])
    found = ids(stages["language_id"](spark, more, SMALL))
    assert found == kept and not found & {10**6 + i for i in range(4)}
    assert len(found) >= 0.99 * large.count()

    cut = {r["doc_id"]: r["text"] for r in stages["passages"](spark, docs, SMALL).collect()}
    spans = defaultdict(list)
    for r in passages.repeats(docs).collect():
        spans[r["doc_id"]].append((r["start"], r["n_words"]))
    for d, r in rows.items():
        w = r["text"].split()
        for a, n in sorted(spans[d], reverse=True):
            del w[a : a + n]
        assert cut.get(d, "").split() == w


def test_pipeline_edges(spark, edge, none):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, SMALL)
        rows = out.collect()
        if name != "packing":
            assert out.schema.names == edge.columns and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in edge.collect()}
            assert {r["__id"] for r in rows} <= {1}
        assert stage(spark, none, SMALL).count() == 0
    unknown = edge.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert stages["language_id"](spark, unknown, SMALL).count() == edge.count()
    assert sorted(str(r["doc_id"]) for r in stages["near_copies"](spark, edge, SMALL).collect()) == sorted(str(x) for x in (0, 1, 2, 3, None, 5, 6, 7, 8, 9, 10, 11, 12, 13))

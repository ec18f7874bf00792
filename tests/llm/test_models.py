"""Language profiles, toxicity, nearest neighbours."""

import zlib

import numpy as np
import pytest

from thicketry.llm import ann, common, langid, toxicity

SMALL = "/root/testdata/sf0.01"


def test_trigrams_stay_within_texts():
    import pyarrow as pa

    both = langid.trigram_stream(pa.array(["abc de", "", "x\x00y", "abc de"]))
    one = langid.trigram_stream(pa.array(["abc de"]))
    for k in (0, 3):
        assert sorted(both[1][both[0] == k].tolist()) == sorted(one[1].tolist())
    assert not (both[0] == 1).any()


def test_vectors_are_bundles_of_bound_letters():
    import pyarrow as pa

    letters = langid.letter_vectors(64)
    doc, grams = langid.trigram_stream(pa.array(["hello there hello"]))
    wanted = sum(langid.trigram_vectors(np.array([g]), letters)[0] for g in grams)
    found, totals = langid.vectors(pa.array(["hello there hello"]), letters)
    assert np.allclose(found[0], wanted) and totals[0] == len(grams)


def test_language_held_out_accuracy(spark):
    rows = langid.op2_language_id(spark, SMALL).collect()
    lang = {r["doc_id"]: r["lang"] for r in common.table(spark, SMALL, "documents").select("doc_id", "lang").collect()}
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) / len(out) > 0.98


def test_language_edges(spark, edge, none):
    prototypes = langid.train(common.table(spark, SMALL, "documents"))
    rows = langid.predict(edge, prototypes).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3, 12}
    kept = langid.accepted(edge, prototypes)
    assert kept.schema == edge.schema and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3, 12})
    assert langid.predict(none, prototypes).count() == 0
    assert langid.train(none) == {}
    assert {r["lang_pred"] for r in langid.predict(edge, {}).collect()} == {"und"}


def test_texts_of_a_language_are_bundled_by_one_product():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = ["".join(map(chr, rng.integers(97, 123, 80))) + " " + "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 20))) for _ in range(60)] + ["", "12"]
    langs = ["pqr"[i % 3] for i in range(60)] + ["p", "s\x00"]
    letters = langid.letter_vectors(64)
    x, totals = langid.vectors(pa.array(texts), letters)
    held = [y for part in (slice(0, 20), slice(20, 62)) for y in langid._weights(pa.array(texts[part]), langs[part])]
    found: dict[str, np.ndarray] = {}
    langid._bundled(held, letters, found, block=100)
    assert set(found) == {"p", "q", "r", "s\x00"} and not found["s\x00"].any()
    for k in "pqr":
        mine = [i for i, lang in enumerate(langs) if lang == k and totals[i]]
        assert np.allclose(found[k], (1 / totals[mine]) @ x[mine].astype(np.float64), atol=1e-9)


def test_accepted_languages_are_alike(spark):
    import base64

    docs = common.table(spark, SMALL, "documents")
    prototypes = langid.train(docs)
    least = langid.least_scores(docs, prototypes)
    rng = np.random.default_rng(6)
    letters = lambda low, high: "".join(chr(c) if rng.random() > 0.17 else " " for c in rng.integers(low, high, 600))
    odd = [letters(97, 123) for _ in range(20)] + [base64.b64encode(rng.bytes(600)).decode() for _ in range(20)] + [letters(0x430, 0x450) for _ in range(20)] + [letters(0x4E00, 0x9FA5) for _ in range(20)]
    assert langid.accepted(spark.createDataFrame([(t,) for t in odd], "text string"), prototypes, least).count() == 0
    clean = docs.where("lang is not null and text rlike '[a-z]'")
    assert langid.accepted(clean, prototypes, least).count() >= 0.99 * clean.count()
    words = [r["text"] for r in docs.selectExpr("substring(text, 1, 40) text").where("text rlike '^[A-Z][a-z]+ [a-z]+ [a-z]+ '").collect()]
    short = spark.createDataFrame([(t,) for t in words], "text string")
    assert langid.accepted(short, prototypes, least).count() >= 0.95 * len(words)


def test_ftrl_equals_definition():
    """Coordinate by coordinate, as the update rule states it."""
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, 30, 6)), int(rng.random() < 0.4)) for _ in range(80)]
    a, b, l1, l2 = 0.7, 1.0, 0.3, 1.5
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        penalty = 0 if i == 32 else l1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - np.sign(z[i]) * penalty) / ((b + n[i] ** 0.5) / a + (0 if i == 32 else l2))

    for _ in range(2):
        for own, y in rows:
            own = [*own.tolist(), 32]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in own:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w[i]
                n[i] += g * g
    model = toxicity.ftrl(rows, bits=5, epochs=2, alpha=a, beta=b, l1=l1, l2=l2)
    assert np.allclose(model.dense(), [weight(i) for i in range(32)]) and np.isclose(model.bias, weight(32))


def test_scores_equal_definition(spark):
    """The query's model, scored again document by document from its words."""
    docs = common.table(spark, SMALL, "documents")
    model = toxicity.train(docs, common.table(spark, SMALL, "labels").where(~toxicity.held_out()))
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    import pyarrow as pa

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.op10_toxicity(spark, SMALL).collect():
        _, own = toxicity.features(pa.array([texts[r["doc_id"]]]))
        total = model.bias + sum(weight.get(i, 0.0) for i in set(own.tolist()))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_languages_equal_definition(spark):
    """Prototypes and cosines again, a letter and a trigram at a time, without the operator's counts."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").collect()
    letters = langid.letter_vectors(256)
    known_letters = {}

    def letter(c):
        if c not in known_letters:
            known_letters[c] = letters.of(np.array([ord(c) if c else 0]))[0]
        return known_letters[c]

    def vector(text):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        s = ["", *(x for w in words for x in (*w, ""))]
        total, n = np.zeros(256), 0
        for a, b, c in zip(s, s[1:], s[2:]):
            if b or (a and c):
                total += letter(a)[letters.order][letters.order] * letter(b)[letters.order] * letter(c)
                n += 1
        return total, n

    known = {r["doc_id"]: vector(r["text"]) for r in docs}
    prototypes = {}
    for r in docs:
        if r["lang"] is not None and known[r["doc_id"]][1]:
            v, n = known[r["doc_id"]]
            prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + v / n
    df = spark.createDataFrame([tuple(r) for r in docs], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.predict(df, langid.train(df, dimensions=256)).collect()}
    assert len(prototypes) > 1
    for d, (v, n) in known.items():
        if not n:
            assert found[d]["lang_pred"] == "und"
            continue
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in prototypes.items()}
        assert abs(found[d]["score"] - max(0, max(cosines.values()))) < 1e-4
        assert cosines[found[d]["lang_pred"]] > max(cosines.values()) - 1e-4


def test_languages_of_large_scripts_are_told_apart(spark):
    """Two languages of one script, each with a hundred words of its thousands of letters; vowel signs belong to words."""
    rng = np.random.default_rng(8)
    lists = {k: ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 4))) for _ in range(100)] for k in "pq"}
    text = lambda k: "".join(rng.choice(lists[k], 40))
    rows = [(i, text("pq"[i % 2]), "pq"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = langid.train(df.where("doc_id < 150"))
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df.where("doc_id >= 150"), prototypes).collect()}
    assert sum(found[i] == "pq"[i % 2] for i in found) >= 0.9 * len(found)
    import pyarrow as pa

    _, grams = langid.trigram_stream(pa.array(["हिन्दी"]))
    assert len(grams) == 6  # one word


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        own = np.unique(rng.integers(10, 5000, 40))
        toxic = rng.random() < 0.3
        rows.append((np.unique(np.append(own, 3)) if toxic else own, int(toxic)))
    model = toxicity.ftrl(rows, bits=13)
    assert 3 in model.features.tolist() and len(model.features) < 400
    assert model.weights[model.features == 3][0] > 2


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, "/root/testdata/sf0.1", "labels").collect()}
    out = [(rows[d]["score"], y) for d, y in labels.items() if rows[d]["held_out"]]
    order = np.argsort([s for s, _ in out])
    rank = np.empty(len(out))
    rank[order] = np.arange(len(out))
    y = np.array([y for _, y in out])
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / y.sum() / (len(y) - y.sum())
    assert auc > 0.9
    assert np.mean([(s >= 0.5) == t for s, t in out]) > 0.95


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(0, 0), (4, 1), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.accepted(edge, model).schema == edge.schema
    untrained = toxicity.train(edge, labels.where("toxic > 5"))
    assert {r["score"] for r in toxicity.score(edge, untrained).collect()} == {0.5}
    assert toxicity.accepted(edge, untrained).count() == langid.accepted(edge, {}).count() == edge.count()
    assert toxicity.score(none, model).count() == 0


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted(((-float((x * v).sum()), i) for i, x in rows if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_recall(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in common.table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    wanted = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = {}
    for r in ann.op6_nearest(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == wanted.keys()
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [r for r, *_ in got] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for i, _ in wanted[q]})
    assert hits / sum(map(len, wanted.values())) >= 0.9


def test_nearest_recall_with_differing_lengths(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(6000, 64)) * rng.choice([0.5, 1.0, 1.3], 6000)[:, None]
    rows = list(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    wanted = brute(rows, rows[::60], 20)
    found = {}
    for r in ann.search(df, df.where("vec_id % 60 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & {i for i, _ in w}) / 20 for q, w in wanted.items()]) >= 0.9


@pytest.mark.parametrize("few", [ann.FEW, 0])
def test_nearest_edges(spark, few):
    rows = [(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 0.0]), (63, [float("nan"), 1.0, 0.0]), (64, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (5, [9.0, 9.0, 9.0]), (80, [1.0, 1.0, 1.0]), (80, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = ann.search(df, df.where("vec_id % 20 = 0"), k=20, few=few).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40, 80}
    assert not {r["vec_id"] for r in found} & {60, 61, 62, 63, 64, None}
    best = {}
    for i, v in rows[:60] + rows[-3:]:
        if v is not None:
            best.setdefault(i, []).append(np.array(v))
    for q in (0, 20, 40, 80):
        v = min(best[q], key=lambda x: x.tolist())
        scored = sorted((-max(float((x * v).sum()) for x in xs), i) for i, xs in best.items() if i != q)[:20]
        got = [(-r["score"], r["vec_id"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(got) == 20 and np.allclose([s for s, _ in got], [s for s, _ in scored])
        assert got == sorted(got)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 2.0)]
    assert ann.search(few.where("false"), few.where("false")).count() == 0


@pytest.mark.parametrize("wobble", [0.0, 1e-6])
def test_nearest_repeated_rows_take_no_places(spark, wobble):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))]
    near = np.array(rows[0][1]) * 2
    rows += [(100, (near + wobble * j).tolist()) for j in range(5000)]  # the nearest row, over and over
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    found = {r["rank"]: r["vec_id"] for r in ann.search(df, df.where("vec_id = 0"), k=20).collect()}
    first = {}
    for i, v in rows:
        first[i] = max(first.get(i, -np.inf), float(np.dot(v, rows[0][1])))
    assert found == dict(enumerate(sorted((i for i in first if i), key=lambda i: -first[i])[:20], 1))


@pytest.mark.parametrize("name", ["op2_language_id", "op10_toxicity"])
def test_queries_keep_every_row(spark, name):
    from thicketry.llm.catalog import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == common.table(spark, "/root/testdata/sf0.001", "documents").count()

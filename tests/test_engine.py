"""The tree engine against naive recursion on small random trees, and its text formats."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from thicketry import cli
from thicketry.functions import model as M
from thicketry.operators import diff as D
from thicketry.operators import dupes as U
from thicketry.operators import edit as E
from thicketry.operators import hashset as H
from thicketry.operators import info as I
from thicketry.operators import rollup as R
from thicketry.operators import search as S
from thicketry.sources import scan as SC
from thicketry.sources import setfile, treefile

from naive import Tree, random_tree


def frame(spark, tree):
    rows = [(p, t, h, m, b, None, None) for p, t, h, m, b in tree.entries()]
    return R.build(spark.createDataFrame(rows, "path string, type string, hash string, mtime long, own_bytes long, link_target string, err_msg string"))


def test_digests(spark):
    # published digests of the short form
    known = {"a bytestring": "YTI3MDBmODFhZWE2ZjBm", "": "ZTNiMGM0NDI5OGZjMWMx", "file contents should be hashed": "MTVjMzcwNmJjODQzYTg0"}
    rows = spark.createDataFrame([(k,) for k in known], "c string").select("c", M.digest(F.col("c")), F.length(M.digest(F.col("c"), True))).collect()
    assert {r[0]: r[1] for r in rows} == known and {r[2] for r in rows} == {64}
    empty = spark.range(1).select(M.children_digest(F.array().cast("array<string>"))).first()[0]
    assert empty == known[""]


def test_names_and_messages(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(M.simplify_message(F.lit("/a/b: open: permission 'denied'"))) == "open: permission denied"
    assert one(M.simplify_message(F.lit("plain"))) == "plain"
    assert [one(M.valid_name(F.lit(n))) for n in ("a", "", ".", "..", "a/b", "a\nb")] == [True, False, False, False, False, True]
    assert one(M.annex_digest(F.lit("SHA256E-s1--" + "0" * 64 + ".x.y"))) is not None
    assert one(M.annex_digest(F.lit("SHA256E-s1--" + "0" * 63))) is None
    assert one(M.is_annex_target(F.lit("../.git/annex/objects/a/SHA256E-s1--0"))) and not one(M.is_annex_target(F.lit("x")))
    assert one(M.parent_of(F.lit("a"))) is None and one(M.parent_of(F.lit("a/b/c"))) == "a/b"
    assert one(M.ancestors(F.lit("a/b/c"))) == ["a", "a/b"]


@pytest.mark.parametrize("seed", range(3))
def test_rollups_and_searches(spark, seed):
    tree = random_tree(random.Random(seed))
    nodes = frame(spark, tree).cache()
    wanted = {p: (t, h, m, b, n) for p, t, h, m, b, n in tree.nodes()}
    assert {r["path"]: (r["type"], r["hash"], r["mtime"], r["nbytes"], r["nnodes"]) for r in nodes.collect()} == wanted
    assert R.same_tree(nodes, R.rebuild(nodes))
    # the top-most match hides what lies below it
    found = S.find(nodes, S.single_search(S.SearchConfig(), "[[:digit:]]*[13]$", "odd"))
    odd = {p for p, v in wanted.items() if v[0] != "E" and p[-1] in "13"}
    assert {r["path"] for r in found.collect()} == {p for p in odd if not any(p.startswith(a + "/") for a in odd)}
    # duplicates
    groups = {}
    for p, (t, h, _, _, n) in wanted.items():
        if t != "E":
            groups.setdefault(h, []).append((p.split("/"), t, n if t == "D" else 1))
    scores = {}
    for h, g in groups.items():
        if len(g) > 1:
            n = sum(x[2] for x in g)
            scores[h] = n - n // len(g) if min(g)[1] == "D" else n - 1
    assert {r["hash"]: r["score"] for r in U.scored(nodes).collect()} == scores
    if scores:
        top = min(scores, key=lambda h: (-scores[h], M.TYPE_ORDER.index(min(groups[h])[1]), min(groups[h])[0]))
        tops = ["/".join(x[0]) for x in groups[top]]
        inside = lambda h: all(any(("/".join(x[0]) + "/").startswith(t + "/") for t in tops) for x in groups[h])
        assert {r["hash"] for r in U.simplified(nodes).collect()} == {h for h in scores if h == top or not inside(h)}


@pytest.mark.parametrize("seed", range(2))
def test_diff_and_apply(spark, seed):
    rng = random.Random(100 + seed)
    old = random_tree(rng)
    new = old.changed(rng)
    a, b = frame(spark, old), frame(spark, new)
    got = sorted((r["op"], r["path"]) for r in D.changes(a, b).collect())
    assert got == sorted(old.diff(new))
    again = D.apply(a, D.diff(a, b), b)
    assert not D.diff(again, b).take(1)
    D.assert_same(b, b)
    if got:
        with pytest.raises(AssertionError):
            D.assert_same(a, b)
    with pytest.raises(ValueError):
        D.apply(a, spark.createDataFrame([("rm", "no/such", None)], "op string, path string, path2 string"), b)


def test_swapped_directories_and_moves(spark):
    same = {"d1": {"x": "1"}, "d2": {"y": "2"}}
    a = frame(spark, Tree({"top": same, "f": "3"}))
    b = frame(spark, Tree({"top": {"d1": same["d2"], "d2": same["d1"]}, "g": "3"}))
    assert [tuple(r) for r in D.diff(a, b).collect()] == []  # all names changed below equal hashes: the root's too
    old = frame(spark, Tree({"folder1": {"file3.txt": "same", "folder2": {"file2.txt": "old"}}}))
    new = frame(spark, Tree({"file3.txt": "other", "folder1": {"folder2": {"file2.txt": "new", "file3.txt": "same"}}}))
    assert sorted(r["line"] for r in D.rendered(D.diff(old, new)).collect()) == ["added 'file3.txt'", "edited 'folder1/folder2/file2.txt'", "moved 'folder1/file3.txt' -> 'folder1/folder2/file3.txt'"]


def test_edits(spark):
    tree = frame(spark, Tree({"a": {"x": "1"}, "b": "2"}))
    more = E.insert(tree, frame(spark, Tree({"y": "3"})), "a/sub/deep")
    assert {r["path"] for r in more.collect()} == {"root", "root/a", "root/a/x", "root/b", "root/a/sub", "root/a/sub/deep", "root/a/sub/deep/y"}
    with pytest.raises(ValueError):
        E.insert(tree, tree, "b/c")
    with pytest.raises(ValueError):
        E.insert(tree, tree, "")
    gone = E.remove_subtree(tree, spark.createDataFrame([("a",)], "path string"))
    assert R.same_tree(gone, frame(spark, Tree({"b": "2"})))
    wrapped = E.wrap(tree, "o", "i").where("depth = 0").first()
    root = tree.where("depth = 0").first()
    assert (wrapped["nnodes"], wrapped["nbytes"]) == (root["nnodes"] + 2, root["nbytes"] + 2 * M.DIR_BYTES)


def test_search_configuration(spark):
    config = S.parse_searches('[["one", [{"baseNameMatchesRegex": "x"}, {"dirContainsPath": "p/q"}]], ["none", []]]')
    assert config == (("one", (S.Search(base_name_regex="x"), S.Search(dir_contains_path="p/q"))), ("none", ()))
    with pytest.raises(ValueError):
        S.parse_searches('[["one", [{"other": "x"}]]]')
    with pytest.raises(ValueError):
        S.formatter("hz")
    nodes = frame(spark, Tree({"A": {"p": {"q": "1"}}, "b": "2"}))
    with pytest.raises(ValueError):
        S.path_lines(S.find(nodes), "l", searches=False)
    assert {r["path"] for r in S.find(nodes, S.SearchConfig(searches=config)).collect()} == {"root/A"}
    assert {r["path"] for r in S.find(nodes, S.single_search(S.SearchConfig(), "/a$")).collect()} == {"root/A"}
    assert S.find(nodes, S.SearchConfig(types="E")).count() == 0
    assert S.contains_hash(nodes, nodes.where("name = 'q'").first()["hash"]) and not S.contains_hash(nodes, "x")


def test_hash_sets(spark, tmp_path):
    a, b = frame(spark, Tree({"x": "1", "y": "2"})), frame(spark, Tree({"z": "1"}))
    made = H.add(H.merged(H.from_nodes(a)), b, note="later")
    notes = {r["hash"]: r["note"] for r in made.collect()}
    h = lambda t, n: t.where(F.col("name") == n).first()["hash"]
    assert notes[h(a, "x")] == "later" and notes[h(a, "y")] == "y" and len(notes) == 4
    path = str(tmp_path / "set")
    setfile.write_set(made, path)
    assert sorted(map(tuple, setfile.read_set(spark, path).collect())) == sorted(tuple(r) for r in made.select(*H.COLUMNS).collect())
    assert H.contains(made, h(a, "x")) and not H.contains(made, "no")
    assert {r["note"] for r in H.with_note(made, "n").collect()} == {"n"}
    assert H.empty(spark).count() == 0


def test_tree_file_round_trip(spark, tmp_path):
    rows = [
        ("root/tab\tand\nline", "F", "h" * 20, 5, 7, None, None),
        ("root/d", "D", None, 3, 4096, None, None),
        ("root/d/link", "L", "l" * 20, 6, 1, "../tab", None),
        ("root/d/broken", "B", "b" * 20, 6, 2, "/else", None),
        ("root/bad", "E", None, 0, 0, None, "permission denied"),
    ]
    nodes = R.build(spark.createDataFrame(rows, "path string, type string, hash string, mtime long, own_bytes long, link_target string, err_msg string"))
    # a name that is not UTF-8
    odd = nodes.withColumn("name", F.when(F.col("name") == "d", F.unhex(F.lit("64FF")).cast("string")).otherwise(F.col("name")))
    path = str(tmp_path / "t.tree")
    treefile.write_tree(nodes, path, ["x"], treefile.make_header(["x"], 10), treefile.make_footer(17))
    assert R.same_tree(nodes, treefile.read_tree(spark, path))
    assert treefile.read_header(path)["excludePatterns"] == ["x"] and I.scan_seconds(treefile.read_header(path), treefile.read_footer(path)) == 7
    assert treefile.tree_size(spark, path) == 6
    body = open(path, "rb").read()
    assert treefile.serialize(nodes) in body and body.startswith(b"# {") and body.endswith(b"# }\n")
    treefile.write_tree(odd, path)
    back = {bytes(r[0]) for r in treefile.read_tree(spark, path).select(F.col("path").cast("binary")).collect()}
    assert b"root/d\xff/link" in back
    with open(path, "ab") as f:
        f.write(b"Q\tnonsense\0\n")
    with pytest.raises(Exception, match="not a tree row"):
        treefile.read_tree(spark, path).collect()
    (tmp_path / "none").write_bytes(b"")
    assert treefile.read_tree(spark, str(tmp_path / "none")).first()["err_msg"] == "no rows parsed"


@pytest.mark.parametrize("lines", [2_000, 20_000])
def test_long_headers_and_odd_first_names(spark, tmp_path, lines):
    h = "h" * 20
    rows = b"F\t1\t%b\t5\t7\t1\tb\xffad\nD\t1\0\n" % h.encode() + b"F\t1\t%b\t5\t7\t1\tc\xff\0\n" % h.encode() + b"D\t0\t%b\t5\t4110\t3\troot\0\n" % h.encode()
    head = treefile.comment(treefile.make_header([f"p\u00e9{i}" for i in range(lines)], 10)) + "# " + "\t".join(treefile.FIELDS) + "\n"
    path = tmp_path / "t.tree"
    path.write_bytes(head.encode() + rows + treefile.comment(treefile.make_footer(17)).encode())
    back = {bytes(r[0]) for r in treefile.read_tree(spark, str(path)).select(F.col("path").cast("binary")).collect()}
    assert back == {b"root", b"root/b\xffad\nD\t1", b"root/c\xff"}
    header, nodes, footer = treefile.read_file(spark, str(path))
    assert len(header["excludePatterns"]) == lines and footer == {"scanEnd": 17} and nodes.count() == 3
    assert treefile.root_row(spark, str(path)).select("name", "nnodes").first() == ("root", 3)


def test_filters_while_reading(spark, tmp_path):
    tree = frame(spark, Tree({"a": {"x": "1", "d": {"y": "2"}}, "b": "3"}))
    path = str(tmp_path / "t.tree")
    treefile.write_tree(tree, path)
    paths = lambda *a, **k: {r["path"] for r in treefile.read_tree(spark, path, *a, **k).collect()}
    assert paths(1) == {"root", "root/a", "root/b"}
    assert paths(rows=F.col("type") == "F") == {"root/a/x", "root/a/d/y", "root/b"}
    assert paths(0, F.col("type") == "F") == set()


def test_numbers_without_a_single_task(spark):
    from thicketry.plans.materialize import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted((r["k"], r["position"]) for r in numbered(df, F.desc("k")).collect()) == [(k, 1000 - k) for k in range(1000)]
    assert numbered(df.where("false"), "k").count() == 0


def test_edits_equal_whole_rebuilds(spark):
    """New values above a change alone are those of a tree built anew."""
    rng = random.Random(77)
    for _ in range(2):
        old, more = random_tree(rng), random_tree(rng)
        a, b = frame(spark, old), frame(spark, more)
        files = [r["path"].split("/", 1)[1] for r in a.where("depth > 0").orderBy("path").collect()]
        gone = spark.createDataFrame([(p,) for p in rng.sample(files, min(3, len(files)))], "path string")
        for made in (E.remove_subtree(a, gone), E.insert(a, b, "new/deep/er"), E.wrap(a, "o", "i")):
            assert R.same_tree(made, R.rebuild(made))


def test_paths_across_chunks(spark, monkeypatch):
    nodes = frame(spark, random_tree(random.Random(5)))
    from pyspark.sql import Window

    coded = nodes.select(F.lit("t").alias("tree"), F.row_number().over(Window.orderBy(H.post_order())).alias("seq"), "depth", "name", F.col("path").alias("wanted"))
    monkeypatch.setattr(treefile, "CHUNK_BITS", 2)
    rows = treefile.rebuild_paths(coded).collect()
    assert rows and all(r["path"] == r["wanted"] for r in rows)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "scanned"
    SC.write_directory({"a/f": b"content", "a/empty": b"", "none": None, "skip.swp": b"x", f"SHA256E-s3--{'0' * 64}.bin": b"unread", b"b\xff".decode("utf-8", "surrogateescape"): b"odd"}, str(root))
    os.symlink("f", root / "a" / "near")
    os.symlink("/nowhere", root / "far")
    os.symlink("../../up", root / "a" / "up")
    os.mkfifo(root / "pipe")
    return root


def test_scan(spark, folder):
    with pytest.raises(FileExistsError):
        SC.write_directory({}, str(folder))
    rows = {bytes(r["p"]): r for r in SC.scan(spark, str(folder)).withColumn("p", F.col("path").cast("binary")).drop("path", "name", "parent").collect()}
    listed = {os.path.join(d, n)[len(os.fsencode(str(folder.parent))) + 1 :] for d, ds, fs in os.walk(os.fsencode(str(folder))) for n in ds + fs}
    assert set(rows) == {x for x in listed if not x.endswith(b".swp")} | {b"scanned"}
    kind = lambda p: rows[b"scanned/" + p]["type"]
    assert [kind(p) for p in (b"a", b"a/f", b"a/near", b"far", b"a/up", b"pipe", b"none", b"b\xff")] == list("DFLBBEDF")
    assert rows[b"scanned/a/near"]["hash"] == rows[b"scanned/a/f"]["hash"]
    assert rows[b"scanned/none"]["hash"] == rows[b"scanned/a/empty"]["hash"]  # an empty directory has nothing's digest
    assert rows[b"scanned/pipe"]["err_msg"] == "not a regular file" and rows[b"scanned/pipe"]["hash"] == "ERROR"
    assert rows[b"scanned"]["nnodes"] == len(rows)
    lost = SC.scan(spark, str(folder / "missing")).first()
    assert lost["type"] == "E"
    with pytest.raises(FileNotFoundError):
        SC.read_or_scan(spark, str(folder / "missing"))
    assert R.wrong_hashes(SC.scan(spark, str(folder)), SC.scan_contents(spark, str(folder))).select("path").collect()[0][0].startswith("scanned/SHA256E")


def test_link_rule():
    inside = lambda p, t: SC.link_in_tree(p.encode(), t.encode())
    assert inside("r/a", "b") and inside("r/d/a", "../b") and not inside("r/a", "../b") and not inside("r/a", "/b") and not inside("r/d/a", "../../b")
    assert [SC.seconds(x) for x in (500_000_000, 1_500_000_000, 1_500_000_001, 2_499_999_999)] == [0, 2, 2, 2]


def test_command_line(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "one.tree")
    run = lambda *a: cli.main(list(a), spark)
    run("hash", str(folder), "--output", out)
    run("info", out)
    assert "overall hash is" in capsys.readouterr().out
    run("find", out, "--search-regex", "/F$", "--out-fmt", "tl", "--search-label", "it")
    assert capsys.readouterr().out == "F\tit\tscanned/a/f\n"
    run("dupes", out)
    assert "# deduping these" in capsys.readouterr().out
    (folder / "a" / "f").write_bytes(b"changed")
    run("diff", out, str(folder))
    assert "edited 'a/f'" in capsys.readouterr().out
    hashes = str(tmp_path / "known.set")
    run("set-add", "--set", hashes, "--note", "n", out)
    run("find", out, "--exclude-set", hashes, "--output", str(tmp_path / "left"))
    assert (tmp_path / "left").read_text() == ""
    run("version")
    assert capsys.readouterr().out.strip()
    with pytest.raises(SystemExit):
        run("find", out, "--search-regex", "x", "--searches-json", "y")


def shuffled(spark, work):
    """Rows that all stages of work() wrote to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    records = lambda: sum(x.shuffleWriteRecords() for x in (lambda l: [l.apply(i) for i in range(l.size())])(store.stageList(None, False, False, none, None)))
    settle = lambda: sc._jsc.sc().listenerBus().waitUntilEmpty()
    settle()
    before = records()
    work()
    settle()
    return records() - before


def test_leaves_are_written_once_and_combined_before_they_move(spark, monkeypatch):
    from thicketry.plans.materialize import materialized
    from thicketry.sources import generated as G

    written = []

    def counted(df, label, by=None):
        made = materialized(df, label, by)
        written.append(made.count())
        return made

    monkeypatch.setattr(R, "materialized", counted)
    moved = shuffled(spark, lambda: R.build(G.entries(spark, 3000, 1, dirs=3, depth=2)).where("depth = 0").collect())
    assert sum(written) == 3000 + 13 and moved < 1000


def test_orders_move_once_to_their_customers(spark):
    from thicketry.sources import tables

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = tables.read(spark, "/root/testdata/sf0.001", "orders").count()
        moved = shuffled(spark, lambda: tables.commerce(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert orders <= moved < 2 * orders


def test_uneven_trees(spark):
    """Leaves and directories at one depth, directories with and without entries of their own, times before 1970, a file with something below it."""
    entry = lambda path, kind, mtime, size: (path, kind, f"h {path}", mtime, size, None, None)
    given = [entry("r/a/b/c", "F", -9, 10), entry("r/a/x", "F", -7, 1), entry("r/d", "D", -5, 100), entry("r/d/e/f", "E", 3, 3), entry("r/g", "F", -8, 20), entry("r/g/h", "F", -2, 2), entry("r/i", "D", 4, 50)]
    made = R.build(spark.createDataFrame(given, "path string, type string, hash string, mtime long, own_bytes long, link_target string, err_msg string"))
    none = spark.range(1).select(M.children_digest(F.array().cast("array<string>"))).first()[0]
    over = lambda *hashes: spark.range(1).select(M.children_digest(F.array(*map(F.lit, hashes)))).first()[0]
    b, e = over("h r/a/b/c"), over("ERROR")
    a, d = over(b, "h r/a/x"), over(e)
    assert {tuple(row) for row in made.select("path", "parent", "name", "depth", "type", "hash", "mtime", "nbytes", "nnodes").collect()} == {
        ("r", None, "r", 0, "D", over(a, d, "h r/g", none), 4, 16567, 11),
        ("r/a", "r", "a", 1, "D", a, -7, 8203, 4), ("r/a/b", "r/a", "b", 2, "D", b, -9, 4106, 2), ("r/a/b/c", "r/a/b", "c", 3, "F", "h r/a/b/c", -9, 10, 1), ("r/a/x", "r/a", "x", 2, "F", "h r/a/x", -7, 1, 1),
        ("r/d", "r", "d", 1, "D", d, 0, 4196, 3), ("r/d/e", "r/d", "e", 2, "D", e, 0, 4096, 2), ("r/d/e/f", "r/d/e", "f", 3, "E", "ERROR", 0, 0, 1),
        ("r/g", "r", "g", 1, "F", "h r/g", -2, 22, 2), ("r/g/h", "r/g", "h", 2, "F", "h r/g/h", -2, 2, 1), ("r/i", "r", "i", 1, "D", none, 4, 50, 1),
    }
    empty = R.build(made.where("false").select("path", "type", "hash", "mtime", F.col("nbytes").alias("own_bytes"), "link_target", "err_msg"))
    assert empty.columns == M.NODE_COLUMNS and not empty.take(1)


def test_generated_rows(spark):
    from thicketry.sources import generated as G

    made = G.tree(spark, 300, 4, dirs=3, depth=2, contents=100)
    assert made.where("type = 'F'").count() == 300 and R.same_tree(made, G.tree(spark, 300, 4, dirs=3, depth=2, contents=100))
    assert R.same_tree(made, R.rebuild(made)) and U.groups(made).count() > 0
    rows = G.rows(spark, 200)
    coded = treefile.lines(rows).select(F.lit("t").alias("tree"), F.lit(0).alias("seq"), F.col("line").alias("row"))
    fields = ["type", "depth", "hash", "mtime", "nbytes", "nnodes", "err_msg"]
    assert sorted(map(str, treefile.parse_rows(coded).select(*fields).collect())) == sorted(map(str, rows.select(*fields).collect()))
    assert {r["type"] for r in rows.collect()} == set("FDE") and G.hash_set(spark, 50).count() > 50


def test_streaming_set(spark, tmp_path):
    from thicketry.streaming import ingest

    nodes = frame(spark, Tree({"x": "1", "y": "2"}))
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    nodes.write.parquet(source)
    ingest.update_set(ingest.node_stream(spark, source), out, mark).awaitTermination()
    frame(spark, Tree({"z": "1"})).write.mode("append").parquet(source)
    ingest.update_set(ingest.node_stream(spark, source), out, mark).awaitTermination()
    notes = {r["note"] for r in ingest.read_set(spark, out).collect()}
    assert {"z", "y"} <= notes and "x" not in notes
    for n in ("p", "q"):
        frame(spark, Tree({n: "1"})).write.mode("append").parquet(source)
        ingest.update_set(ingest.node_stream(spark, source), out, mark).awaitTermination()
    left = ingest.read_set(spark, out).collect()
    assert {r["note"] for r in left} >= {"q", "y"} and len({r["hash"] for r in left}) == len(left)
    assert max(map(len, ingest._versions(out).values())) == 2


def test_entry_without_the_optional_folders(tmp_path):
    """Queries of the engine remain when the optional subpackage and the pipeline are gone."""
    import shutil

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(repo, "thicketry"), tmp_path / "thicketry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    queries, sql = json.loads(said)
    assert queries == sql and len(queries) > 50 and "pipeline" not in queries

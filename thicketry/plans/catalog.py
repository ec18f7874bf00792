"""The engine's queries over trees made from the driver's tables, each with its DuckDB formulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model as M
from ..operators import diff as D
from ..operators import dupes as U
from ..operators import edit as E
from ..operators import hashset as H
from ..operators import info as I
from ..operators import rollup as R
from ..operators import search as S
from ..sources import tables as T
from ..sources import treefile as TF
from . import oracle as O
from .materialize import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_BUILT: dict[tuple, DataFrame] = {}


def nodes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A tree by name, built once a session and folder: its files stay in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = R.build(getattr(T, name)(spark, sf_dir))
    return _BUILT[key]


def forget() -> None:
    """Trees are built anew from here on."""
    _BUILT.clear()


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents")


# Digests


@query(f"SELECT doc_id, {O.dig('text')} AS hash FROM documents")
def content_digest(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", M.digest(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, {O.dig("'../docs/doc' || doc_id")} AS hash FROM labels")
def link_literal_digest(spark, sf_dir):
    return T.read(spark, sf_dir, "labels").select("doc_id", M.digest(F.concat(F.lit("../docs/doc"), F.col("doc_id"))).alias("hash"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN {O.dig('text')} END AS hash FROM documents")
def annex_key_digest(spark, sf_dir):
    key = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("SHA1E-s")).otherwise(F.lit("SHA256E-s")), F.col("n_chars"), F.lit("--"), F.sha2("text", 256), F.lit(".txt"))
    return _documents(spark, sf_dir).select("doc_id", M.annex_digest(key).alias("hash"))


# Rollups


@query("WITH " + O.tree("t", O.doc_leaves(where="lang <> 'de' AND doc_id % 10 <> 7"), 3) + " SELECT path, hash, nbytes, nnodes FROM t")
def scan_exclude_rollup(spark, sf_dir):
    return R.build(R.exclude(T.docs(spark, sf_dir), [r"/de$", r"/doc\d*7$"])).select("path", "hash", "nbytes", "nnodes")


@query(O.of("docs") + " SELECT path, hash FROM docs WHERE type = 'D'")
def merkle_hash(spark, sf_dir):
    return nodes(spark, sf_dir, "docs").where("type = 'D'").select("path", "hash")


@query(O.of("commerce") + " SELECT path, hash, nbytes, nnodes FROM commerce WHERE depth < 4")
def merkle_root(spark, sf_dir):
    return nodes(spark, sf_dir, "commerce").where("depth < 4").select("path", "hash", "nbytes", "nnodes")


@query(O.of("docs") + " SELECT path, nnodes FROM docs")
def node_count_rollup(spark, sf_dir):
    return nodes(spark, sf_dir, "docs").select("path", "nnodes")


@query(O.of("mirror") + " SELECT path, nbytes FROM mirror")
def bytes_rollup(spark, sf_dir):
    return nodes(spark, sf_dir, "mirror").select("path", "nbytes")


@query(O.of("events") + " SELECT path, mtime FROM events WHERE type = 'D'")
def mtime_rollup(spark, sf_dir):
    return nodes(spark, sf_dir, "events").where("type = 'D'").select("path", "mtime")


@query(O.of("errors") + " SELECT path, type, hash, mtime, nbytes, nnodes FROM errors")
def error_nodes_perturb_hash(spark, sf_dir):
    return nodes(spark, sf_dir, "errors").select("path", "type", "hash", "mtime", "nbytes", "nnodes")


_EMPTY = f"SELECT 'world/' || c_name || '/o' || o_orderkey AS path, 'D' AS type, {O.dig("''")} AS hash, 0 AS mtime, 4096 AS nbytes FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"


@query("WITH " + O.tree("t", _EMPTY, 2) + " SELECT path, type, hash, nbytes, nnodes FROM t")
def empty_directories(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders").join(T.read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").join(T.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    path = F.concat_ws("/", F.lit("world"), "c_name", F.concat(F.lit("o"), F.col("o_orderkey")))
    return R.build(R.entries(o, path=path, type=F.lit("D"), own_bytes=F.lit(M.DIR_BYTES))).select("path", "type", "hash", "nbytes", "nnodes")


@query(O.of("docs") + f" SELECT row_number() OVER (ORDER BY {O.POST}) AS position, path FROM docs")
def flatten_postorder(spark, sf_dir):
    return numbered(nodes(spark, sf_dir, "docs").select("path"), H.post_order()).select("position", "path")


# DuckDB's strings hold no NUL: it is spelt out on both sides
@query(O.of("links") + " SELECT path, type || chr(9) || depth || chr(9) || hash || chr(9) || mtime || chr(9) || nbytes || chr(9) || nnodes || chr(9) || name || CASE WHEN type IN ('L', 'B') THEN '<NUL>' || chr(9) || '../docs/doc' || substr(name, 2) ELSE '' END AS line FROM links")
def row_format(spark, sf_dir):
    return TF.lines(nodes(spark, sf_dir, "links")).select("path", F.replace("line", F.lit("\0"), F.lit("<NUL>")).alias("line"))


@query(O.of("errors") + " SELECT path, CASE WHEN type = 'E' THEN 'E' || chr(9) || depth || chr(9) || '\"read failed\"' || chr(9) || name ELSE type || chr(9) || depth || chr(9) || hash || chr(9) || mtime || chr(9) || nbytes || chr(9) || nnodes || chr(9) || name END AS line FROM errors")
def row_format_errors(spark, sf_dir):
    return TF.lines(nodes(spark, sf_dir, "errors"))


@query(O.of("links") + " SELECT path, type, depth, hash, mtime, nbytes, nnodes, CASE WHEN type IN ('L', 'B') THEN '../docs/doc' || substr(name, 2) END AS link_target FROM links")
def row_parse(spark, sf_dir):
    """Rows written out and parsed again."""
    coded = numbered(TF.lines(nodes(spark, sf_dir, "links")).withColumn("turn", H.post_order()), "turn", name="seq")
    parsed = TF.parse_rows(coded.select(F.lit("links").alias("tree"), "seq", F.col("line").alias("row")))
    return TF.rebuild_paths(parsed).select("path", "type", "depth", "hash", "mtime", "nbytes", "nnodes", "link_target")


@query(O.of("pages") + " SELECT path, depth, hash FROM pages")
def path_rebuild(spark, sf_dir):
    made = nodes(spark, sf_dir, "pages")
    coded = numbered(made.select(F.lit("pages").alias("tree"), H.post_order().alias("turn"), "depth", "name", "hash"), "turn", name="seq")
    return TF.rebuild_paths(coded).select("path", "depth", "hash")


@query(f"SELECT 'root/' || source || '/' || lang || '/doc' || doc_id AS path, {O.dig('text')} AS hash, {O.dig("text || '!'")} AS found FROM documents WHERE doc_id % 19 = 0")
def verify_hashes(spark, sf_dir):
    contents = T.docs_contents(spark, sf_dir).withColumn("content", F.when(F.regexp_extract("path", r"(\d+)$", 1).cast("long") % 19 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return R.wrong_hashes(nodes(spark, sf_dir, "docs"), contents)


# Searches


@query(O.of("errors") + " SELECT path FROM errors WHERE type <> 'E'")
def find_all(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "errors")).select("path")


@query(O.of("docs") + " SELECT path FROM docs WHERE depth BETWEEN 1 AND 2")
def find_depth(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "docs"), S.SearchConfig(min_depth=1, max_depth=2)).select("path")


@query(O.of("docs") + " SELECT path, nbytes FROM docs WHERE nbytes BETWEEN 5000 AND 20000")
def find_bytes(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "docs"), S.SearchConfig(min_bytes=5000, max_bytes=20000)).select("path", "nbytes")


@query(O.of("pages") + " SELECT path, nnodes FROM pages WHERE nnodes BETWEEN 2 AND 30")
def find_nodes(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "pages"), S.SearchConfig(min_files=2, max_files=30)).select("path", "nnodes")


@query(O.of("events") + " SELECT path, mtime FROM events WHERE mtime BETWEEN 1705000000 AND 1706000000")
def find_mtime(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "events"), S.SearchConfig(min_mtime=1705000000, max_mtime=1706000000)).select("path", "mtime")


@query(O.of("links") + " SELECT path, type FROM links WHERE type IN ('L', 'B')")
def find_types(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "links"), S.SearchConfig(types="LB")).select("path", "type")


@query(O.of("docs") + " SELECT hash || chr(9) || type || chr(9) || depth || chr(9) || mtime || chr(9) || nbytes || chr(9) || nnodes || chr(9) || path AS line FROM docs")
def find_format(spark, sf_dir):
    return S.path_lines(S.find(nodes(spark, sf_dir, "docs")), "htdmbfh").select("line")


@query(O.of("docs") + ", " + O.found("docs", "regexp_matches(path, 'SRC[3-5]/(en|fr|es|de)/doc[0-9]*[1-5]$', 'i')", "'low'") + " SELECT path, label FROM hits")
def find_regex(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "docs"), S.single_search(S.SearchConfig(), r"SRC[3-5]/(en|fr|es|de)/doc[[:digit:]]*[1-5]$", "low")).select("path", "label")


_LABELS = (("french", (S.Search(base_name_regex="^fr$"),)), ("never", ()), ("nine or small", (S.Search(base_name_regex="9$", whole_name_regex="/en/"), S.Search(base_name_regex="^doc[0-9]$"))), ("english", (S.Search(whole_name_regex="/en/"),)))
_CASE = "CASE WHEN regexp_matches(name, '^fr$', 'i') THEN 'french' WHEN (regexp_matches(name, '9$') AND regexp_matches(path, '/en/', 'i')) OR regexp_matches(name, '^doc[0-9]$', 'i') THEN 'nine or small' WHEN regexp_matches(path, '/en/', 'i') THEN 'english' END"


@query(O.of("docs") + ", " + O.found("docs", f"({_CASE}) IS NOT NULL", _CASE) + " SELECT label || chr(9) || path AS line FROM hits")
def find_labels_first_wins(spark, sf_dir):
    return S.path_lines(S.find(nodes(spark, sf_dir, "docs"), S.SearchConfig(searches=_LABELS)), "l").select("line")


@query(O.of("docs") + ", " + O.found("docs", "regexp_matches(path, 'src1', 'i') AND nbytes < 130000", "'ones'") + " SELECT path, label, nnodes FROM hits")
def find_topmost(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "docs"), S.single_search(S.SearchConfig(max_bytes=129999), "src1", "ones")).select("path", "label", "nnodes")


@query(O.of("pages") + ", " + O.found("pages", "regexp_matches(name, '^p[0-9]*[02468]$', 'i')", "'even'") + " SELECT path, label FROM hits")
def find_basename(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "pages"), S.SearchConfig(searches=(("even", (S.Search(base_name_regex="^p[0-9]*[02468]$"),)),))).select("path", "label")


@query(O.of("docs") + ", " + O.found("docs", "path || '/en' IN (SELECT path FROM docs)", "'has en'") + " SELECT path, label FROM hits")
def find_dir_contains(spark, sf_dir):
    return S.find(nodes(spark, sf_dir, "docs"), S.SearchConfig(searches=(("has en", (S.Search(dir_contains_path="en"),)),))).select("path", "label")


@query(O.of("docs") + " SELECT path FROM docs WHERE hash NOT IN (SELECT hash FROM docs WHERE starts_with(path, 'root/src0/') OR starts_with(path, 'root/src1/'))")
def find_exclude_set(spark, sf_dir):
    own = nodes(spark, sf_dir, "docs")
    sets = [H.merged(H.from_nodes(own.where(F.col("path").startswith(f"root/{s}/")))) for s in ("src0", "src1")]
    return S.find(own, S.SearchConfig(exclude_sets=tuple(sets))).select("path")


@query(O.of("docs", "snapshot") + " SELECT path, hash IN (SELECT hash FROM snapshot) AS present FROM docs")
def tree_contains_hash(spark, sf_dir):
    return S.with_presence(nodes(spark, sf_dir, "docs"), nodes(spark, sf_dir, "snapshot")).select("path", "present")


# Duplicates


@query(O.of("mirror") + ", " + O.groups("mirror") + " SELECT hash, type, n, k, first_path FROM grp")
def dupes_groups(spark, sf_dir):
    return U.groups(nodes(spark, sf_dir, "mirror"))


@query(O.of("events") + ", " + O.groups("events") + f" SELECT {O.RANK} AS position, hash, type, n, k, score FROM grp")
def dupes_scored(spark, sf_dir):
    return numbered(U.scored(nodes(spark, sf_dir, "events")), *U.order()).select("position", "hash", "type", "n", "k", "score")


@query(O.of("mirror") + ", " + O.simplified("mirror") + " SELECT hash, type, n, k, score, first_path FROM simp")
def dupes_simplified(spark, sf_dir):
    return U.simplified(nodes(spark, sf_dir, "mirror")).select("hash", "type", "n", "k", "score", "first_path")


_KIND = "CASE type WHEN 'D' THEN 'dirs would remove ' || score || ' files' WHEN 'F' THEN 'files would remove ' || score ELSE 'links would remove ' || score END"


@query(
    O.of("mirror") + ", " + O.simplified("mirror") + f", paths AS (SELECT hash, string_agg(path, chr(10) ORDER BY path) AS paths FROM mirror GROUP BY hash) "
    f"SELECT {O.RANK} AS position, simp.hash, '# deduping these ' || k || ' ' || {_KIND} || ':' || chr(10) || paths || chr(10) AS text FROM simp JOIN paths ON simp.hash = paths.hash"
)
def dupes_explained(spark, sf_dir):
    return U.explained(nodes(spark, sf_dir, "mirror"))


@query(O.of("mirror") + ", " + O.simplified("mirror", "depth <= 3") + " SELECT hash, type, n, k, score FROM simp")
def dupes_max_depth(spark, sf_dir):
    return U.simplified(nodes(spark, sf_dir, "mirror"), max_depth=3).select("hash", "type", "n", "k", "score")


@query(O.of("links") + ", " + O.groups("links") + " SELECT hash, type, n, k, score FROM grp")
def dupes_mixed_types(spark, sf_dir):
    return U.scored(nodes(spark, sf_dir, "links")).select("hash", "type", "n", "k", "score")


@query(O.of("mirror") + ", " + O.groups("mirror") + " SELECT g.hash, g.score FROM grp g WHERE EXISTS (SELECT 1 FROM mirror n WHERE n.hash = g.hash AND NOT EXISTS (SELECT 1 FROM mirror a JOIN grp ON a.hash = grp.hash WHERE starts_with(n.path, a.path || '/')))")
def dupes_fully_simplified(spark, sf_dir):
    return U.fully_simplified(nodes(spark, sf_dir, "mirror")).select("hash", "score")


# Hash sets

_LAST = "QUALIFY row_number() OVER (PARTITION BY hash ORDER BY src DESC, post DESC) = 1"


def _set(*sources: tuple[str, str]) -> str:
    every = " UNION ALL ".join(f"SELECT {i} AS src, {O.POST} AS post, hash, nnodes, nbytes, {note} AS note FROM {n} WHERE type <> 'E'" for i, (n, note) in enumerate(sources))
    return f"st AS (SELECT hash, nnodes, nbytes, note FROM ({every}) {_LAST})"


@query(O.of("errors") + ", " + _set(("errors", "name")) + " SELECT * FROM st")
def set_from_tree(spark, sf_dir):
    return H.merged(H.from_nodes(nodes(spark, sf_dir, "errors")))


@query(O.of("docs", "snapshot") + ", " + _set(("docs", "name"), ("snapshot", "name")) + " SELECT * FROM st")
def set_merge_last_wins(spark, sf_dir):
    return H.add(H.merged(H.from_nodes(nodes(spark, sf_dir, "docs"))), nodes(spark, sf_dir, "snapshot"))


@query(O.of("docs", "snapshot") + ", " + _set(("docs", "name"), ("snapshot", "'second scan'")) + " SELECT * FROM st")
def set_note_override(spark, sf_dir):
    return H.add(H.merged(H.from_nodes(nodes(spark, sf_dir, "docs"))), nodes(spark, sf_dir, "snapshot"), note="second scan")


@query(O.of("docs") + ", " + _set(("docs", "name")) + " SELECT row_number() OVER (ORDER BY hash, nnodes, nbytes, note) AS position, hash || chr(9) || nnodes || chr(9) || nbytes || chr(9) || note AS line FROM st")
def set_sorted_lines(spark, sf_dir):
    made = numbered(H.merged(H.from_nodes(nodes(spark, sf_dir, "docs"))), *H.COLUMNS)
    return H.lines(made).join(made.select("hash", "position"), "hash").select("position", "line")


@query(O.of("docs") + ", " + _set(("docs", "'one note'")) + " SELECT * FROM st")
def set_with_note(spark, sf_dir):
    return H.with_note(H.merged(H.from_nodes(nodes(spark, sf_dir, "docs"))), "one note")


@query(O.of("snapshot", "docs") + ", " + _set(("docs", "name")) + " SELECT path, note, st.nnodes AS set_nnodes FROM snapshot JOIN st ON snapshot.hash = st.hash")
def set_lookup(spark, sf_dir):
    return H.lookup(nodes(spark, sf_dir, "snapshot"), H.merged(H.from_nodes(nodes(spark, sf_dir, "docs")))).select("path", "note", "set_nnodes")


# Differences


def _diff(spark, sf_dir):
    return D.diff(nodes(spark, sf_dir, "docs"), nodes(spark, sf_dir, "snapshot"))


_DOCS_SNAP = O.of("docs", "snapshot") + ", " + O.diff("docs", "snapshot")


@query(_DOCS_SNAP + " SELECT path FROM deltas WHERE op = 'add'")
def diff_added(spark, sf_dir):
    return _diff(spark, sf_dir).where("op = 'add'").select("path")


@query(_DOCS_SNAP + " SELECT path FROM deltas WHERE op = 'rm'")
def diff_removed(spark, sf_dir):
    return _diff(spark, sf_dir).where("op = 'rm'").select("path")


@query(_DOCS_SNAP + " SELECT path FROM deltas WHERE op = 'edit'")
def diff_edited(spark, sf_dir):
    return _diff(spark, sf_dir).where("op = 'edit'").select("path")


_MOVED = O.doc_leaves(source="CASE WHEN doc_id % 23 = 0 THEN 'src0' ELSE source END")


def _moved(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("source", F.when(F.col("doc_id") % 23 == 0, F.lit("src0")).otherwise(F.col("source")))
    return R.build(T._leaf(d, T._doc("root"), F.col("text"), T.EPOCH + F.col("doc_id")))


@query("WITH " + O.tree("docs", *O.LEAVES["docs"]) + ", " + O.tree("moved", _MOVED, 3) + ", " + O.diff("docs", "moved") + " SELECT path, path2 FROM deltas WHERE op = 'mv'")
def diff_moved(spark, sf_dir):
    return D.diff(nodes(spark, sf_dir, "docs"), _moved(spark, sf_dir)).where("op = 'mv'").select("path", "path2")


@query("WITH " + O.tree("docs", *O.LEAVES["docs"]) + ", " + O.tree("kinds", f"SELECT path, CASE WHEN x THEN 'D' ELSE type END AS type, CASE WHEN x THEN {O.dig("''")} ELSE hash END AS hash, mtime, CASE WHEN x THEN 4096 ELSE nbytes END AS nbytes FROM (SELECT *, regexp_extract(path, '[0-9]+$')::BIGINT % 31 = 0 AS x FROM ({O.doc_leaves()}))", 3) + ", " + O.diff("docs", "kinds") + " SELECT op, path FROM deltas")
def diff_kind_change(spark, sf_dir):
    changed = F.regexp_extract("path", r"(\d+)$", 1).cast("long") % 31 == 0
    new = T.docs(spark, sf_dir).withColumn("own_bytes", F.when(changed, F.lit(M.DIR_BYTES)).otherwise(F.col("own_bytes"))).withColumn("type", F.when(changed, F.lit("D")).otherwise(F.col("type")))
    return D.diff(nodes(spark, sf_dir, "docs"), R.build(new)).select("op", "path")


@query(_DOCS_SNAP + " SELECT CASE op WHEN 'add' THEN 'added ''' || path || '''' WHEN 'rm' THEN 'removed ''' || path || '''' WHEN 'edit' THEN 'edited ''' || path || '''' ELSE 'moved ''' || path || ''' -> ''' || path2 || '''' END AS line FROM deltas")
def diff_render(spark, sf_dir):
    return D.rendered(_diff(spark, sf_dir))


_RENAMED = O.doc_leaves(leaf="CASE WHEN source = 'src1' THEN 'ren' ELSE 'doc' END || doc_id", text="CASE WHEN source <> 'src1' AND doc_id % 19 = 0 THEN text || '!' ELSE text END")


@query("WITH " + O.tree("docs", *O.LEAVES["docs"]) + ", " + O.tree("renamed", _RENAMED, 3) + ", " + O.diff("docs", "renamed") + " SELECT op, path FROM deltas")
def diff_pruned_equal_dirs(spark, sf_dir):
    one = F.col("source") == "src1"
    d = _documents(spark, sf_dir).withColumn("text", F.when(~one & (F.col("doc_id") % 19 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    path = F.concat_ws("/", F.lit("root"), "source", "lang", F.concat(F.when(one, F.lit("ren")).otherwise(F.lit("doc")), F.col("doc_id")))
    return D.diff(nodes(spark, sf_dir, "docs"), R.build(T._leaf(d, path, F.col("text"), T.EPOCH + F.col("doc_id")))).select("op", "path")


# what an equal directory holds stays the old tree's, names and times included; all else becomes the new one's
_IN_EQUAL = "EXISTS (SELECT 1 FROM eq WHERE eq.rel = '' OR starts_with(path, 'root/' || eq.rel || '/'))"
_APPLIED = f"SELECT path, type, hash, mtime, nbytes FROM docs_leaf WHERE {_IN_EQUAL} UNION ALL SELECT path, type, hash, mtime, nbytes FROM snapshot_leaf WHERE NOT {_IN_EQUAL}"


@query(_DOCS_SNAP + ", " + O.tree("t", _APPLIED, 3) + " SELECT path, type, hash, mtime, nbytes, nnodes FROM t")
def apply_deltas(spark, sf_dir):
    old, new = nodes(spark, sf_dir, "docs"), nodes(spark, sf_dir, "snapshot")
    return D.apply(old, D.diff(old, new), new).select("path", "type", "hash", "mtime", "nbytes", "nnodes")


_LOST = "t = 3 AND type <> 'F'"
_LINKED = (
    f"SELECT path, CASE WHEN t = 2 AND type = 'L' THEN 'B' WHEN {_LOST} THEN 'E' ELSE type END AS type, "
    f"CASE WHEN t = 1 AND type <> 'F' THEN {O.dig("path || '!'")} WHEN {_LOST} THEN 'ERROR' ELSE hash END AS hash, CASE WHEN {_LOST} THEN 0 ELSE mtime END AS mtime, CASE WHEN {_LOST} THEN 0 ELSE nbytes END AS nbytes "
    f"FROM (SELECT *, regexp_extract(path, '[0-9]+$')::BIGINT % 7 AS t FROM ({O.LEAVES['links'][0]}))"
)


@query("WITH " + O.tree("links", *O.LEAVES["links"]) + ", " + O.tree("relinked", _LINKED, 2) + ", " + O.diff("links", "relinked") + " SELECT op, path FROM deltas")
def diff_links_and_errors(spark, sf_dir):
    """Links edited, turned into broken ones, and lost."""
    turn = F.regexp_extract("path", r"(\d+)$", 1).cast("long") % 7
    link = F.col("type") != "F"
    new = T.links(spark, sf_dir).withColumns(
        {
            "type": F.when((turn == 2) & (F.col("type") == "L"), F.lit("B")).when((turn == 3) & link, F.lit("E")).otherwise(F.col("type")),
            "hash": F.when((turn == 1) & link, M.digest(F.concat("path", F.lit("!")))).otherwise(F.col("hash")),
        }
    )
    return D.diff(nodes(spark, sf_dir, "links"), R.build(new)).select("op", "path")


@query(_DOCS_SNAP + " SELECT (SELECT count(*) FROM deltas)::BIGINT AS differences, false AS same, true AS same_as_itself")
def assert_same_trees(spark, sf_dir):
    old, new = (nodes(spark, sf_dir, n) for n in ("docs", "snapshot"))
    D.assert_same(old, old)
    try:
        D.assert_same(old, new)
        said = None
    except AssertionError as e:
        said = str(e)
    count = int(said.split(" in ", 1)[1].split(" ", 1)[0]) if said else 0
    return spark.createDataFrame([(count, said is None, True)], "differences long, same boolean, same_as_itself boolean")


# Edits


@query("WITH " + O.tree("t", O.doc_leaves() + " UNION ALL SELECT 'root/extra/web' || substr(path, 4), type, hash, mtime, nbytes FROM (" + O.LEAVES["pages"][0] + ")", 9) + " SELECT path, hash, mtime, nbytes, nnodes FROM t")
def add_subtree(spark, sf_dir):
    return E.insert(nodes(spark, sf_dir, "docs"), nodes(spark, sf_dir, "pages"), "extra/web").select("path", "hash", "mtime", "nbytes", "nnodes")


@query("WITH " + O.tree("t", O.doc_leaves(where="source <> 'src0' AND NOT (source = 'src1' AND lang = 'en')"), 3) + " SELECT path, hash, mtime, nbytes, nnodes FROM t")
def rm_subtree(spark, sf_dir):
    tops = spark.createDataFrame([("src0",), ("src1/en",)], "path string")
    return E.remove_subtree(nodes(spark, sf_dir, "docs"), tops).select("path", "hash", "mtime", "nbytes", "nnodes")


@query("WITH " + O.tree("t", O.doc_leaves("a/b/root"), 5) + " SELECT path, depth, hash, nbytes, nnodes FROM t")
def wrap_dirs(spark, sf_dir):
    return E.wrap(nodes(spark, sf_dir, "docs"), "a", "b").select("path", "depth", "hash", "nbytes", "nnodes")


# Summaries


@query(O.of("commerce") + " SELECT name, hash, nnodes, nbytes FROM commerce WHERE depth = 0")
def tree_info(spark, sf_dir):
    return I.tree_info(nodes(spark, sf_dir, "commerce"))


@query("WITH " + O.tree("t", O.doc_leaves("other"), 3) + " SELECT path, parent, name, hash FROM t")
def rename_root(spark, sf_dir):
    return R.rename_root(nodes(spark, sf_dir, "docs"), "other").select("path", "parent", "name", "hash")


@query(O.of("mirror") + " SELECT parent, lower(regexp_replace(name, '[0-9]+$', '')) AS name, count(*)::BIGINT AS n FROM mirror WHERE parent IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return R.duplicate_names(nodes(spark, sf_dir, "mirror").withColumn("name", F.regexp_replace("name", r"[0-9]+$", "")))

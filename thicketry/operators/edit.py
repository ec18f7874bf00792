"""Editing trees: subtrees added, removed and wrapped. Only the directories above a change get new derived values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import model as M
from ..plans.materialize import materialized


def _relative():
    return M.below_root(F.col("path"))


def _under(rows: DataFrame, tops: DataFrame, how: str) -> DataFrame:
    """rows below or at one of tops (path, relative to the root), by equality of exploded ancestors."""
    rel = rows.withColumn("rel", _relative())
    spread = rel.select("rel", F.explode(M.ancestors(F.col("rel"), own=True)).alias("path"))
    hit = spread.join(tops.select("path"), "path", "left_semi").select("rel").distinct()
    return rel.join(hit, "rel", how).drop("rel")


def _root(nodes: DataFrame) -> str:
    return nodes.where("depth = 0").select("name").first()[0]


def _edited(before: DataFrame, kept: DataFrame, placed: DataFrame | None, changed: DataFrame, dir_bytes: int = M.DIR_BYTES, full_digest: bool = False) -> DataFrame:
    """The nodes kept and placed, with new values for the directories above `changed` (path, whole).

    Directories on the way that are missing are made, with dir_bytes of their own and time 0. Own sizes and times of the
    others are recovered from the tree `before` (a time is known only where no child explains it). Work
    and writes besides one pass over the nodes are bound by the directories above the changes and their children.
    """
    final = kept if placed is None else kept.unionByName(placed)
    above = changed.select(F.explode(M.ancestors(F.col("path"))).alias("path")).distinct()
    if placed is not None:
        above = above.join(placed.select("path"), "path", "left_anti")  # nested changes: those are right already
        if blocked := kept.where("type <> 'D'").join(above, "path", "left_semi").take(1):
            raise ValueError(f"not a directory: {blocked[0]['path']}")
    above = materialized(above, "above")
    children = before.join(above.select(F.col("path").alias("parent")), "parent", "left_semi").groupBy(F.col("parent").alias("path")).agg(F.sum("nbytes").alias("below"), F.max("mtime").alias("latest"))
    known = kept.join(above, "path", "left_semi").join(children, "path", "left").select("path", (F.col("nbytes") - F.coalesce("below", F.lit(0))).alias("own_bytes"), F.when(F.coalesce("latest", F.lit(-1)) >= F.col("mtime"), F.lit(0)).otherwise(F.col("mtime")).alias("own_mtime"))
    stale = above.join(known, "path", "left").select("path", M.parent_of(F.col("path")).alias("parent"), M.depth_of(F.col("path")).cast("int").alias("depth"), F.coalesce("own_bytes", F.lit(dir_bytes)).alias("own_bytes"), F.coalesce("own_mtime", F.lit(0)).alias("own_mtime"))
    stale = materialized(stale, "stale", by="depth")
    final = final.join(stale.select("path"), "path", "left_anti").select(*M.NODE_COLUMNS)
    values = ["parent", "hash", "mtime", "nbytes", "nnodes"]
    beside = final.join(stale.select(F.col("path").alias("parent")), "parent", "left_semi")
    beside = materialized(beside.select(*values, "depth"), "beside", by="depth")
    level = None
    for depth in range(stale.agg(F.max("depth")).first()[0] if stale.take(1) else -1, -1, -1):
        own = beside.where(F.col("depth") == depth + 1).select(*values)
        if level is not None:
            own = own.unionByName(level.select(*values))
        sums = own.groupBy(F.col("parent").alias("path")).agg(F.collect_list("hash").alias("hashes"), F.max("mtime").alias("latest"), F.sum("nbytes").alias("bytes"), F.sum("nnodes").alias("n"))
        none = F.array().cast("array<string>")
        made = stale.where(F.col("depth") == depth).join(sums, "path", "left").select(
            "path", "parent", M.name_of(F.col("path")).alias("name"), "depth", F.lit("D").alias("type"),
            M.children_digest(F.coalesce("hashes", none), full_digest).alias("hash"),
            F.greatest("own_mtime", F.coalesce("latest", F.lit(0))).cast("long").alias("mtime"),
            (F.col("own_bytes") + F.coalesce("bytes", F.lit(0))).cast("long").alias("nbytes"),
            (1 + F.coalesce("n", F.lit(0))).cast("long").alias("nnodes"),
            F.lit(None).cast("string").alias("link_target"), F.lit(None).cast("string").alias("err_msg"),
        )
        level = materialized(made.select(*M.NODE_COLUMNS), f"level-{depth}")
        final = final.unionByName(level)
    return final


def _whole(tops: DataFrame, root: str) -> DataFrame:
    return tops.select(F.concat(F.lit(f"{root}/"), F.col("path")).alias("path"))


def remove_subtree(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The tree without the subtrees at tops (path, relative to the root). Paths that are not there change nothing."""
    there = tops.join(nodes.select(_relative().alias("path")), "path", "left_semi").where("path <> ''")
    kept = materialized(_under(nodes, tops, "left_anti"), "kept")
    return _edited(nodes, kept, None, _whole(there, _root(nodes)))


def replace_subtrees(nodes: DataFrame, gone: DataFrame, source: DataFrame, come: DataFrame) -> DataFrame:
    """The tree without the subtrees at `gone`, with those of `source` at `come` (path, relative to both roots); what lay there goes.

    Missing directories on the way are made. Raises ValueError for an empty path, or where a file stands in the way.
    """
    if come.where("path = ''").take(1):
        raise ValueError("a subtree needs a path below the root")
    root = _root(nodes)
    tops = materialized(gone.select("path").unionByName(come.select("path")).distinct(), "tops")
    kept = materialized(_under(nodes, tops, "left_anti"), "kept")
    placed = _under(source, come, "left_semi").withColumn("path", F.concat(F.lit(f"{root}/"), _relative()))
    placed = materialized(placed.withColumn("parent", M.parent_of(F.col("path"))).select(*M.NODE_COLUMNS), "placed")
    return _edited(nodes, kept, placed, _whole(tops.where("path <> ''"), root))


def add_subtree(nodes: DataFrame, source: DataFrame, tops: DataFrame) -> DataFrame:
    """The tree with the subtrees of `source` at tops (path, relative to both roots); what lay there goes."""
    return replace_subtrees(nodes, tops.where("false"), source, tops)


def _moved(nodes: DataFrame, top: str) -> DataFrame:
    """The nodes with their root at the path `top`."""
    path = F.when(F.col("depth") > 0, F.concat(F.lit(f"{top}/"), _relative())).otherwise(F.lit(top))
    moved = nodes.withColumn("path", path)
    return moved.withColumns({"parent": M.parent_of(F.col("path")), "name": M.name_of(F.col("path")), "depth": M.depth_of(F.col("path")).cast("int")}).select(*M.NODE_COLUMNS)


def insert(nodes: DataFrame, sub: DataFrame, at: str) -> DataFrame:
    """The tree with another tree placed at a relative path, its root taking the path's last name."""
    if not at:
        raise ValueError("a subtree needs a path below the root")
    tops = nodes.sparkSession.createDataFrame([(at,)], "path string")
    root = _root(nodes)
    return _edited(nodes, materialized(_under(nodes, tops, "left_anti"), "kept"), _moved(sub, f"{root}/{at}"), _whole(tops, root))


def wrap(nodes: DataFrame, *names: str, dir_bytes: int = M.DIR_BYTES) -> DataFrame:
    """The tree inside new directories, the first name outermost: each adds one node and dir_bytes."""
    top = "/".join((*names, _root(nodes)))
    moved = _moved(nodes, top)
    return _edited(moved, moved, None, nodes.sparkSession.createDataFrame([(top,)], "path string"), dir_bytes)

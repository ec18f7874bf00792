"""Differences of two trees, moves, and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model as M
from ..plans.materialize import materialized
from .edit import replace_subtrees


def relative(path: Column = None) -> Column:
    """Path below the root's name; '' for the root."""
    return M.below_root(F.col("path") if path is None else path)


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    def side(nodes: DataFrame, prefix: str) -> DataFrame:
        return nodes.select(relative().alias("rel"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("type", "hash", "mtime", "nbytes", "nnodes", "name")])

    return side(old, "old").join(side(new, "new"), "rel", "full")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """op (add, rm, edit), path: relative to the roots, whose names don't count.

    Directories with equal hashes are equal as a whole: nothing below them is looked at, at any depth. Of what was added or removed only the
    top is told. A node whose kind changed is removed and added; other nodes whose hashes differ are edited. Two roots that
    are no directories are compared under the path ''.
    """
    both = materialized(_sides(old, new), "sides")  # read four times below
    dirs = (F.col("old_type") == "D") & (F.col("new_type") == "D")
    differ = ~F.col("old_hash").eqNullSafe(F.col("new_hash"))
    pairs = both.where(dirs)
    root = F.lit(".")
    # a parent that is a directory on both sides, and no ancestor with equal hashes
    mark = lambda c: F.when(c == "", root).otherwise(F.concat(root, F.lit("/"), c))
    open_ = pairs.where(differ).select(mark(F.col("rel")).alias("parent"))
    closed = pairs.where(~differ).select(mark(F.col("rel")).alias("above"))
    spot = both.withColumn("full", mark(F.col("rel"))).withColumn("parent", M.parent_of(F.col("full")))
    below = spot.join(open_, "parent", "left_semi")
    blocked = below.select("full", F.explode(M.ancestors(F.col("full"))).alias("above")).join(closed, "above", "left_semi").select("full").distinct()
    candidates = below.join(blocked, "full", "left_anti").unionByName(spot.where("rel = ''").select(*below.columns))
    kind_changed = F.col("old_type") != F.col("new_type")
    ops = (
        F.when(F.col("old_type").isNull(), F.array(F.lit("add")))
        .when(F.col("new_type").isNull(), F.array(F.lit("rm")))
        .when(kind_changed, F.array(F.lit("rm"), F.lit("add")))
        .when(differ & ~dirs, F.array(F.lit("edit")))
        .otherwise(F.array().cast("array<string>"))
    )
    return candidates.withColumn("op", F.explode(ops)).select("op", F.col("rel").alias("path"), *[c for c in both.columns if c != "rel"])


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """op (add, rm, edit, mv), path, path2 (where a move goes, else null).

    A removal and an addition of equal top nodes (type, name, hash, size, time) are a move; equal ones pair in path order, one to one.
    """
    found = materialized(changes(old, new), "changes")  # read several times below
    key = ["type", "name", "hash", "nbytes", "mtime"]

    def turn(op: str, side: str, out: str) -> DataFrame:
        own = found.where(F.col("op") == op).select(F.col("path").alias(out), *[F.col(f"{side}_{c}").alias(c) for c in key])
        return own.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(M.components(F.col(out)))))

    moves = turn("rm", "old", "path").join(turn("add", "new", "path2"), [*key, "turn"]).select("path", "path2")
    rest = (
        found.where("op = 'rm'").join(moves.select("path"), "path", "left_anti")
        .unionByName(found.where("op = 'add'").join(moves.select(F.col("path2").alias("path")), "path", "left_anti"))
        .unionByName(found.where("op = 'edit'"))
    )
    return rest.select("op", "path", F.lit(None).cast("string").alias("path2")).unionByName(moves.select(F.lit("mv").alias("op"), "path", "path2"))


def rendered(deltas: DataFrame) -> DataFrame:
    """line: one a change."""
    q = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    return deltas.select(
        F.when(F.col("op") == "add", F.concat(F.lit("added "), q("path")))
        .when(F.col("op") == "rm", F.concat(F.lit("removed "), q("path")))
        .when(F.col("op") == "edit", F.concat(F.lit("edited "), q("path")))
        .otherwise(F.concat(F.lit("moved "), q("path"), F.lit(" -> "), q("path2")))
        .alias("line")
    )


def assert_same(old: DataFrame, new: DataFrame, shown: int = 20) -> None:
    """Raises AssertionError with the number of differences and the first ones in path order."""
    found = diff(old, new)
    some = rendered(found.orderBy("path", "op").limit(shown)).collect()
    if some:
        raise AssertionError(f"trees differ in {found.count()} places:\n" + "\n".join(r[0] for r in some))


def apply(old: DataFrame, deltas: DataFrame, new: DataFrame) -> DataFrame:
    """The old tree with the changes made; subtrees of additions and edits come from the new one.

    Removed, moved and edited subtrees go, the new ones come; only directories above them get new derived values. Raises ValueError if
    a path to be removed is not there.
    """
    deltas = materialized(deltas, "deltas")
    gone = deltas.where("op in ('rm', 'mv', 'edit')").select("path")
    here = old.select(relative().alias("path"))
    if missing := gone.join(here, "path", "left_anti").take(1):
        raise ValueError(f"no such path to remove: {missing[0][0]}")
    come = deltas.where("op in ('add', 'edit')").select("path").unionByName(deltas.where("op = 'mv'").select(F.col("path2").alias("path")))
    return replace_subtrees(old, gone, new, come)

"""Groups of nodes with equal digests, scored by how many nodes deduplication would remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model as M
from ..plans.materialize import materialized, numbered


def groups(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """hash, type (of the first path), n (nodes in all members), k (distinct paths), first_path: groups of two and more.

    Only numbers and the least path are aggregated, and combined before the shuffle, so a group of any size costs a row a task; the member
    paths stay where they are (see `members`). Paths compare component by component.
    """
    own = nodes.where("type <> 'E'")
    if max_depth is not None:
        own = own.where(F.col("depth") <= max_depth)
    weight = F.when(F.col("type") == "D", F.col("nnodes")).otherwise(F.lit(1))
    first = F.min(F.struct(M.components(F.col("path")).alias("parts"), F.col("type"))).alias("first")
    found = own.groupBy("hash").agg(F.sum(weight).cast("long").alias("n"), F.count("*").alias("k"), first).where("k > 1")
    return found.select("hash", F.col("first.type").alias("type"), "n", "k", F.array_join("first.parts", "/").alias("first_path"))


def score(n: Column, k: Column, kind: Column) -> Column:
    return F.when(kind == "D", n - F.floor(n / k)).otherwise(n - 1).cast("long")


def scored(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    return groups(nodes, max_depth).withColumn("score", score(F.col("n"), F.col("k"), F.col("type")))


def order() -> list[Column]:
    """Highest score, then kind, then first path: a total order."""
    return [F.desc("score"), M.type_rank(F.col("type")), M.components(F.col("first_path"))]


def members(nodes: DataFrame, found: DataFrame, max_depth: int | None = None) -> DataFrame:
    """hash, path for every member of the groups."""
    own = nodes.where("type <> 'E'")
    if max_depth is not None:
        own = own.where(F.col("depth") <= max_depth)
    return own.select("hash", "path").join(found.select("hash"), "hash")


def simplified(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Scored groups without those that lie wholly inside the first group's paths; no other group prunes."""
    found = materialized(scored(nodes, max_depth), "groups")  # read four times below
    top = found.orderBy(*order()).limit(1)
    inside_of = members(nodes, top, max_depth).select(F.col("path").alias("above"))
    every = members(nodes, found, max_depth)
    inside = every.select("hash", "path", F.explode(M.ancestors(F.col("path"), own=True)).alias("above")).join(inside_of, "above", "left_semi").select("hash", "path").distinct()
    within = inside.groupBy("hash").agg(F.count("*").alias("within"))
    kept = found.join(within, "hash", "left").where("within is null or within < k").drop("within")
    return kept.unionByName(found.join(top.select("hash"), "hash", "left_semi")).dropDuplicates(["hash"])


def fully_simplified(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Scored groups without those whose every member lies below a member of another group."""
    found = materialized(scored(nodes, max_depth), "groups")
    every = members(nodes, found, max_depth)
    inside = every.select("hash", "path", F.explode(M.ancestors(F.col("path"))).alias("above")).join(every.select(F.col("path").alias("above")), "above", "left_semi").select("hash", "path").distinct()
    within = inside.groupBy("hash").agg(F.count("*").alias("within"))
    return found.join(within, "hash", "left").where("within is null or within < k").drop("within")


def explained(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """position, hash, text: what each simplified group would save, and its sorted paths, a line each.

    A group's text holds all its paths, as a printed report does; for tables use `members`.
    """
    kept = materialized(simplified(nodes, max_depth), "simplified")
    paths = members(nodes, kept, max_depth).groupBy("hash").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("paths"))
    depth = f" (up to {max_depth} levels deep)" if max_depth is not None else ""
    what = F.when(F.col("type") == "D", F.concat(F.lit("dirs would remove "), F.col("score").cast("string"), F.lit(" files"))).when(F.col("type") == "F", F.concat(F.lit("files would remove "), F.col("score").cast("string"))).otherwise(F.concat(F.lit("links would remove "), F.col("score").cast("string")))
    head = F.concat(F.lit("# deduping these "), F.col("k").cast("string"), F.lit(" "), what, F.lit(f"{depth}:"))
    return numbered(kept, *order()).join(paths, "hash").select("position", "hash", F.concat(head, F.lit("\n"), F.col("paths"), F.lit("\n")).alias("text"))

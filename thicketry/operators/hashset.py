"""Sets of hashes with what is known of each: hash, nnodes, nbytes, note."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import model as M

COLUMNS = ["hash", "nnodes", "nbytes", "note"]


def from_nodes(nodes: DataFrame, note: str | None = None) -> DataFrame:
    """Entries of a tree in its post-order (children before their directory), errors left out; `seq` keeps that order.

    The note is the node's name unless one is given. Hashes may repeat.
    """
    own = nodes.where("type <> 'E'")
    return own.select("hash", "nnodes", "nbytes", (F.lit(note) if note is not None else F.col("name")).cast("string").alias("note"), post_order().alias("seq"))


def post_order():
    """A sort key, as short as the path: components parted by NUL, which no name holds, and ended by the next byte, so
    that paths sort component by component and a directory follows all that is in it."""
    return F.concat(F.replace("path", F.lit("/"), F.lit("\0")), F.lit("\1"))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], "hash string, nnodes long, nbytes long, note string")


def merged(*sources: DataFrame) -> DataFrame:
    """One entry a hash: the last one of the last source that has it. Sources may bring `seq`, their own order."""
    parts = []
    for i, s in enumerate(sources):
        own = s if "seq" in s.columns else s.withColumn("seq", F.lit(""))
        parts.append(own.select(*COLUMNS, F.struct(F.lit(i).alias("source"), F.col("seq")).alias("turn")))
    every = reduce(DataFrame.unionByName, parts)
    last = F.max_by(F.struct("nnodes", "nbytes", "note"), F.struct("turn", "nnodes", "nbytes", "note")).alias("last")
    return every.groupBy("hash").agg(last).select("hash", "last.*")


def add(existing: DataFrame, *trees: DataFrame, note: str | None = None) -> DataFrame:
    """The set with the trees' entries, in argument order; a note goes to the newly added ones only."""
    return merged(existing, *[from_nodes(t, note) for t in trees])


def in_order(entries: DataFrame) -> DataFrame:
    return entries.select(*COLUMNS).orderBy(*COLUMNS)


def with_note(entries: DataFrame, note: str) -> DataFrame:
    return entries.withColumn("note", F.lit(note))


def contains(entries: DataFrame, value: str) -> bool:
    return bool(entries.where(F.col("hash") == value).take(1))


def lookup(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes with what the set knows of their hash."""
    known = entries.select("hash", F.col("nnodes").alias("set_nnodes"), F.col("nbytes").alias("set_nbytes"), "note")
    return nodes.where("type <> 'E'").join(known, "hash")


def lines(entries: DataFrame) -> DataFrame:
    """hash, line: the entry's text without its end marks."""
    return entries.select("hash", F.concat_ws("\t", "hash", F.col("nnodes").cast("string"), F.col("nbytes").cast("string"), "note").alias("line"))

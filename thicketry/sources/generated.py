"""Made-up rows, trees and sets of any size, for measurements: all from a seed, made where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model as M
from ..operators import hashset as H
from ..operators import rollup as R

#: Times lie between these (2000-01-01 and 2024-01-01 UTC), sizes below the last.
FIRST, LAST, BYTES = 946684800, 1704067200, 10_000


def _number(seed: int, what: str, below: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(below))


def entries(spark: SparkSession, n: int, seed: int = 0, dirs: int = 10, depth: int = 3, contents: int | None = None) -> DataFrame:
    """n files for rollup.build, each `depth` directories below the root, `dirs` in each directory. With fewer contents than files, some are duplicates."""
    parts = [F.concat(F.lit("d"), _number(seed, f"level {k}", dirs)) for k in range(depth)]
    path = F.concat_ws("/", F.lit("root"), *parts, F.concat(F.lit("f"), F.col("id")))
    content = _number(seed, "content", contents or max(n, 1)).cast("string")
    return R.entries(spark.range(n), path=path, hash=M.digest(content), mtime=F.lit(FIRST) + _number(seed, "time", LAST - FIRST), own_bytes=_number(seed, "bytes", BYTES + 1))


def tree(spark: SparkSession, n: int, seed: int = 0, **shape: int) -> DataFrame:
    return R.build(entries(spark, n, seed, **shape))


def rows(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n single node rows without a common root: files, directories and errors in equal parts."""
    kind = F.element_at(F.array(*map(F.lit, "FDE")), (_number(seed, "kind", 3) + 1).cast("int"))
    made = entries(spark, n, seed).withColumn("id", F.xxhash64("path")).withColumn("type", kind)
    error = F.col("type") == "E"
    return made.select(
        "path", M.parent_of(F.col("path")).alias("parent"), M.name_of(F.col("path")).alias("name"), M.depth_of(F.col("path")).cast("int").alias("depth"), "type",
        F.when(error, F.lit(M.ERROR_HASH)).otherwise(F.col("hash")).alias("hash"), F.when(error, F.lit(0)).otherwise(F.col("mtime")).alias("mtime"), F.when(error, F.lit(0)).otherwise(F.col("own_bytes")).alias("nbytes"),
        F.when(F.col("type") == "D", _number(seed, "nodes", BYTES) + 1).otherwise(F.lit(1)).alias("nnodes"), "link_target", F.when(error, F.lit("read failed")).alias("err_msg"),
    )


def hash_set(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return H.merged(H.from_nodes(tree(spark, n, seed)))

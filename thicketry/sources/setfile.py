"""Hash sets as text: hash, nnodes, nbytes, note, parted by tabs, ended by NUL and line feed; no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hashset as H
from . import files


def write_set(entries: DataFrame, path: str) -> None:
    rows = H.lines(entries).join(entries.select(*H.COLUMNS), "hash").orderBy(*H.COLUMNS).select(F.concat("line", F.lit("\0")).alias("value"))
    parts = files.uri(path) + ".parts"
    rows.write.mode("overwrite").text(parts)
    files.join_parts(parts, path)


def read_set(spark: SparkSession, *paths: str) -> DataFrame:
    """hash, nnodes, nbytes, note; a line that can't be read fails the job."""
    raw = spark.read.option("lineSep", "\0\n").text([files.uri(p) for p in paths]).where("value <> ''")
    parts = F.split("value", "\t", 4)
    good = F.col("value").rlike(r"^[^\t]+\t-?\d+\t-?\d+\t")
    return raw.select(
        F.when(good, F.get(parts, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not a set row: "), F.substring("value", 1, 200)))).alias("hash"),
        F.get(parts, F.lit(1)).try_cast("long").alias("nnodes"),
        F.get(parts, F.lit(2)).try_cast("long").alias("nbytes"),
        F.get(parts, F.lit(3)).alias("note"),
    )

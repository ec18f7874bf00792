"""Tables written once and read again: lineage ends there, and their files outlive executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def materialized(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """The rows of df from a fresh folder below spark.checkpoint.dir (below a temporary one where that is unset and Spark runs locally).

    by: a column of few values; each has a folder of its own, so that a filter on it reads no other.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/thicketry-shared-{os.getuid()}"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """The rows with their numbers (from 1) in a total order, without a task that sees all of them: a sort by ranges, counts of the
    ranges, and each row's place in its own."""
    rows = materialized(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, (F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("__at", "__part", "__start")

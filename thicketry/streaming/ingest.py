"""Structured Streaming into hash sets: node rows that arrive in files update a set, last writer wins."""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import model as M
from ..operators import hashset as H
from ..sources import files

#: A batch rewrites the buckets that its hashes fall into, and no others.
BUCKETS = 64


def node_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Node rows from Parquet files as they come."""
    return spark.readStream.schema(M.NODE_SCHEMA).parquet(folder)


def _versions(folder: str) -> dict[int, list[int]]:
    """The versions of each bucket, oldest first."""
    fs, name = files.locate(folder)
    found: dict[int, list[int]] = {}
    for info in fs.get_file_info(pafs.FileSelector(name, recursive=True, allow_not_found=True)):
        if m := re.search(r"/version=(\d+)/bucket=(\d+)$", info.path):
            found.setdefault(int(m[2]), []).append(int(m[1]))
    return {bucket: sorted(numbers) for bucket, numbers in found.items()}


def _read(spark: SparkSession, folder: str, parts: list[tuple[int, int]]) -> DataFrame:
    if not parts:
        return H.empty(spark)
    return spark.read.schema(H.empty(spark).schema).parquet(*[f"{folder}/version={v}/bucket={b}" for b, v in parts])


def read_set(spark: SparkSession, folder: str) -> DataFrame:
    """The set as it is: every bucket's last version."""
    return _read(spark, folder, [(b, v[-1]) for b, v in _versions(folder).items()])


def update_set(stream: DataFrame, folder: str, checkpoint: str, note: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps a set of all nodes seen. Batch N writes folder/version=N/bucket=K for the buckets it changes.

    A batch that is run again starts from the versions before its own and writes the same. Of each bucket the
    last two versions stay.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int").alias("bucket")
        changed = [r[0] for r in batch.where("type <> 'E'").select(bucket).distinct().collect()]  # `buckets` numbers at most
        versions = {b: [v for v in numbers if v < number] for b, numbers in _versions(folder).items()}
        old = _read(spark, folder, [(b, versions[b][-1]) for b in changed if versions.get(b)])
        merged = H.merged(old, H.from_nodes(batch, note))
        merged.select(*H.COLUMNS, bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={number}")
        fs, name = files.locate(folder)
        for b in changed:
            for v in versions.get(b, [])[:-1]:
                fs.delete_dir(f"{name}/version={v}/bucket={b}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

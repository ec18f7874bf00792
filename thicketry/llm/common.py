"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into Python objects at once.
CHUNK_BYTES = 1 << 19


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder URI below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (local tests) a temporary folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/thicketry-shared-{os.getuid()}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._thicketry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` whose readers have all been written themselves."""
    for t in tables:
        fs, path = pafs.FileSystem.from_uri(t._thicketry_path)
        fs.delete_dir(path)


def free(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of tables that are written by now: it does so for plans that nobody holds any more,
    which the JVM finds out in its second collection."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def marked(rows: DataFrame, ids: DataFrame, bits: int = 23) -> DataFrame:
    """rows, of which __id is a column, with a column __marked: true where `ids` has that __id, and for a few others; false for null.

    Marks are bits for the ids' low bits, made in the cluster and joined where the rows lie, 32 to a number: 2**18 numbers at most. So rows
    without a mark need not move to learn that nothing is to be done with them.
    """
    mask = (1 << bits) - 1
    low = ids.where("__id is not null").select(F.col("__id").bitwiseAND(mask).alias("low"))
    words = low.groupBy(F.shiftright("low", 5).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 31 as int))")).alias("__marks"))
    words = written(words, "marks")
    met = rows.withColumn("__word", F.shiftright(F.col("__id").bitwiseAND(mask), 5)).join(F.broadcast(words), "__word", "left")
    return met.select(*rows.columns, F.expr("coalesce((shiftright(__marks, cast(__id & 31 as int)) & 1) = 1, false)").alias("__marked"))


def in_order(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, text) in ascending order of the id over all partitions; null ids come first.

    Rows of one id (or none) are ordered by their first characters, then by a hash of the text, and equal rows by where they lie, so that no
    id, however frequent, has to stay in one partition.
    """
    keys = ["doc_id", "__head", "__hash", "__row"]
    keyed = texts.withColumns({"__head": F.substring("text", 1, 32), "__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, under fixed names; a null text becomes empty.

    Other columns, whatever their names, are pruned and so cannot clash with results.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Hands memory that is free in this process back to the machine: workers outlive their tasks, and what one stage's tasks have freed would
    count beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc's
        trim(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices (no copies) of the batches whose text column holds about `limit` bytes, one row at least."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = byte_offsets(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns untouched, for whose text (null as empty) `keep` says so. Runs where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_col) if at is None else at
            texts = pc.fill_null(batch.column(at), "")
            first = 0
            for part in chunks([pa.RecordBatch.from_arrays([texts], ["text"])]):
                mask = keep(part.column("text"))
                whole = batch.slice(first, part.num_rows)
                first += part.num_rows
                if mask.any():
                    yield whole if mask.all() else whole.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def byte_offsets(column: pa.Array) -> np.ndarray:
    """n + 1 offsets of a string or binary array into its data buffer."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary array, without a copy of the bytes."""
    offsets = byte_offsets(column)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""Token ids in Arrow stream files of equal-length sequences, and their zero-copy readers.

A file holds one run of consecutive documents (ascending id) as one stream of ids, cut into sequences of a fixed
length: record batches of two columns, `ids` (fixed-size list of unsigned integers) and `mask` (fixed-size list of
bytes: 1, and 0 where the last sequence is padded with zeros). Batches hold BATCH sequences each but the last, so
sequence i lies in batch i // BATCH at row i % BATCH: random access without a scan, and, through a memory map,
without a copy. Beside it lies an index file with (doc_id, start, n_tokens), starts counted in the file.

Files appear under names of their own for each attempt of a task. The manifest, a table in the shared folder,
names those of the attempts that succeeded; what a lost executor left behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, wordbpe

LENGTH = 2048
END_ID = 1
#: Sequences in a record batch.
BATCH = 256
#: Ids after which a file is closed at the next document's end.
FILE_TOKENS = 32 << 20

MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes one file and its index. Documents come whole; sequences run on across them."""

    def __init__(self, uri: str, dtype: np.dtype, length: int, batch: int = BATCH):
        fs, path = _file_system(uri)
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length))], {"batch": str(batch)})
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink, self.index_sink = fs.open_output_stream(path), fs.open_output_stream(path + ".index")
        self.out, self.index = pa.ipc.new_stream(self.sink, self.schema), pa.ipc.new_stream(self.index_sink, self.index_schema)
        self.dtype, self.length, self.batch = dtype, length, batch
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.docs: list[tuple] = []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n_tokens, n))
        self.n_docs += 1
        self.n_tokens += n
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.length * self.batch * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        step = self.length * self.batch * self.dtype.itemsize
        data = b"".join(self.held)
        whole = len(data) if last else len(data) // step * step
        for at in range(0, whole, step):
            ids = np.frombuffer(data[at : min(at + step, whole)], self.dtype)
            rows = -(-len(ids) // self.length)
            mask = (np.arange(rows * self.length) < len(ids)).astype(np.uint8)
            ids = np.pad(ids, (0, rows * self.length - len(ids)))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.held_bytes = [data[whole:]], len(data) - whole
        if self.docs:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.docs)], schema=self.index_schema))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        for x in (self.out, self.index, self.sink, self.index_sink):
            x.close()


class SequenceFile:
    """Random access to a file's sequences, masks and documents; views of the mapped file, no copies."""

    def __init__(self, uri: str):
        fs, path = _file_system(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        self._source = pa.memory_map(path) if local else fs.open_input_file(path)
        reader = pa.ipc.open_stream(self._source)
        self.length = reader.schema.field("ids").type.list_size
        self.batch = int(reader.schema.metadata[b"batch"])
        self.sizes = []
        self.views: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in reader:
            self.sizes.append(batch.num_rows)
            self.views.append(tuple(batch.column(c).flatten().to_numpy().reshape(-1, self.length) for c in ("ids", "mask")))
        with fs.open_input_file(path + ".index") as f:
            self.index = pa.ipc.open_stream(f).read_all()

    def __len__(self) -> int:
        return sum(self.sizes)

    def sequence(self, i: int) -> np.ndarray:
        return self.views[i // self.batch][0][i % self.batch]

    def mask(self, i: int) -> np.ndarray:
        return self.views[i // self.batch][1][i % self.batch]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start` of the file on; a view where one sequence holds them."""
        parts = []
        for i in range(start // self.length, -(-(start + n) // self.length)):
            inside = slice(max(0, start - i * self.length), min(self.length, start + n - i * self.length))
            if not self.mask(i)[inside].all():
                raise ValueError("the index leads to padding")
            parts.append(self.sequence(i)[inside])
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order."""
        for batch in self.index.to_batches():
            for doc_id, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield doc_id, start, self.tokens(start, n)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, length: int = LENGTH, end_id: int | None = END_ID, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids in ascending doc_id order; the manifest (part, seq, path, n_docs, n_tokens), in file order by part, seq.

    Null text: the end id alone. Null ids come first; the order of equal ids is that of common.in_order, equal rows are written as often
    as they occur. An empty table gives an empty manifest. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = wordbpe.encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        task = TaskContext.get()
        fs, path = _file_system(folder)
        fs.create_dir(path, recursive=True)
        out, rows = None, []

        def close() -> None:
            nonlocal out
            out.close()
            rows.append((task.partitionId(), len(rows), uri, out.n_docs, out.n_tokens))
            out = None

        for part in common.chunks(batches):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode_batch(part.column("text"))):
                if out is None:
                    uri = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{len(rows):04d}.arrows"
                    out = SequenceWriter(uri, enc.dtype, length)
                out.add(doc_id, ids + tail)
                if out.n_tokens >= file_tokens:
                    close()
        if out is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "seq", "path", "n_docs", "n_tokens"), zip(*rows))), pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = common.in_order(common.id_text(docs, id_col, text_col))
    return common.written(ordered.mapInArrow(run, MANIFEST), "tokens-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit words)."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, n, ids = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names)

        for files in batches:
            for path, base in zip(files.column("path").to_pylist(), files.column("base").to_pylist()):
                rows, held = [], 0
                for doc_id, start, ids in SequenceFile(path).documents():
                    rows.append((doc_id, base + start, len(ids), ids.astype("<u4").tobytes()))
                    held += len(ids)
                    if held > 1 << 19:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.select("path", "base").repartition("path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "tokens")
    manifest = write_tokens(common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"), folder)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

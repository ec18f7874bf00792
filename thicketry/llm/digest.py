"""Exact document fingerprints: a canonical form, a wide digest, and byte comparison inside equal digests.

The canonical form is the text after Unicode compatibility composition (NFKC), case folding, composition again
(folding can undo it) and white space folded: runs become one space, none at the ends. Its fingerprint is the
128-bit xxhash of the form's UTF-8 bytes, in hexadecimal. Fingerprints are all or nothing: the likeness of two is
1.0 where they are equal and 0.0 elsewhere.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def _digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def fingerprint(text: str) -> str:
    return _digest(canonical(text))


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[str], str] = _digest) -> DataFrame:
    """doc_id, fingerprint, canonical: one row a document. Null text counts as empty; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            forms = [canonical(t) for t in part.column("text").to_pylist()]
            prints = [digest(f) for f in forms]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.string()), pa.array(forms, pa.string())], ["doc_id", "fingerprint", "canonical"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, canonical string")


#: Bits of the marks of fingerprints that several documents have: 1 MB. Other fingerprints' marks only cost rows.
_BITS = 23


def _repeated(prints: DataFrame) -> np.ndarray:
    """Marks of the fingerprints (column `fingerprint`) of several rows, made in the cluster."""
    low = F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long").bitwiseAND((1 << _BITS) - 1)
    several = prints.groupBy("fingerprint").count().where("count > 1").select(low.alias("low"))
    found = several.groupBy(F.shiftright("low", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 31 as int))")).alias("marks")).toArrow()
    out = np.zeros(1 << (_BITS - 5), np.uint32)
    out[found["word"].to_numpy()] = found["marks"].to_numpy().astype(np.uint32)
    return out


def with_classes(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[str], str] = _digest) -> DataFrame:
    """The rows of prints (doc_id, fingerprint, ...) with class_id and class_size.

    Fingerprints of one row are classes of their own. The canonical texts of the others are compared byte for byte: only
    these texts move, and equal ones are combined before they do. A fingerprint with one canonical text, as all should be, is a class;
    one with several (which only a collision makes) is parted among its documents.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_repeated(prints))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                form = canonical(text)
                own = digest(form)
                low = int(own[:15], 16) & ((1 << _BITS) - 1)
                if marks.value[low >> 5] >> np.uint32(low & 31) & np.uint32(1):
                    rows.append((doc_id, own, form))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["doc_id", "fingerprint", "canonical"])

    rows = common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, canonical string")
    found = rows.groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    found = common.written(found, "digest-classes")
    texts = found.groupBy("fingerprint").agg(F.count("*").alias("texts"), F.first("class_id").alias("class_id"), F.first("class_size").alias("class_size"))
    out = prints.join(texts.where("texts = 1 and class_size > 1").select("fingerprint", "class_id", "class_size"), "fingerprint", "left")
    parted = texts.where("texts > 1").select("fingerprint")
    if parted.take(1):
        odd = rows.join(parted, "fingerprint", "left_semi").join(found, ["fingerprint", "canonical"])
        odd = odd.groupBy("doc_id", "fingerprint").agg(F.min("class_id").alias("odd_id"), F.min("class_size").alias("odd_size"))
        same = prints["doc_id"].eqNullSafe(odd["doc_id"]) & (out["fingerprint"] == odd["fingerprint"])
        out = out.join(odd, same, "left").select(*[out[c] for c in prints.columns], F.coalesce("class_id", "odd_id").alias("class_id"), F.coalesce("class_size", "odd_size").alias("class_size"))
    alone = F.col("class_size").isNull()
    return out.select(*prints.columns, F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[str], str] = _digest) -> DataFrame:
    """doc_id, fingerprint, class_id (smallest doc_id with the same canonical text), class_size: one row a document.

    Classes are (fingerprint, canonical text): within a bucket of equal fingerprints the bytes decide. The classes come back
    to the documents by an equi-join whose hot keys Spark can split. A document like no other is a class of its own. Null ids belong to a class but
    never name it. Null text counts as empty, an empty table gives no rows, other columns are ignored.
    """
    return with_classes(docs, fingerprints(docs, id_col, text_col, digest).select("doc_id", "fingerprint"), id_col, text_col, digest)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STEP = "kind int, part int, text string, " + EDITED


def _rows(pairs: list[tuple]) -> dict[str, list]:
    """Columns of EDITED for (doc_id, text, fingerprint, next text, next fingerprint)."""
    out: dict[str, list] = {c.split()[0]: [] for c in EDITED.split(", ")}
    for doc_id, text, own, after, after_print in pairs:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        edited_print = fingerprint(edited)
        values = (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, edited_print, likeness(own, edited_print), likeness(own, after_print))
        for column, v in zip(out.values(), values):
            column.append(v)
    return out


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document (in the order of common.in_order; the last wraps round).

    One range exchange brings neighbours together. Only the documents at the ends of partitions miss their
    successor: these (two a partition) are written apart and joined to it by partition number. Null ids come first.
    A single document is its own successor. An empty table gives no rows.
    """
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: done; 1: the partition's first document; 2: its last one."""
        number = TaskContext.get().partitionId()

        def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": kind, "part": number, "text": text, "doc_id": doc_id}], schema)

        held = None
        for part in common.chunks(batches):
            pairs = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                own = fingerprint(text)
                if held is None:
                    yield edge(1, doc_id, text)
                else:
                    pairs.append((*held, text, own))
                held = (doc_id, text, own)
            n = len(pairs)
            yield pa.RecordBatch.from_pydict({"kind": [0] * n, "part": [number] * n, "text": [None] * n} | _rows(pairs), schema)
        if held is not None:
            yield edge(2, *held[:2])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, t, fingerprint(t), a, fingerprint(a)) for d, t, a in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")))]
            yield pa.RecordBatch.from_pydict(_rows(rows), pa.schema([f for f in schema if f.name not in ("kind", "part", "text")]))

    ordered = common.in_order(common.id_text(docs, id_col, text_col))
    step = common.written(ordered.mapInArrow(run, _STEP), "edit-test")
    common.free(docs.sparkSession)
    parts = step.where("kind = 1").select("part")
    turn = Window.orderBy("part")  # one row a partition
    first = parts.agg(F.min("part")).first()[0]
    after = parts.select("part", F.coalesce(F.lead("part").over(turn), F.lit(first)).alias("next_part"))
    heads = step.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    ends = step.where("kind = 2").select("part", "doc_id", "text").join(after, "part").join(heads, "next_part").select("doc_id", "text", "after")
    names = [c.split()[0] for c in EDITED.split(", ")]
    return step.where("kind = 0").select(*names).unionByName(ends.mapInArrow(finish, EDITED))


def op7_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return with_classes(docs, edit_test(docs))

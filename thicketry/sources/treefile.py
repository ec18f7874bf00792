"""Trees as text: a row a node in post-order, fields parted by tabs, rows ended by NUL and line feed.

type, depth, hash, mtime, nbytes, nnodes, name NUL, and for links target NUL; error rows: type, depth, quoted message, name NUL. Before and
after the rows stand comment lines that hold JSON. Names are bytes: they may hold tabs and line feeds, and bytes that are not
UTF-8 pass through string columns untouched (cast to binary to see them).
"""

from __future__ import annotations

import json
import locale
import platform
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions import model as M
from ..operators.hashset import post_order
from . import files

#: The version of the row format, and the column names of the header's last line.
FORMAT = 240616
FIELDS = ["type", "depth", "hash", "modtime", "nbytes", "nfiles", "name"]
#: Rows of a file that one window looks at.
CHUNK_BITS = 20


def lines(nodes: DataFrame) -> DataFrame:
    """path, line: rows without their final NUL and line feed."""
    text = lambda c: F.col(c).cast("string")
    row = F.concat_ws("\t", "type", text("depth"), "hash", text("mtime"), text("nbytes"), text("nnodes"), "name")
    link = F.when(F.col("type").isin("L", "B"), F.concat(F.lit("\0\t"), F.coalesce("link_target", F.lit("")))).otherwise(F.lit(""))
    error = F.concat_ws("\t", "type", text("depth"), F.concat(F.lit('"'), F.coalesce("err_msg", F.lit("")), F.lit('"')), "name")
    return nodes.select("path", F.when(F.col("type") == "E", error).otherwise(F.concat(row, link)).alias("line"))


def comment(values: dict) -> str:
    return "".join(f"# {line}\n" for line in json.dumps(values, indent=2, sort_keys=True).split("\n"))


def make_header(excludes: list[str], start: int | None = None) -> dict:
    return {"compiler": f"python {platform.python_version()}", "excludePatterns": list(excludes), "locale": locale.getlocale()[0] or "C", "program": f"thicketry {__version__}", "scanStart": int(time.time()) if start is None else start, "system": f"{platform.machine()}-{platform.system().lower()}", "treeFormat": FORMAT}


def make_footer(end: int | None = None) -> dict:
    return {"scanEnd": int(time.time()) if end is None else end}


def write_tree(nodes: DataFrame, path: str, excludes: list[str] = (), header: dict | None = None, footer: dict | None = None) -> None:
    """Writes one file. Spark sorts and writes the parts; the driver only strings them together, block by block."""
    body = lines(nodes).join(nodes.select("path", post_order().alias("turn")), "path").orderBy("turn").select(F.concat("line", F.lit("\0")).alias("value"))
    parts = files.uri(path) + ".parts"
    body.write.mode("overwrite").text(parts)
    head = comment(header or make_header(excludes)) + "# " + "\t".join(FIELDS) + "\n"
    files.join_parts(parts, path, head.encode(), comment(footer or make_footer()).encode())


def row_stream(nodes: DataFrame) -> Iterator[bytes]:
    """The rows alone, one after the other; the driver holds a partition of them at a time."""
    rows = lines(nodes).join(nodes.select("path", post_order().alias("turn")), "path").orderBy("turn").select(F.col("line").cast("binary"))
    for r in rows.toLocalIterator():
        yield bytes(r[0]) + b"\0\n"


def serialize(nodes: DataFrame) -> bytes:
    """The rows alone, for small trees."""
    return b"".join(row_stream(nodes))


def _after_comments(value: Column) -> Column:
    """What follows the comment lines that a value begins with. The place is that of the first line feed without a # after it: cut by place, the
    bytes of names stay as they are, and no header is too long."""
    at = F.instr(F.replace(value, F.lit("\n#"), F.lit("\0#")), "\n")
    return F.when(~value.startswith("#"), value).when(at == 0, F.lit("")).otherwise(value.substr(at + 1, F.length(value)))


def read_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """tree (file), seq, and the fields of every row, in no order but seq; a row that can't be read fails the job."""
    raw = spark.read.option("lineSep", "\0\n").text([files.uri(p) for p in paths])
    raw = raw.select(F.input_file_name().alias("tree"), F.monotonically_increasing_id().alias("seq"), _after_comments(F.col("value")).alias("row"))
    return parse_rows(raw.where("row <> ''"))


def parse_rows(raw: DataFrame) -> DataFrame:
    """Fields of `row`, other columns kept."""
    parts, short = F.split("row", "\t", 7), F.split("row", "\t", 4)
    error = F.substring("row", 1, 1) == "E"
    # names and targets are cut out by bytes: they need not be UTF-8
    after = lambda text, head: text.substr(F.length(head) + 2, F.length(text))
    rest = after(F.col("row"), F.substring_index("row", "\t", 6))
    cut = F.instr(rest, "\0")
    good = F.when(error, F.size(short) == 4).otherwise(F.col("row").rlike(r"^[DFLB]\t-?\d+\t[^\t]+\t-?\d+\t-?\d+\t-?\d+\t"))
    checked = F.when(good, F.get(short, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not a tree row: "), F.substring("row", 1, 200))))
    number = lambda i: F.when(~error, F.get(parts, F.lit(i)).try_cast("long"))
    return raw.select(
        *[c for c in raw.columns if c != "row"],
        checked.alias("type"),
        F.get(short, F.lit(1)).try_cast("int").alias("depth"),
        F.when(error, F.lit(M.ERROR_HASH)).otherwise(F.get(parts, F.lit(2))).alias("hash"),
        F.coalesce(number(3), F.lit(0)).alias("mtime"),
        F.coalesce(number(4), F.lit(0)).alias("nbytes"),
        F.coalesce(number(5), F.lit(1)).alias("nnodes"),
        F.when(error, after(F.col("row"), F.substring_index("row", "\t", 3))).otherwise(F.substring_index(rest, "\0", 1)).alias("name"),
        F.when(~error & (cut > 0), rest.substr(cut + 2, F.length(rest))).alias("link_target"),
        F.when(error, _unquoted(F.get(short, F.lit(2)))).alias("err_msg"),
    )


def _unquoted(text: Column) -> Column:
    inner = F.when(text.startswith('"'), text.substr(F.lit(2), F.length(text))).otherwise(text)
    return F.when(inner.endswith('"'), inner.substr(F.lit(1), F.length(inner) - 1)).otherwise(inner)


def rebuild_paths(rows: DataFrame) -> DataFrame:
    """rows (tree, seq, depth, name, …) with path and parent: in post-order an ancestor is the next row of its depth.

    A file is cut into chunks of 2**CHUNK_BITS rows; windows look within a chunk, and what lies beyond comes from a table with one row a chunk.
    """
    top = rows.agg(F.max("depth")).first()[0] or 0
    rows = rows.withColumn("chunk", F.shiftright("seq", CHUNK_BITS))
    levels = range(top)
    at = lambda k: F.when(F.col("depth") == k, F.col("name"))
    heads = rows.groupBy("tree", "chunk").agg(*[F.min_by(at(k), F.when(F.col("depth") == k, F.col("seq"))).alias(f"head{k}") for k in levels], F.count("*").alias("rows"))
    later = Window.partitionBy("tree").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("tree", "chunk", *[F.last(f"head{k}", ignorenulls=True).over(later).alias(f"later{k}") for k in levels])
    after = Window.partitionBy("tree", "chunk").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select("*", *[F.last(at(k), ignorenulls=True).over(after).alias(f"near{k}") for k in levels])
    met = near.join(heads, ["tree", "chunk"])
    above = F.array(*[F.coalesce(f"near{k}", f"later{k}") for k in levels]) if top else F.array().cast("array<string>")
    parent = F.when(F.col("depth") > 0, F.array_join(F.slice(above, F.lit(1), F.col("depth")), "/"))
    return met.withColumn("parent", parent).withColumn("path", F.concat_ws("/", "parent", "name")).drop("chunk", *[f"{p}{k}" for p in ("near", "later") for k in levels])


def read_tree(spark: SparkSession, path: str, max_depth: int | None = None, rows: Column | None = None) -> DataFrame:
    """The node frame of one file; error rows stay. A file without rows gives one error node.

    max_depth and rows (a condition on type, depth, hash, mtime, nbytes, nnodes and name) drop rows as they are read, before any path is rebuilt; directories
    are needed for that and dropped afterwards.
    """
    found = read_rows(spark, path)
    if max_depth is not None:
        found = found.where(F.col("depth") <= max_depth)
    if rows is not None:
        found = found.where((F.col("type") == "D") | rows)
    whole = rebuild_paths(found).select(*M.NODE_COLUMNS)
    if rows is not None:
        whole = whole.where(rows)
    if whole.take(1) or root_row(spark, path).take(1):
        return whole
    return spark.createDataFrame([(path, None, path.rsplit("/", 1)[-1], 0, "E", M.ERROR_HASH, 0, 0, 1, None, "no rows parsed")], M.NODE_SCHEMA)


def read_header(path: str) -> dict:
    """The header's values, however short the file or long the header is."""
    text, at = b"", 0
    while True:
        block = files.read_bytes(path, at, 1 << 16)
        text, at = text + block, at + len(block)
        lines_ = text.split(b"\n")
        stop = next((i for i, x in enumerate(lines_[:-1]) if not x.startswith(b"# ")), None)
        if stop is not None or not block:
            return _json(lines_[: len(lines_) if stop is None else stop])


def _tail(path: str, marks: int) -> bytes:
    """The end of the file from its `marks`-th row end from behind on, all of it if it has fewer: read in growing pieces."""
    size = 1 << 13
    while True:
        text = files.read_bytes(path, -size)
        parts = text.rsplit(b"\0\n", marks)
        if len(parts) > marks or len(text) < size:
            return b"\0\n".join(parts[1:] if len(parts) > marks else parts)
        size *= 4


def read_footer(path: str) -> dict:
    return _json(_tail(path, 1).split(b"\n"))


def _json(comments: list[bytes]) -> dict:
    text = "\n".join(c[2:].decode() for c in comments if c.startswith(b"# "))
    return json.loads(text[: text.rindex("}") + 1])


def root_row(spark: SparkSession, path: str) -> DataFrame:
    """The fields of the last row, which is the root's, from the end of the file alone; no row if there is none."""
    last = _tail(path, 2)
    raw = spark.createDataFrame([(path, 0, last.rsplit(b"\0\n", 1)[0] if b"\0\n" in last else b"")], "tree string, seq long, row binary")
    return parse_rows(raw.withColumn("row", _after_comments(F.col("row").cast("string"))).where("row <> ''"))


def tree_size(spark: SparkSession, path: str) -> int:
    return root_row(spark, path).first()["nnodes"]


def read_file(spark: SparkSession, path: str) -> tuple[dict, DataFrame, dict]:
    """(header, node frame, footer) of one file."""
    return read_header(path), read_tree(spark, path), read_footer(path)


def byte_length(c: Column) -> Column:
    return F.octet_length(c)

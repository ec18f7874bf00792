"""Directories on a file system that all executors mount, as entries of a tree."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model as M
from ..operators import rollup
from ..operators.search import DEFAULT_EXCLUDES
from ..plans.materialize import materialized
from . import treefile

_LISTED = "path binary, full binary, type string, mtime long, own_bytes long, link_target binary, err_msg string"
_ANNEX = re.compile(rb"^SHA256E-[a-z0-9]{2,}--([0-9a-f]{64})(\..*)?$", re.S)


def seconds(ns: int) -> int:
    """Whole seconds, halves to even."""
    whole, rest = divmod(ns, 10**9)
    return whole + (rest > 500_000_000 or (rest == 500_000_000 and whole % 2))


def link_in_tree(path: bytes, target: bytes) -> bool:
    """Whether a link at `path` (below the root, root's name first) leads to a place below the root."""
    if target.startswith(b"/"):
        return False
    depth = path.count(b"/") - 1
    for part in target.split(b"/"):
        depth += {b"..": -1, b".": 0, b"": 0}.get(part, 1)
        if depth < 0:
            return False
    return True


def entry(path: bytes, full: bytes) -> dict:
    """What lies at a place, without its content."""
    row = {"path": path, "full": full, "type": "F", "mtime": 0, "own_bytes": 0, "link_target": None, "err_msg": None}
    try:
        st = os.lstat(full)
        row |= {"mtime": seconds(st.st_mtime_ns), "own_bytes": st.st_size}
        if stat.S_ISLNK(st.st_mode):
            target = os.readlink(full)
            row |= {"type": "B", "link_target": target}
            place = os.path.join(os.path.dirname(full), target)
            if link_in_tree(path, target) and os.path.exists(place) and not os.path.isdir(place):
                there = os.stat(place)
                row |= {"type": "L", "mtime": max(row["mtime"], seconds(there.st_mtime_ns)), "own_bytes": there.st_size}
        elif stat.S_ISDIR(st.st_mode):
            row["type"] = "D"
        elif not stat.S_ISREG(st.st_mode):
            row |= {"type": "E", "err_msg": "not a regular file"}
    except OSError as e:
        row |= {"type": "E", "err_msg": message(e)}
    return row


def message(error: OSError) -> str:
    return (error.strerror or str(error)).lower()


def list_entries(spark: SparkSession, root: str, excludes: list[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """Entries of all that lies below root, level by level: a job lists all directories of a level.

    Excluded places are dropped while listing, with all below them; patterns see the path below the root. A directory that can't be
    listed is an error node.
    """
    full = os.fsencode(os.path.abspath(root))
    patterns = [re.compile(os.fsencode(p), re.M) for p in excludes]
    name = os.path.basename(full) or b"root"
    first = entry(name, full)
    done = [spark.createDataFrame([tuple(first.values())], _LISTED)]
    level = done[0].where("type = 'D'")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, place in zip(frame["path"], frame["full"]):
                path, place = bytes(path), bytes(place)
                try:
                    names = sorted(os.listdir(place))
                except OSError as e:
                    rows.append({"path": path, "full": place, "type": "E", "mtime": 0, "own_bytes": 0, "link_target": None, "err_msg": message(e)})
                    continue
                for n in names:
                    inner = path + b"/" + n
                    if not any(p.search(inner[len(name) :]) for p in patterns):
                        rows.append(entry(inner, os.path.join(place, n)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LISTED.split(", ")])

    while level.take(1):
        found = materialized(level.select("path", "full").mapInPandas(run, _LISTED), "listing")
        done.append(found)
        level = found.where("type = 'D'")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # an unreadable directory is listed twice: as a directory and as an error, which stands
    bad = out.where("type = 'E'").select("path")
    return out.where("type = 'E'").unionByName(out.where("type <> 'E'").join(bad, "path", "left_anti"))


def _short(hexadecimal: str, full: bool) -> str:
    return hexadecimal if full else base64.b64encode(hexadecimal.encode())[: M.DIGEST_LENGTH].decode()


def hash_entries(listed: DataFrame, full_digest: bool = False, keep_content: bool = False) -> DataFrame:
    """Entries with digests: contents are read a block at a time where the tasks run; a file whose name states its digest isn't read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                r |= {"hash": None, "content": None}
                place, kind = bytes(r["full"]), r["type"]
                try:
                    if kind == "B":
                        r["hash"] = _short(hashlib.sha256(bytes(r["link_target"])).hexdigest(), full_digest)
                    elif kind == "F" and not keep_content and (m := _ANNEX.match(os.path.basename(place))):
                        r["hash"] = _short(m[1].decode(), full_digest)
                    elif kind in "FL":
                        with open(place, "rb") as f:
                            if keep_content:
                                r["content"] = f.read()
                                made = hashlib.sha256(r["content"])
                            else:
                                made = hashlib.file_digest(f, "sha256")
                        r["hash"] = _short(made.hexdigest(), full_digest)
                except OSError as e:
                    r |= {"type": "E", "err_msg": message(e), "link_target": None}
                rows.append(r)
            yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in _LISTED.split(", ")), "hash", "content"])

    made = listed.repartition(F.xxhash64("path")).mapInPandas(run, _LISTED + ", hash string, content binary")
    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  bytes that are not UTF-8 stay as they are
    columns = [text("path"), "type", "hash", "mtime", "own_bytes", text("link_target"), "err_msg"]
    return made.select(*columns, *(["content"] if keep_content else []))


def scan(spark: SparkSession, root: str, excludes: list[str] = DEFAULT_EXCLUDES, full_digest: bool = False) -> DataFrame:
    """The node frame of a directory."""
    return rollup.build(hash_entries(list_entries(spark, root, excludes), full_digest), full_digest)


def scan_contents(spark: SparkSession, root: str, excludes: list[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """path, content of files and links."""
    return hash_entries(list_entries(spark, root, excludes), keep_content=True).where("content is not null").select("path", "content")


def read_or_scan(spark: SparkSession, path: str, excludes: list[str] = DEFAULT_EXCLUDES, max_depth: int | None = None) -> DataFrame:
    """A saved tree if path is a file, a scan if it is a directory; nodes below max_depth are left out, of files as they are read."""
    if os.path.isdir(path):
        nodes = scan(spark, path, excludes)
        return nodes if max_depth is None else nodes.where(nodes["depth"] <= max_depth)
    if os.path.isfile(path) or "://" in path:
        return treefile.read_tree(spark, path, max_depth)
    raise FileNotFoundError(path)


def write_directory(contents: dict[str, bytes | None], root: str) -> None:
    """Small trees on disk: relative path to content, None for a directory. Refuses to overwrite."""
    if os.path.lexists(root):
        raise FileExistsError(root)
    os.makedirs(root)
    for path, content in contents.items():
        place = os.path.join(root, path)
        if content is None:
            os.makedirs(place, exist_ok=True)
        else:
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(place, "xb") as f:
                f.write(content)

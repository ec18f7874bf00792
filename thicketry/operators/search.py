"""Searches over node frames: bounds, types, exclusion sets, labels by regex, output lines."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model as M

#: What a scan leaves out unless told otherwise (editor swap files, folder settings, property lists, workflow caches).
DEFAULT_EXCLUDES = [r"\.sw.*", r"\.DS_Store$", r"\.plist$", r"\.snakemake.*"]

#: POSIX classes that Java's regexes spell differently.
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "blank": r" \t", "punct": r"\p{Punct}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}"}


@dataclass(frozen=True)
class Search:
    """A conjunction of the parts that are given; without any it matches everything."""

    dir_contains_path: str | None = None
    base_name_regex: str | None = None
    whole_name_regex: str | None = None


@dataclass(frozen=True)
class SearchConfig:
    """All bounds are inclusive; what is None doesn't restrict."""

    min_bytes: int | None = None
    max_bytes: int | None = None
    min_depth: int | None = None
    max_depth: int | None = None
    min_files: int | None = None
    max_files: int | None = None
    min_mtime: int | None = None
    max_mtime: int | None = None
    types: str | None = None
    exclude_regexes: tuple[str, ...] = ()
    exclude_sets: tuple[DataFrame, ...] = ()
    searches: tuple[tuple[str, tuple[Search, ...]], ...] = field(default=())


def default_config() -> SearchConfig:
    return SearchConfig(exclude_regexes=tuple(DEFAULT_EXCLUDES))


def single_search(config: SearchConfig, regex: str, label: str = "unlabeled") -> SearchConfig:
    return replace(config, searches=((label, (Search(whole_name_regex=regex),)),))


def parse_searches(text: str) -> tuple[tuple[str, tuple[Search, ...]], ...]:
    """Labeled searches from JSON: an array of [label, [search, ...]], order kept."""
    names = {"dirContainsPath": "dir_contains_path", "baseNameMatchesRegex": "base_name_regex", "wholeNameMatchesRegex": "whole_name_regex"}
    out = []
    for label, searches in json.loads(text):
        for s in searches:
            if unknown := set(s) - set(names):
                raise ValueError(f"unknown search fields {sorted(unknown)}")
        out.append((label, tuple(Search(**{names[k]: v for k, v in s.items() if v is not None}) for s in searches)))
    return tuple(out)


def java_regex(pattern: str) -> str:
    """An extended POSIX pattern as Java's: case-insensitive, ^ and $ at every line."""
    return "(?imd)" + re.sub(r"\[:(\w+):\]", lambda m: _POSIX[m[1]], pattern)


def bounds(config: SearchConfig) -> Column:
    """The conjunction of all bounds and types. Error nodes never match."""
    keep = F.col("type") != "E"
    for column, low, high in (("depth", config.min_depth, config.max_depth), ("nbytes", config.min_bytes, config.max_bytes), ("nnodes", config.min_files, config.max_files), ("mtime", config.min_mtime, config.max_mtime)):
        if low is not None:
            keep &= F.col(column) >= low
        if high is not None:
            keep &= F.col(column) <= high
    if config.types is not None:
        keep &= F.col("type").isin(*config.types)
    return keep


def contains_path(nodes: DataFrame, inner: str) -> DataFrame:
    """path of each directory that has a descendant at `inner`, counted from the directory."""
    steps = inner.strip("/").count("/") + 1
    tail = F.slice(M.components(F.col("path")), -steps, steps)
    here = nodes.where((F.col("depth") >= steps) & (F.array_join(tail, "/") == inner.strip("/")))
    return here.select(F.array_join(F.slice(M.components(F.col("path")), F.lit(1), F.col("depth") + 1 - steps), "/").alias("path")).distinct()


def labeled(nodes: DataFrame, searches: tuple[tuple[str, tuple[Search, ...]], ...]) -> DataFrame:
    """nodes with `label`: the first label of which any search matches, else null. A label without searches never matches."""
    paths = {s.dir_contains_path for _, group in searches for s in group if s.dir_contains_path is not None}
    marks = {p: f"__contains_{i}" for i, p in enumerate(sorted(paths))}
    out = nodes
    for p, mark in marks.items():
        out = out.join(contains_path(nodes, p).withColumn(mark, F.lit(True)), "path", "left")

    def matches(s: Search) -> Column:
        found = F.lit(True)
        if s.dir_contains_path is not None:
            found &= F.coalesce(F.col(marks[s.dir_contains_path]), F.lit(False))
        if s.base_name_regex is not None:
            found &= F.col("name").rlike(java_regex(s.base_name_regex))
        if s.whole_name_regex is not None:
            found &= F.col("path").rlike(java_regex(s.whole_name_regex))
        return found

    choices = []
    for label, group in searches:
        any_of = F.lit(False)
        for s in group:
            any_of |= matches(s)
        choices.append(F.when(any_of, F.lit(label)))
    return out.withColumn("label", F.coalesce(*choices, F.lit(None).cast("string"))).drop(*marks.values())


def topmost(found: DataFrame) -> DataFrame:
    """Rows without those that have a proper ancestor among them: ancestors are exploded and met by equality."""
    above = found.select(F.col("path").alias("above"))
    shadowed = found.select("path", F.explode(M.ancestors(F.col("path"))).alias("above")).join(above, "above", "left_semi").select("path")
    return found.join(shadowed, "path", "left_anti")


def without_set(nodes: DataFrame, *sets: DataFrame) -> DataFrame:
    """Nodes whose hash is in none of the sets (tables with a hash column); Spark broadcasts a set only below its own limit."""
    for s in sets:
        nodes = nodes.join(s.select("hash"), "hash", "left_anti")
    return nodes


def find(nodes: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The nodes that match, with `label`. With searches, a match hides everything below it."""
    kept = without_set(nodes.where(bounds(config)), *config.exclude_sets)
    if not config.searches:
        return kept.withColumn("label", F.lit(None).cast("string"))
    marked = labeled(nodes, config.searches).select("path", "label").where("label is not null")
    return topmost(kept.join(marked, "path"))


def formatter(fmt: str) -> list[Column]:
    """Columns of an output format: t type, h hash, d depth, m time, b bytes, f nodes, l label; repeats count once."""
    known = {"t": F.col("type"), "h": F.col("hash"), "d": F.col("depth"), "m": F.col("mtime"), "b": F.col("nbytes"), "f": F.col("nnodes"), "l": F.col("label")}
    if bad := [c for c in fmt if c not in known]:
        raise ValueError(f"unknown format characters {''.join(bad)!r} in {fmt!r}")
    return [known[c].cast("string") for c in dict.fromkeys(fmt)]


def path_lines(found: DataFrame, fmt: str = "", searches: bool = True) -> DataFrame:
    """path, line: the wanted fields and the path, parted by tabs. Sort by the path's components for a listing in tree order."""
    if "l" in fmt and not searches:
        raise ValueError("the format asks for labels, but there are no searches")
    return found.select("path", F.concat_ws("\t", *formatter(fmt), F.col("path")).alias("line"))


def contains_hash(nodes: DataFrame, value: str) -> bool:
    return bool(nodes.where((F.col("type") != "E") & (F.col("hash") == value)).take(1))


def with_presence(nodes: DataFrame, other: DataFrame) -> DataFrame:
    """nodes with `present`: whether another tree holds a node of that hash (errors aside). One row a hash is met."""
    there = other.where("type <> 'E'").select("hash").distinct().withColumn("present", F.lit(True))
    return nodes.join(there, "hash", "left").withColumn("present", F.coalesce("present", F.lit(False)))

"""Command line: version, info, hash, diff, dupes, set-add, find."""

from __future__ import annotations

import argparse
import contextlib
import logging
import os
import sys
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import model as M
from .operators import diff as D
from .operators import dupes as U
from .operators import hashset as H
from .operators import info as I
from .operators import search as S
from .sources import scan as SC
from .sources import setfile, treefile


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="thicketry", description="Trees of content-addressed nodes.")
    top.add_argument("-v", "--verbose", action="store_true", help="tell scan errors on stderr")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("info").add_argument("path")
    p = sub.add_parser("hash")
    p.add_argument("path")
    p.add_argument("--excludes-from", help="file of regexes, one a line, in place of the defaults")
    p.add_argument("--output")
    p = sub.add_parser("diff")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--output")
    p = sub.add_parser("dupes")
    p.add_argument("hashes")
    p.add_argument("--output")
    p.add_argument("--max-depth", type=int)
    p = sub.add_parser("set-add")
    p.add_argument("--set", required=True)
    p.add_argument("--note")
    p.add_argument("paths", nargs="+")
    p = sub.add_parser("find")
    p.add_argument("path")
    one = p.add_mutually_exclusive_group()
    one.add_argument("--search-regex")
    one.add_argument("--searches-json")
    p.add_argument("--search-label", default="unlabeled")
    for name in ("files", "size", "modtime", "depth"):
        p.add_argument(f"--min-{name}", type=int)
        p.add_argument(f"--max-{name}", type=int)
    p.add_argument("--types")
    p.add_argument("--output")
    p.add_argument("--out-fmt", default="")
    p.add_argument("--exclude-set", action="append", default=[])
    return top


def _emit(texts: Iterable[str], output: str | None, otherwise: str = "") -> None:
    """Writes the texts as they come, `otherwise` if there are none."""
    with open(output, "w", encoding="utf-8", errors="surrogateescape") if output else contextlib.nullcontext(sys.stdout) as f:
        some = False
        for text in texts:
            f.write(text)
            some = True
        if not some:
            f.write(otherwise)


def _read(spark: SparkSession, path: str, verbose: bool, max_depth: int | None = None) -> DataFrame:
    """A saved tree or a scan; if verbose, its errors are told."""
    nodes = SC.read_or_scan(spark, path, max_depth=max_depth)
    if verbose:
        _tell(nodes)
    return nodes


def _tell(nodes: DataFrame) -> None:
    for e in M.errors(nodes).select("path", "err_msg").toLocalIterator():
        logging.error("%s: %s", e["path"], e["err_msg"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(I.version())
        return 0
    spark = spark or SparkSession.builder.appName("thicketry").getOrCreate()
    if args.command == "info":
        print(f"{args.path}:")
        for line in I.summary(treefile.root_row(spark, args.path), treefile.read_header(args.path), treefile.read_footer(args.path)):
            print(f"  {line}")
    elif args.command == "hash":
        excludes = S.DEFAULT_EXCLUDES
        if args.excludes_from:
            with open(args.excludes_from, encoding="utf-8") as f:
                excludes = [x for x in f.read().splitlines() if x]
        header = treefile.make_header(excludes)
        nodes = SC.scan(spark, args.path, excludes)
        if args.verbose:
            _tell(nodes)
        if args.output:
            treefile.write_tree(nodes, args.output, excludes, header)
        else:
            sys.stdout.write(treefile.comment(header) + "# " + "\t".join(treefile.FIELDS) + "\n")
            sys.stdout.flush()
            for row in treefile.row_stream(nodes):
                sys.stdout.buffer.write(row)
            sys.stdout.buffer.flush()
            sys.stdout.write(treefile.comment(treefile.make_footer()))
    elif args.command == "diff":
        found = D.rendered(D.diff(*(_read(spark, p, args.verbose) for p in (args.old, args.new)))).orderBy("line")
        _emit((r[0] + "\n" for r in found.toLocalIterator()), args.output)
    elif args.command == "dupes":
        found = U.explained(_read(spark, args.hashes, args.verbose, args.max_depth), args.max_depth).orderBy("position")
        _emit((r["text"] + "\n" for r in found.toLocalIterator()), args.output, "\n")
    elif args.command == "set-add":
        old = setfile.read_set(spark, args.set) if os.path.exists(args.set) else H.empty(spark)
        trees = [_read(spark, p, args.verbose) for p in args.paths]
        fresh = args.set + ".new"
        setfile.write_set(H.add(old, *trees, note=args.note), fresh)
        os.replace(fresh, args.set)
    elif args.command == "find":
        config = S.SearchConfig(min_bytes=args.min_size, max_bytes=args.max_size, min_depth=args.min_depth, max_depth=args.max_depth, min_files=args.min_files, max_files=args.max_files, min_mtime=args.min_modtime, max_mtime=args.max_modtime, types=args.types, exclude_sets=tuple(setfile.read_set(spark, p) for p in args.exclude_set))
        if args.search_regex is not None:
            config = S.single_search(config, args.search_regex, args.search_label)
        elif args.searches_json:
            with open(args.searches_json, encoding="utf-8") as f:
                config = replace(config, searches=S.parse_searches(f.read()))
        inner = any(s.dir_contains_path is not None for _, group in config.searches for s in group)
        found = S.path_lines(S.find(_read(spark, args.path, args.verbose, None if inner else args.max_depth), config), args.out_fmt, bool(config.searches)).orderBy(M.components(F.col("path")))
        _emit((r["line"] + "\n" for r in found.toLocalIterator()), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())

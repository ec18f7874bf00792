"""Summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__


def tree_info(nodes: DataFrame) -> DataFrame:
    """One row for the root: hash (or ERROR), nodes, bytes."""
    return nodes.where("depth = 0").select("name", F.col("hash"), F.col("nnodes"), F.col("nbytes"))


def summary(nodes: DataFrame, header: dict | None = None, footer: dict | None = None) -> list[str]:
    root = nodes.where("depth = 0").first()
    lines = []
    if header:
        lines.append(f"tree format {header.get('treeFormat')}")
        if footer:
            lines.append(f"took {scan_seconds(header, footer)} seconds to create")
    if root["type"] == "E":
        return [*lines, f"ERROR: {root['err_msg']}"]
    return [*lines, f"contains info on {root['nnodes']} files totaling {root['nbytes']} bytes", f"overall hash is {root['hash']}"]


def scan_seconds(header: dict, footer: dict) -> int:
    return footer["scanEnd"] - header["scanStart"]


def version() -> str:
    return __version__

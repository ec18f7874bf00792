"""Opening single files by local path or URI from the driver."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def read_bytes(path: str, at: int = 0, size: int | None = None) -> bytes:
    fs, name = locate(path)
    with fs.open_input_file(name) as f:
        f.seek(max(0, f.size() + at) if at < 0 else at)
        return f.read(size)


def join_parts(folder: str, out: str, before: bytes = b"", after: bytes = b"") -> None:
    """One file from the part files of a folder in name order, a block at a time."""
    fs, name = locate(folder)
    parts = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(name)) if "part-" in i.base_name and not i.base_name.startswith("."))
    target, out_name = locate(out)
    with target.open_output_stream(out_name) as sink:
        sink.write(before)
        for p in parts:
            with fs.open_input_stream(p) as f:
                while block := f.read(1 << 20):
                    sink.write(block)
        sink.write(after)
    fs.delete_dir(name)

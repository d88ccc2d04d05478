"""File access from tasks: any store that Arrow's file systems know, with safe writes."""

from __future__ import annotations

import posixpath
import re
import uuid

import pyarrow.fs as pafs


def qualified(spark, path: str) -> str:
    """A path that means the same to Spark's readers and to `open_fs`: plain ones get the default file system's name."""
    if "://" in path or path.startswith("file:"):
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path if default.startswith("file:") else default.rstrip("/") + "/" + path.lstrip("/")


def open_fs(path: str):
    """(file system, path inside it) of a plain path or a URI; plain paths are local (see `qualified`)."""
    path = re.sub("^s3[an]://", "s3://", path)
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = path[len("file:"):]
            return pafs.LocalFileSystem(), path
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def write_file(path: str, data: bytes) -> None:
    """Write under a private name, then rename: a retried task leaves no torn file."""
    fs, p = open_fs(path)
    folder, name = posixpath.split(p)
    fs.create_dir(folder, recursive=True)
    temp = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, p)


def read_file(path: str) -> bytes:
    fs, p = open_fs(path)
    with fs.open_input_stream(p) as f:
        return f.read()


def read_optional(path: str) -> bytes | None:
    """A file's bytes, or None where there is none."""
    fs, p = open_fs(path)
    try:
        with fs.open_input_stream(p) as f:
            return f.read()
    except FileNotFoundError:
        return None


def remove_folder(path: str) -> None:
    """Remove a folder and all below it, where there is one."""
    fs, p = open_fs(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def read_range(path: str, offset: int, size: int) -> bytes:
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        return f.read_at(size, offset)

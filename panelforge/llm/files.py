"""Files in the shared folder, reached from Python workers by pyarrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def create(uri: str):
    """An output stream; the folder is made if needed."""
    fs, path = _at(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def open_random(uri: str):
    fs, path = _at(uri)
    return fs.open_input_file(path)


def open_stream(uri: str):
    fs, path = _at(uri)
    return fs.open_input_stream(path)


def fresh(folder: str, suffix: str) -> str:
    """A name that no other attempt of a task uses: only files that a finished task reports are ever read."""
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"

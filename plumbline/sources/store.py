"""Files in the shared store, opened from the driver or an executor by URI."""

from __future__ import annotations

import posixpath
import re

from pyarrow import fs

#: Hadoop's names of stores that pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "webhdfs": "hdfs"}


def renamed(uri: str) -> str:
    """The URI as pyarrow knows it."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(/*)(.*)", uri, re.S)
    if not m:
        return uri
    scheme = SCHEMES.get(m[1].lower(), m[1].lower())
    return f"file:///{m[3]}" if scheme == "file" and len(m[2]) != 2 else f"{scheme}:{m[2]}{m[3]}"


def opened(uri: str):
    """(file system, path). The driver passes paths that runtime.qualified has given a scheme; one without is local."""
    uri = renamed(uri)
    return fs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri) else (fs.LocalFileSystem(), uri)


def move(source: str, target: str) -> None:
    """Give a file another name in its store."""
    system, path = opened(source)
    system.move(path, opened(target)[1])


def open_output(uri: str):
    """A stream that writes a new file. Files of a task's attempt have names of their own; a manifest says which count."""
    system, path = opened(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A file that can be read at any place."""
    system, path = opened(uri)
    return system.open_input_file(path)


def delete(uri: str) -> None:
    """Delete a file; one that is already gone is no error, since a task may run twice."""
    system, path = opened(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)

"""Files in a folder that all executors share, on whatever file system its URI names."""

from __future__ import annotations

import contextlib
import uuid
from typing import IO

import pyarrow as pa
from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path on it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Output:
    """A file that appears under its name only once it is whole, so that a lost or repeated task leaves no part of one."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out: pa.NativeFile = self.fs.open_output_stream(self.part)
        self.at = 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)

    def abandon(self) -> None:
        """Deletes the part of a file that will not be whole; nothing if it has its name already."""
        with contextlib.suppress(Exception):
            self.out.close()
        with contextlib.suppress(FileNotFoundError):
            self.fs.delete_file(self.part)


def open_input(uri: str) -> IO[bytes]:
    """A file for reads at any place."""
    f, path = open_fs(uri)
    return f.open_input_file(path)

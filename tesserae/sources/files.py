"""Range reads on whatever file system a URI names."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs


def open_input(uri: str) -> pa.NativeFile:
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)
    f, path = fs.FileSystem.from_uri(uri)
    return f.open_input_file(path)

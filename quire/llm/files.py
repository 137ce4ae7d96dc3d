"""Raw files in the shared folder, written and read by executors."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a file:// URI or of a plain path; None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_whole(uri: str, chunks) -> int:
    """Writes a file under a name of this attempt's own and then moves it into place: retries and twins are harmless."""
    own, n = f"{uri}.{uuid.uuid4().hex}.tmp", 0
    if path := local_path(own):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            for chunk in chunks:
                n += out.write(chunk)
        os.replace(path, local_path(uri))
        return n
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(own)
    with store.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
            n += memoryview(chunk).nbytes
    store.move(path, fs.FileSystem.from_uri(uri)[1])
    return n


def mapped(uri: str, kind: np.dtype) -> np.ndarray:
    """The file as an array: memory-mapped where the store is a file system, read otherwise."""
    if path := local_path(uri):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), kind)

"""Files in the cluster's shared storage, read and written by tasks.

A file is written under a name of its own attempt and then renamed, so a repeated or a second running
attempt of a task leaves one whole file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: Iterable[bytes]) -> None:
    """Write the parts one after another as one file; its folder is made if missing."""
    system, path = _filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    system.move(attempt, path)


def read_file(uri: str) -> bytes:
    system, path = _filesystem(uri)
    with system.open_input_file(path) as file:
        return file.read()


def open_range(uri: str, start: int = 0, end: int | None = None, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The bytes between two offsets, in chunks."""
    system, path = _filesystem(uri)
    with system.open_input_file(path) as file:
        file.seek(start)
        left = (file.size() if end is None else end) - start
        while left > 0 and (data := file.read(min(chunk, left))):
            yield data
            left -= len(data)


def mapped(uri: str):
    """The file as an array of bytes: memory-mapped where the storage is mounted, else read."""
    import numpy as np

    system, path = _filesystem(uri)
    if system.type_name != "local":
        return np.frombuffer(read_file(uri), np.uint8)
    return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)

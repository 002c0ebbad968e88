"""Files by path on any store that Arrow opens, read whole or by byte range."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs

#: Ranges closer together than this are fetched as one.
GAP = 1 << 14
#: Bytes that a streamed pass holds at a time.
CHUNK = 1 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and its name there. Paths with a scheme come from Spark's lister, which escapes names; the store takes them as they are."""
    if ":" not in path.split("/")[0]:
        return pafs.LocalFileSystem(), path
    store, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store, unquote(name)


def open_input(path: str) -> pa.NativeFile:
    store, name = located(path)
    return store.open_input_file(name)


def read_file(path: str) -> bytes:
    with open_input(path) as f:
        return f.read()


def output(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path to write to and its name there; a plain path is a local or mounted one."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), os.path.abspath(path))


def put(path: str, data: bytes) -> None:
    """Writes a file under another name and renames it, so a path never holds a part of a file."""
    store, at = output(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, at)


def digest(path: str) -> str:
    """SHA-256 of a file of any size, in hex: one chunk is held at a time."""
    h = hashlib.sha256()
    store, name = located(path)
    with store.open_input_stream(name) as f:
        while block := f.read(CHUNK):
            h.update(block)
    return h.hexdigest()


class Ranges:
    """Byte ranges of a file, with a count of what was read."""

    def __init__(self, path: str):
        self._file = open_input(path)
        self.size, self.bytes_read = self._file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("the file ends early")
        self.bytes_read += n
        return self._file.read_at(n, at)

    def fetch(self, wanted: Iterable[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
        """The bytes of each (offset, size), read in order of offset; neighbours are read together."""
        out, run = {}, []

        def take() -> None:
            begin, end = run[0][0], max(a + n for a, n in run)
            data = self.read(begin, end - begin)
            for a, n in run:
                out[a, n] = data[a - begin : a - begin + n]

        for at, n in sorted(set(wanted)):
            if run and at > max(a + k for a, k in run[-1:]) + GAP:
                take()
                run = []
            run.append((at, n))
        if run:
            take()
        return out

    def close(self) -> None:
        self._file.close()

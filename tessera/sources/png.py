"""PNG files with the standard library: 8-bit grey, RGB and RGBA, with the physical scale."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 6: 4}


def encode(a: np.ndarray, mpp: float | None = None) -> bytes:
    """a: (h, w) or (h, w, 3) bytes; mpp: micrometres per pixel, stored as pixels per metre."""
    a = np.ascontiguousarray(a, dtype=np.uint8)
    h, w = a.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if a.ndim == 2 else a.shape[2]]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    scale = chunk(b"pHYs", struct.pack(">IIB", round(1e6 / mpp), round(1e6 / mpp), 1)) if mpp else b""
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + scale + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ValueError("the PNG file ends early")
        yield name, body
        at += 12 + n


def header(data: bytes) -> tuple[int, int, float | None, float | None]:
    """(width, height, mpp_x, mpp_y); the scale is None where the file has none."""
    w = h = None
    mx = my = None
    for name, body in _chunks(data):
        if name == b"IHDR":
            w, h = struct.unpack(">II", body[:8])
        elif name == b"pHYs" and body[8] == 1 and min(struct.unpack(">II", body[:8])) > 0:
            mx, my = (1e6 / v for v in struct.unpack(">II", body[:8]))
        elif name == b"IDAT":
            break
    if w is None:
        raise ValueError("the PNG file has no header")
    return w, h, mx, my


def lines(data: bytes) -> Iterator[np.ndarray]:
    """The rows of a file from the top, each (w, channels), unpacked as they are asked for; an alpha channel is dropped."""
    shape, last, rest, inflate = None, None, bytearray(), zlib.decompressobj()
    for name, body in _chunks(data):
        if name == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or kind not in _CHANNELS or lace:
                raise ValueError("only plain 8-bit grey, RGB and RGBA files are read")
            shape = (h, w, _CHANNELS[kind])
            last, size, left = np.zeros(w * shape[2], np.uint8), w * shape[2] + 1, h
        elif name == b"IDAT":
            if shape is None:
                raise ValueError("the PNG file has no header")
            while body and left:
                rest += inflate.decompress(body, 1 << 20)
                body = inflate.unconsumed_tail
                n = min(len(rest) // size, left)
                for y in range(n):
                    last = _unfiltered(rest[y * size], np.frombuffer(bytes(rest[y * size + 1 : (y + 1) * size]), np.uint8), last, shape[1], shape[2])
                    yield last.reshape(shape[1], shape[2])[:, :3]
                left -= n
                del rest[: n * size]
    if shape is None:
        raise ValueError("the PNG file has no header")
    if left:
        raise ValueError("the PNG file ends early")


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray, w: int, c: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(w, c), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + up
    row, above = np.zeros(w * c + c, np.int64), np.concatenate([np.zeros(c, np.int64), up.astype(np.int64)])
    for i in range(c, w * c + c):
        a, b, d = row[i - c], above[i], above[i - c]
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa, pb, pd = abs(b - d), abs(a - d), abs(a + b - 2 * d)
            guess = a if pa <= pb and pa <= pd else b if pb <= pd else d
        row[i] = (int(line[i - c]) + guess) & 255
    return row[c:].astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(h, w) for grey, (h, w, 3) for colour; an alpha channel is dropped."""
    a = np.stack(list(lines(data)))
    return a[..., 0] if a.shape[2] == 1 else a

"""Tiled pyramid files of the TIFF kind, classic and with 64-bit offsets: directories, tiles by offset, windows, and a writer.

A directory describes one level and says where each of its tiles stands in the file, so a window costs the bytes of
the tiles that it touches and nothing else. Strips are tiles as wide as the picture. Tiles are read plain or Deflate-packed, with
8 bits a sample, grey or RGB; an alpha channel is dropped. Other packings are refused by name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from tessera.sources.stores import Ranges

#: Tags of a directory.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279
X_RESOLUTION, Y_RESOLUTION, PLANAR, UNIT, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 282, 283, 284, 296, 317, 322, 323, 324, 325, 339
#: Bytes and NumPy kinds of the field types (fractions are two whole numbers).
FIELDS = {1: (1, "u1"), 2: (1, "u1"), 3: (2, "u2"), 4: (4, "u4"), 5: (8, "u4"), 6: (1, "i1"), 7: (1, "u1"), 8: (2, "i2"), 9: (4, "i4"), 10: (8, "i4"), 13: (4, "u4"), 16: (8, "u8"), 17: (8, "i8"), 18: (8, "u8")}
#: Names of packings.
PACKINGS = {1: "none", 2: "CCITT", 3: "CCITT fax 3", 4: "CCITT fax 4", 5: "LZW", 6: "old JPEG", 7: "JPEG", 8: "Deflate", 32773: "PackBits", 32946: "Deflate", 33003: "JPEG 2000", 33005: "JPEG 2000", 34887: "LERC", 50000: "Zstandard", 50001: "WebP"}
READ = (1, 8, 32946)
#: Micrometres of the resolution units inch and centimetre.
UNITS = {2: 25_400.0, 3: 10_000.0}
#: Bytes of unpacked tiles that an open file keeps.
KEPT = 64 << 20


@dataclass(frozen=True)
class Directory:
    width: int
    height: int
    tile_w: int
    tile_h: int
    tiled: bool
    offsets: np.ndarray
    sizes: np.ndarray
    compression: int = 1
    photometric: int = 2
    samples: int = 3
    predictor: int = 1
    planar: int = 1
    bits: tuple[int, ...] = (8,)
    sample_format: int = 1
    mpp_x: float | None = None
    mpp_y: float | None = None
    description: str = ""

    @property
    def columns(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def rows(self) -> int:
        return -(-self.height // self.tile_h)

    def tile_rows(self, row: int) -> int:
        """Rows of pixels that the tiles of a row hold: a last strip ends with the picture, a tile is whole."""
        return self.tile_h if self.tiled else min(self.tile_h, self.height - row * self.tile_h)

    def refusal(self) -> str | None:
        """Why the tiles cannot be read, or None."""
        if self.compression not in READ:
            return f"compression {self.compression} ({PACKINGS.get(self.compression, 'unknown')}) is not read"
        if set(self.bits) != {8} or self.sample_format != 1:
            return f"samples of {','.join(map(str, self.bits))} bits are not read"
        if self.planar != 1:
            return "separate planes are not read"
        if not (self.samples >= 3 and self.photometric == 2 or self.samples in (1, 2) and self.photometric in (0, 1)):
            return f"photometric kind {self.photometric} with {self.samples} samples is not read"
        if self.predictor not in (1, 2):
            return f"predictor {self.predictor} is not read"
        if len(self.offsets) != self.rows * self.columns or len(self.sizes) != len(self.offsets):
            return "the list of tiles is not complete"
        return None


def directories(src: Ranges) -> list[Directory]:
    """The directories of a file in order. Only headers and the lists that they name are read."""
    head = src.read(0, min(16, src.size))
    if head[:2] not in (b"II", b"MM") or len(head) < 8:
        raise ValueError("not a TIFF file")
    order = "<" if head[:2] == b"II" else ">"
    kind = struct.unpack(order + "H", head[2:4])[0]
    if kind == 42:
        wide, at = False, struct.unpack(order + "I", head[4:8])[0]
    elif kind == 43 and len(head) == 16 and struct.unpack(order + "HH", head[4:8]) == (8, 0):
        wide, at = True, struct.unpack(order + "Q", head[8:16])[0]
    else:
        raise ValueError("not a TIFF file")
    word, entry, room = ("Q", 20, 8) if wide else ("I", 12, 4)
    out, seen = [], set()
    while at:
        if at in seen:
            raise ValueError("the directories of the TIFF file run in a circle")
        seen.add(at)
        lead = 8 if wide else 2
        n = struct.unpack(order + ("Q" if wide else "H"), src.read(at, lead))[0]
        body = src.read(at + lead, n * entry + room)
        tags = {}
        for k in range(n):
            e = body[k * entry : (k + 1) * entry]
            tag, field = struct.unpack(order + "HH", e[:4])
            tags[tag] = (field, struct.unpack(order + word, e[4 : 4 + room])[0], e[4 + room :])
        out.append(_directory(src, order, word, tags))
        at = struct.unpack(order + word, body[n * entry :])[0]
    if not out:
        raise ValueError("the TIFF file has no directory")
    return out


def _directory(src: Ranges, order: str, word: str, tags: dict[int, tuple[int, int, bytes]]) -> Directory:
    def value(tag: int) -> np.ndarray | None:
        if tag not in tags or tags[tag][0] not in FIELDS:
            return None
        field, count, inline = tags[tag]
        size, kind = FIELDS[field]
        if size * count > len(inline):
            inline = src.read(struct.unpack(order + word, inline)[0], size * count)
        return np.frombuffer(inline[: size * count], np.dtype(kind).newbyteorder(order)).astype(np.int64)

    def one(tag: int, default: int | None = None) -> int:
        v = value(tag)
        if v is None or not len(v):
            if default is None:
                raise ValueError(f"a TIFF directory has no tag {tag}")
            return default
        return int(v[0])

    width, height = one(WIDTH), one(HEIGHT)
    tiled = TILE_OFFSETS in tags
    tile = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
    places = [value(t) for t in ((TILE_OFFSETS, TILE_SIZES) if tiled else (STRIP_OFFSETS, STRIP_SIZES))]
    if width < 1 or height < 1 or min(tile) < 1 or any(p is None for p in places):
        raise ValueError("a TIFF directory has no picture")
    text = value(DESCRIPTION)
    text = "" if text is None else text.astype(np.uint8).tobytes().rstrip(b"\0").decode("utf-8", "replace")
    said = re.search(r"\bMPP\s*=\s*([0-9.]+)", text)
    scale: list[float | None] = [float(said[1])] * 2 if said else [None, None]
    if not said and one(UNIT, 2) in UNITS:
        for k, tag in enumerate((X_RESOLUTION, Y_RESOLUTION)):
            v = value(tag)
            if v is not None and len(v) == 2 and v.min() > 0:
                scale[k] = UNITS[one(UNIT, 2)] * int(v[1]) / int(v[0])
    bits = value(BITS)
    samples = one(SAMPLES, 1)
    return Directory(
        width, height, *tile, tiled, *places, one(COMPRESSION, 1), one(PHOTOMETRIC, 1), samples, one(PREDICTOR, 1), one(PLANAR, 1) if samples > 1 else 1,
        tuple(bits.tolist()) if bits is not None else (1,), one(SAMPLE_FORMAT, 1), *scale, text,
    )


def pyramid(found: Sequence[Directory]) -> list[Directory]:
    """The levels among the directories, the largest first: those of its shape, tiled if it is. Labels and thumbnails are left out."""
    base = found[0]
    same = [d for d in found if d.tiled == base.tiled and abs(d.width * base.height - base.width * d.height) <= max(base.width, base.height)]
    return sorted(same, key=lambda d: -d.width)


def unpack(data: bytes, tile_w: int, rows: int, compression: int, photometric: int, samples: int, predictor: int) -> np.ndarray:
    """The pixels (rows, tile_w, 3) of a tile."""
    size = rows * tile_w * samples
    if compression != 1:
        data = zlib.decompressobj().decompress(data, size)
    if len(data) < size:
        raise ValueError("a tile ends early")
    a = np.frombuffer(data, np.uint8, size).reshape(rows, tile_w, samples)
    if predictor == 2:
        a = np.cumsum(a, axis=1, dtype=np.uint8)
    if samples < 3:
        a = np.repeat(255 - a[..., :1] if photometric == 0 else a[..., :1], 3, axis=2)
    return a[..., :3]


def paste(out: np.ndarray, x: int, y: int, tile: np.ndarray, tile_x: int, tile_y: int, level_w: int, level_h: int) -> None:
    """Copies what a tile and the picture share with the window ``out`` at (x, y)."""
    x0, y0 = max(x, tile_x), max(y, tile_y)
    x1, y1 = min(x + out.shape[1], tile_x + tile.shape[1], level_w), min(y + out.shape[0], tile_y + tile.shape[0], level_h)
    if x1 > x0 and y1 > y0:
        out[y0 - y : y1 - y, x0 - x : x1 - x] = tile[y0 - tile_y : y1 - tile_y, x0 - tile_x : x1 - tile_x]


class TiffSlide:
    """An open pyramid file. Tiles that were unpacked are kept, up to KEPT bytes, for windows that follow nearby."""

    def __init__(self, path: str, need_scale: bool = True):
        self.source = Ranges(path)
        self._levels = pyramid(directories(self.source))
        base = self._levels[0]
        for d in self._levels:
            if d.refusal():
                raise ValueError(d.refusal())
        if need_scale and not (base.mpp_x and base.mpp_y):
            raise ValueError("the slide has no physical scale")
        self.width, self.height, self.mpp_x, self.mpp_y = base.width, base.height, base.mpp_x, base.mpp_y
        power = re.search(r"\bAppMag\s*=\s*([0-9.]+)", base.description)
        self.vendor, self.objective = "tiff", power[1] if power else None
        self._kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self._held = 0

    def levels(self) -> list[tuple[int, int, int, float]]:
        return [(k, d.width, d.height, (self.width / d.width + self.height / d.height) / 2) for k, d in enumerate(self._levels)]

    def directory(self, k: int) -> Directory:
        if k < 0:
            raise ValueError("a pyramid level is not negative")
        return self._levels[min(k, len(self._levels) - 1)]

    def _tiles(self, k: int, numbers: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        d = self.directory(k)
        for n in numbers:
            if (k, n) in self._kept:
                self._kept.move_to_end((k, n))
        missing = [n for n in numbers if (k, n) not in self._kept and d.sizes[n]]
        got = self.source.fetch((int(d.offsets[n]), int(d.sizes[n])) for n in missing)
        fresh = {}
        for n in missing:
            fresh[n] = unpack(got[int(d.offsets[n]), int(d.sizes[n])], d.tile_w, d.tile_rows(n // d.columns), d.compression, d.photometric, d.samples, d.predictor)
        for n in numbers:
            if n in fresh or (k, n) in self._kept:  # a tile without bytes is blank
                yield n, fresh[n] if n in fresh else self._kept[k, n]
        for n, a in fresh.items():
            self._kept[k, n] = a
            self._held += a.nbytes
        while self._held > KEPT and self._kept:
            self._held -= self._kept.popitem(last=False)[1].nbytes

    def window(self, k: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        """Pixels of a level; what lies outside is black."""
        d, out = self.directory(k), np.zeros((h, w, 3), np.uint8)
        cols = range(max(0, x // d.tile_w), min(d.columns, -(-(x + w) // d.tile_w)))
        rows = range(max(0, y // d.tile_h), min(d.rows, -(-(y + h) // d.tile_h)))
        for n, tile in self._tiles(min(k, len(self._levels) - 1), [r * d.columns + c for r in rows for c in cols]):
            paste(out, x, y, tile, n % d.columns * d.tile_w, n // d.columns * d.tile_h, d.width, d.height)
        return out

    def level(self, k: int) -> np.ndarray:
        d = self.directory(k)
        return self.window(k, 0, 0, d.width, d.height)

    def region(self, x: int, y: int, size: int) -> np.ndarray:
        return self.window(0, x, y, size, size)

    def thumbnail(self, longest: int) -> np.ndarray:
        """Never enlarged; from the smallest level that is large enough, a band of tiles at a time."""
        scale = min(longest / max(self.width, self.height), 1.0)
        h, w = max(1, round(self.height * scale)), max(1, round(self.width * scale))
        k = max(i for i, d in enumerate(self._levels) if i == 0 or (d.width >= w and d.height >= h))
        d = self._levels[k]
        ys, xs = np.arange(h) * d.height // h, np.arange(w) * d.width // w
        out = np.empty((h, w, 3), np.uint8)
        for band in np.unique(ys // d.tile_h).tolist():
            mine = np.flatnonzero(ys // d.tile_h == band)
            part = self.window(k, 0, band * d.tile_h, d.width, min(d.tile_h, d.height - band * d.tile_h))
            out[mine] = part[ys[mine] - band * d.tile_h][:, xs]
        return out


def encode(levels: Sequence[np.ndarray], tile: tuple[int, int] | None = (256, 256), compression: int = 8, big: bool = False, mpp: float | None = None, predictor: int = 1, order: str = "<", text: str = "") -> bytes:
    """A file with a directory for each level, (h, w) or (h, w, 3) bytes each; ``tile`` is (width, height), or None for strips of 16 rows."""
    word, room = ("Q", 8) if big else ("I", 4)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    out, link = bytearray(head), len(head) - room
    for a in levels:
        a = np.ascontiguousarray(a, np.uint8).reshape(a.shape[0], a.shape[1], -1)
        h, w, s = a.shape
        tw, th = tile or (w, 16)
        offsets, sizes = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = a[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                data = part.tobytes() if compression == 1 else zlib.compress(part.tobytes(), 6)
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
        tags: list[tuple[int, int, list[int]]] = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * s), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if s >= 3 else 1])]
        tags += [(SAMPLES, 3, [s]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th])] if tile else [(STRIP_ROWS, 4, [th])]
        places = (TILE_OFFSETS, TILE_SIZES) if tile else (STRIP_OFFSETS, STRIP_SIZES)
        tags += [(places[0], 16 if big else 4, offsets), (places[1], 16 if big else 4, sizes)]
        if text:
            tags.append((DESCRIPTION, 2, [*text.encode(), 0]))
        if mpp:
            tags += [(X_RESOLUTION, 5, [1_000_000, round(100 * mpp)]), (Y_RESOLUTION, 5, [1_000_000, round(100 * mpp)]), (UNIT, 3, [3])]
        packed = []
        for tag, field, values in sorted(tags):
            size, kind = FIELDS[field]
            data = np.array(values, np.int64).astype(np.dtype(kind).newbyteorder(order)).tobytes()
            count = len(values) // 2 if field == 5 else len(values)
            if len(data) > room:
                out += b"\0" * (-len(out) % 8)
                place = len(out)
                out += data
                data = struct.pack(order + word, place)
            packed.append(struct.pack(order + "HH" + word, tag, field, count) + data.ljust(room, b"\0"))
        out += b"\0" * (-len(out) % 8)
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(packed)) + b"".join(packed)
        link = len(out)
        out += b"\0" * room
    return bytes(out)

"""Run parameters: frozen records, dotted overrides, and a reader for the YAML subset that parameter files use."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from hashlib import sha256
from typing import Any

from tessera.sources.stores import put, read_file


# The names and defaults below are those of existing parameter files, which have to stay readable.


@dataclass(frozen=True)
class Tissue:
    level: int = 2
    method: str = "otsu"
    saturation_threshold: int = 25
    max_value: int = 245
    close_radius_um: float = 20.0
    open_radius_um: float = 10.0
    min_object_area_um2: float = 50_000.0
    max_hole_area_um2: float = 200_000.0
    keep_largest_n: int = 0


@dataclass(frozen=True)
class Tiling:
    tile_size: int = 512
    stride: int = 512
    level: int = 0
    min_tissue_fraction: float = 0.5
    save_tiles: bool = True


@dataclass(frozen=True)
class Fat:
    """Segmentation and classification. The small class always ends where the large one begins."""

    method: str = "fixed"
    white_threshold: int = 200
    fill_holes: bool = True
    open_radius_px: int = 2
    close_radius_px: int = 2
    min_area_um2: float = 20.0
    max_area_um2: float = 2000.0
    circularity_min: float = 0.65
    solidity_min: float = 0.85
    max_eccentricity: float = 0.80
    include_microvesicular: bool = False
    micro_min_area_um2: float = 3.0
    micro_max_area_um2: float = 20.0
    micro_circularity_min: float = 0.5
    micro_solidity_min: float = 0.8
    exclude_border: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "micro_max_area_um2", self.min_area_um2)


@dataclass(frozen=True)
class Quality:
    contact_sheet_tiles: int = 16
    contact_sheet_cols: int = 4
    random_seed: int = 0
    outline_color: tuple[int, int, int] = (255, 0, 0)
    macro_color: tuple[int, int, int] = (255, 0, 0)
    micro_color: tuple[int, int, int] = (0, 190, 255)
    outline_thickness: int = 2
    thumbnail_max_dim: int = 2000
    save_per_tile_qc: bool = True
    histogram_bins: int = 12


@dataclass(frozen=True)
class Config:
    slide_path: str = ""
    output_dir: str = "outputs"
    limit: int = 0
    tissue: Tissue = field(default_factory=Tissue)
    tiling: Tiling = field(default_factory=Tiling)
    fat: Fat = field(default_factory=Fat)
    qc: Quality = field(default_factory=Quality)

    @classmethod
    def of(cls, values: dict[str, Any]) -> Config:
        """From nested values; an unknown key is a KeyError."""
        return _merged(cls(), values)

    @classmethod
    def load(cls, path: str) -> Config:
        return cls.of(read_yaml(read_file(path).decode()))

    def with_values(self, dotted: dict[str, Any]) -> Config:
        """Overrides by dotted names; None leaves a value as it is."""
        out = self
        for name, value in dotted.items():
            if value is not None:
                *path, last = name.split(".")
                nested: dict[str, Any] = {last: value}
                for p in reversed(path):
                    nested = {p: nested}
                out = _merged(out, nested)
        return out

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def digest(self) -> str:
        """The first 16 hex digits of the SHA-256 of the sorted JSON form."""
        return sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]

    def save(self, path: str) -> None:
        """On any store that Arrow opens."""
        put(path, write_yaml(self.to_dict()).encode())


#: The published second revision of the parameters.
TUNED = Config(fat=Fat(white_threshold=210, min_area_um2=40.0, circularity_min=0.55))


def _merged(record: Any, values: dict[str, Any]) -> Any:
    known = {f.name for f in fields(record)}
    new = {}
    for k, v in values.items():
        if k not in known:
            raise KeyError(f"unknown parameter {k!r} of {type(record).__name__}")
        old = getattr(record, k)
        if is_dataclass(old):
            if not isinstance(v, dict):
                raise KeyError(f"{k!r} is a group of parameters")
            v = _merged(old, v)
        elif isinstance(old, tuple):
            v = tuple(v)
        new[k] = v
    return replace(record, **new)


def _scalar(text: str) -> Any:
    t = text.strip()
    if t.startswith("[") and t.endswith("]"):
        return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t in ("", "null", "~"):
        return None
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    for kind in (int, float):
        try:
            return kind(t.replace("_", ""))
        except ValueError:
            pass
    return t


def read_yaml(text: str) -> dict[str, Any]:
    """Nested maps, scalars, flow and block lists of scalars, comments."""
    root: dict[str, Any] = {}
    stack: list[tuple[int, Any, str | None]] = [(-1, root, None)]
    for raw in text.splitlines():
        line = raw if "#" not in raw else _uncommented(raw)
        if not line.strip() or line.strip() == "---":
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent):
            stack.pop()
        if body.startswith("- "):
            holder, name = stack[-1][1], stack[-1][2]
            if not isinstance(holder.get(name), list):
                holder[name] = []
            holder[name].append(_scalar(body[2:]))
            continue
        key, sep, value = body.partition(":")
        if not sep:
            raise ValueError(f"not a parameter line: {raw!r}")
        target = stack[-1][1]
        if stack[-1][2] is not None:
            if not isinstance(target.get(stack[-1][2]), dict):
                target[stack[-1][2]] = {}
            target = target[stack[-1][2]]
        key = key.strip().strip("\"'")
        target[key] = _scalar(value)
        if not value.strip():
            stack.append((indent, target, key))
    return root


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def write_yaml(values: dict[str, Any], indent: int = 0) -> str:
    out = []
    for k, v in values.items():
        pad = " " * indent
        if isinstance(v, dict):
            out.append(f"{pad}{k}:\n{write_yaml(v, indent + 2)}")
        elif isinstance(v, list | tuple):
            out.append(f"{pad}{k}: [{', '.join(map(_plain, v))}]\n")
        else:
            out.append(f"{pad}{k}: {_plain(v)}\n")
    return "".join(out)


def _plain(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if v is None:
        return "null"
    return json.dumps(v) if isinstance(v, str) and (not v or _scalar(v) != v or set(v) & set(":#[]{},")) else str(v)

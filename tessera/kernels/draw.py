"""Pictures of masks: outlines, tints, panels. Arrays in, arrays out."""

from __future__ import annotations

import numpy as np

from tessera.kernels.raster import dilate, erode


def outline(rgb: np.ndarray, mask: np.ndarray, color=(255, 0, 0), thickness: int = 2) -> np.ndarray:
    out = rgb.copy()
    rim = mask & ~erode(mask, 1)
    out[dilate(rim, thickness // 2)] = color
    return out


def shade(rgb: np.ndarray, mask: np.ndarray, color=(255, 0, 0), alpha: float = 0.4) -> np.ndarray:
    out = rgb.astype(np.float64)
    out[mask] = (1 - alpha) * out[mask] + alpha * np.array(color, float)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def mask_rgb(mask: np.ndarray) -> np.ndarray:
    return np.repeat((mask * np.uint8(255))[..., None], 3, axis=2)


def two_class_rgb(macro: np.ndarray, micro: np.ndarray, macro_color=(255, 0, 0), micro_color=(0, 190, 255)) -> np.ndarray:
    """The large class is drawn over the small one."""
    out = np.zeros((*macro.shape, 3), np.uint8)
    out[micro] = micro_color
    out[macro] = macro_color
    return out


def confidence_rgb(votes: np.ndarray, members: int) -> np.ndarray:
    """Black for no vote, then from blue to yellow with agreement."""
    f = votes.astype(np.float64) / max(1, members)
    out = np.stack([255 * f, 255 * f, 255 * (1 - f)], axis=-1)
    out[votes == 0] = 0
    return np.rint(out).astype(np.uint8)


def side_by_side(panels: list[np.ndarray], gap: int = 4, fill: int = 255) -> np.ndarray:
    h = max(p.shape[0] for p in panels)
    parts = []
    for i, p in enumerate(panels):
        part = np.full((h, p.shape[1], 3), fill, np.uint8)
        part[: p.shape[0]] = p
        parts += ([np.full((h, gap, 3), fill, np.uint8)] if i else []) + [part]
    return np.concatenate(parts, axis=1)


def contact_sheet(panels: list[np.ndarray], cols: int, gap: int = 4, fill: int = 255) -> np.ndarray:
    if not panels:
        return np.full((1, 1, 3), fill, np.uint8)
    rows = [side_by_side(panels[i : i + cols], gap, fill) for i in range(0, len(panels), cols)]
    w = max(r.shape[1] for r in rows)
    out = []
    for i, r in enumerate(rows):
        wide = np.full((r.shape[0], w, 3), fill, np.uint8)
        wide[:, : r.shape[1]] = r
        out += ([np.full((gap, w, 3), fill, np.uint8)] if i else []) + [wide]
    return np.concatenate(out, axis=0)


def scale_bar(rgb: np.ndarray, mpp: float, length_um: float, height: int = 4, margin: int = 8, color=(0, 0, 0)) -> np.ndarray:
    out, w = rgb.copy(), max(1, round(length_um / mpp))
    out[-margin - height : -margin, -margin - w : -margin] = color
    return out

"""Colours of label masks and small previews, on arrays; geometry of boxes is in the queries."""

from __future__ import annotations

import numpy as np

#: Colours by class id modulo their number.
PALETTE = [
    (230, 25, 75),
    (60, 180, 75),
    (255, 225, 25),
    (0, 130, 200),
    (245, 130, 48),
    (145, 30, 180),
    (70, 240, 240),
    (240, 50, 230),
]


def colour(class_id: int) -> tuple[int, int, int]:
    return PALETTE[class_id % len(PALETTE)]


def colourised(labels: np.ndarray) -> np.ndarray:
    return np.array(PALETTE, np.uint8)[labels % len(PALETTE)]


def overlaid(rgb: np.ndarray, labels: np.ndarray, alpha: float = 0.4, clear: tuple[int, ...] = ()) -> np.ndarray:
    """Labels over a picture; classes in ``clear`` leave it as it is."""
    mixed = (1 - alpha) * rgb.astype(float) + alpha * colourised(labels)
    keep = np.isin(labels, clear)[..., None]
    return np.where(keep, rgb, np.floor(mixed + 0.5)).astype(np.uint8)


def masked_red(rgb: np.ndarray, mask: np.ndarray, alpha: float = 0.4) -> np.ndarray:
    mixed = (1 - alpha) * rgb.astype(float) + alpha * np.array([255.0, 0.0, 0.0])
    return np.where(mask[..., None], np.floor(mixed + 0.5), rgb).astype(np.uint8)


def stretched(grey: np.ndarray) -> np.ndarray:
    """Minimum to 0, maximum to 255; a constant picture is black."""
    low, high = float(grey.min()), float(grey.max())
    return np.zeros(grey.shape, np.uint8) if high <= low else np.floor((grey - low) / (high - low) * 255 + 0.5).astype(np.uint8)


def side_by_side(pictures: list[np.ndarray], gap: int = 8) -> np.ndarray:
    """Pictures of one height beside each other on white."""
    h = max(p.shape[0] for p in pictures)
    parts = []
    for i, p in enumerate(pictures):
        if i:
            parts.append(np.full((h, gap, 3), 255, np.uint8))
        parts.append(np.vstack([p, np.full((h - p.shape[0], p.shape[1], 3), 255, np.uint8)]))
    return np.hstack(parts)


def legend(ratios: dict[int, float], width: int = 160, row: int = 12) -> np.ndarray:
    """A row for each class, in order: a square of its colour, and a bar as long as its share."""
    out = np.full((max(1, len(ratios)) * row, width, 3), 255, np.uint8)
    for i, (class_id, ratio) in enumerate(sorted(ratios.items())):
        lines, bar = slice(i * row + 2, (i + 1) * row - 2), round(min(1.0, max(0.0, ratio)) * (width - 2 * row))
        out[lines, 2 : row - 2] = colour(class_id)
        out[lines, row + 2 : row + 2 + bar] = colour(class_id)
    return out


def below(picture: np.ndarray, other: np.ndarray, gap: int = 8) -> np.ndarray:
    """One picture under the other, on white."""
    width = max(picture.shape[1], other.shape[1])
    fit = lambda p: np.hstack([p, np.full((p.shape[0], width - p.shape[1], 3), 255, np.uint8)])
    return np.vstack([fit(picture), np.full((gap, width, 3), 255, np.uint8), fit(other)])


def boxed(rgb: np.ndarray, boxes: list[tuple[int, int, int, int]], ink: tuple[int, int, int] = (230, 25, 75)) -> np.ndarray:
    """Outlines of (left, top, width, height); the line is a 180th of the picture's smaller side, 1 at least."""
    out, line = rgb.copy(), max(1, min(rgb.shape[:2]) // 180)
    for x, y, w, h in boxes:
        for rows, cols in ((slice(y, y + line), slice(x, x + w)), (slice(y + h - line, y + h), slice(x, x + w)), (slice(y, y + h), slice(x, x + line)), (slice(y, y + h), slice(x + w - line, x + w))):
            out[rows, cols] = ink
    return out


def wrapped(text: str, width: int, lines: int = 2) -> list[str]:
    """Words on at most so many lines; what doesn't fit ends in an ellipsis."""
    out = [""]
    words = text.split()
    for i, w in enumerate(words):
        if len(out[-1]) + len(w) + bool(out[-1]) <= width or not out[-1]:
            out[-1] = f"{out[-1]} {w}".strip()
        elif len(out) < lines:
            out.append(w)
        else:
            out[-1] = out[-1][: max(0, width - 1)].rstrip() + "…"
            break
    return out

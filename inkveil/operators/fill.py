"""Polygons to coverage: how much of each pixel lies inside, between 0 and 1.

Rows are cut into ``FINE`` lines; on a line the crossings of all edges are sorted, the winding
rule picks the spans inside, and spans count by their exact horizontal share of each pixel.
"""

from __future__ import annotations

import numpy as np

FINE = 4


def box(x0: float, y0: float, x1: float, y1: float, width: int, height: int):
    """(rows, columns, coverage) of an upright rectangle, exact."""
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    share = lambda a, b, n: (slice(lo := int(np.clip(np.floor(a), 0, n)), hi := int(np.clip(np.ceil(b), 0, n))), np.clip(np.minimum(np.arange(lo, hi) + 1, b) - np.maximum(np.arange(lo, hi), a), 0, 1))
    (rows, down), (cols, along) = share(y0, y1, height), share(x0, x1, width)
    return rows, cols, np.outer(down, along).astype(np.float32)


def polygons(paths, width: int, height: int, even_odd: bool = False):
    """(rows, columns, coverage) of closed paths, each an array of (x, y); rows and columns are slices of the page."""
    paths = [np.asarray(p, float) for p in paths if len(p) > 1]
    nothing = (slice(0, 0), slice(0, 0), np.zeros((0, 0), np.float32))
    if not paths:
        return nothing
    a = np.concatenate(paths)
    b = np.concatenate([np.roll(p, -1, axis=0) for p in paths])
    if not np.isfinite(a).all():
        return nothing
    left, right = (int(np.clip(f(a[:, 0]), 0, width)) for f in (lambda x: np.floor(x.min()), lambda x: np.ceil(x.max())))
    top, bottom = (int(np.clip(f(a[:, 1]), 0, height)) for f in (lambda y: np.floor(y.min()), lambda y: np.ceil(y.max())))
    if right <= left or bottom <= top:
        return nothing
    slope = a[:, 1] != b[:, 1]
    a, b = a[slope], b[slope]
    turn = np.where(b[:, 1] > a[:, 1], 1, -1)
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    across = (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    # Every edge's crossings with the lines that it meets.
    first = np.clip(np.ceil(low * FINE - 0.5), top * FINE, bottom * FINE).astype(int)
    last = np.clip(np.ceil(high * FINE - 0.5), top * FINE, bottom * FINE).astype(int)
    n = last - first
    edge = np.repeat(np.arange(len(n)), n)
    line = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[edge]
    x = np.clip(a[edge, 0] + ((line + 0.5) / FINE - a[edge, 1]) * across[edge], left, right)
    order = np.lexsort((x, line))
    line, x, turn = line[order], x[order], turn[edge][order]
    wound = np.cumsum(turn)  # each line's turns cancel out, so lines do not disturb each other
    inside = (np.arange(1, len(x) + 1) % 2 == 1) if even_odd else wound != 0
    inside[-1:] = False
    starts = np.flatnonzero(inside)
    cover = np.zeros((bottom - top, right - left + 2))
    row = line[starts] // FINE - top
    # Coverage is the running sum of what begins and ends: a span's edge is shared by two pixels.
    for at, sign in ((x[starts] - left, 1.0), (x[starts + 1] - left, -1.0)):
        whole = np.floor(at).astype(int)
        np.add.at(cover, (row, whole), sign * (1 - (at - whole)) / FINE)
        np.add.at(cover, (row, whole + 1), sign * (at - whole) / FINE)
    return slice(top, bottom), slice(left, right), np.clip(np.cumsum(cover, axis=1)[:, : right - left], 0, 1).astype(np.float32)


def flat(points, n: int = 16) -> np.ndarray:
    """A cubic curve as n straight pieces, without its first point."""
    t = np.arange(1, n + 1)[:, None] / n
    p = np.asarray(points, float)
    return (1 - t) ** 3 * p[0] + 3 * (1 - t) ** 2 * t * p[1] + 3 * (1 - t) * t**2 * p[2] + t**3 * p[3]


def outline(path, width: float, round_: bool = True) -> list[np.ndarray]:
    """Polygons that together cover a line of a width along a path: a box for each piece and, if round, a disc at each corner."""
    path, r = np.asarray(path, float), width / 2
    out = []
    for p, q in zip(path, path[1:]):
        d = q - p
        size = np.hypot(*d)
        if size:
            side = np.array([-d[1], d[0]]) * r / size
            out.append(np.array([p + side, p - side, q - side, q + side]))  # all turn the same way
    if round_:
        turns = np.arange(12) * 2 * np.pi / 12
        disc = np.stack([np.cos(turns), np.sin(turns)], axis=1) * r
        out += [p + disc for p in path]
    return out


def paint(pixels: np.ndarray, found, colour, alpha: float = 1.0, mask: np.ndarray | None = None) -> None:
    """Lays a colour over pixels by coverage."""
    rows, cols, cover = found
    if not cover.size:
        return
    share = cover * alpha if mask is None else cover * alpha * mask[rows, cols]
    part = pixels[rows, cols, :3].astype(np.float32)
    pixels[rows, cols, :3] = np.rint(part + (np.asarray(colour, np.float32) - part) * share[..., None]).astype(np.uint8)

"""Rectangle arithmetic on x, y, w, h columns.  A rectangle is a tuple of four columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Rect = tuple[Column, Column, Column, Column]
MIN_SIZE, CODE_PAD, FACE_GROWTH = 8, 0.06, 0.4
FACE_LEVELS = (1.0, 0.5, 0.25)
FACE_FLOORS = (0.5, 0.5, 0.7)
MAX_FACE_AREA, ASPECT = 0.4, (0.55, 1.8)
TARGET_EDGE, MAX_SCALE, WORK_EDGE, SEARCH_EDGE = 1800, 2.5, 2000, 900
MIN_MODULE, TOLERANCE, EDGE_MODULES = 1.4, 0.55, 3.5


def rect(prefix: str = "") -> Rect:
    return tuple(F.col(prefix + c).cast("double") for c in ("x", "y", "w", "h"))


def named(r: Rect, prefix: str = "", digits: int | None = None) -> list[Column]:
    return [(c if digits is None else F.round(c, digits)).alias(prefix + n) for n, c in zip(("x", "y", "w", "h"), r)]


def num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def half_up(c: Column) -> Column:
    """Halves go up, below zero too."""
    return F.floor(c + F.lit(0.5))


def normalise_rect(r: Rect) -> Rect:
    x, y, w, h = r
    return F.when(w < 0, x + w).otherwise(x), F.when(h < 0, y + h).otherwise(y), F.abs(w), F.abs(h)


def clamp_rect(r: Rect, width, height) -> Rect:
    x, y, w, h = r
    width, height, zero, least = num(width), num(height), num(0), num(MIN_SIZE)
    cx = F.least(F.greatest(x, zero), F.greatest(width - MIN_SIZE, zero))
    cy = F.least(F.greatest(y, zero), F.greatest(height - MIN_SIZE, zero))
    return cx, cy, F.least(F.greatest(w, least), width - cx), F.least(F.greatest(h, least), height - cy)


def move_rect(r: Rect, dx, dy, width, height) -> Rect:
    x, y, w, h = r
    width, height, zero = num(width), num(height), num(0)
    return (
        F.least(F.greatest(x + num(dx), zero), F.greatest(width - w, zero)),
        F.least(F.greatest(y + num(dy), zero), F.greatest(height - h, zero)), w, h,
    )


def drag_rect(r: Rect, handle: Column, dx, dy) -> Rect:
    """A handle dragged; past the opposite edge the extent is negative."""
    x, y, w, h = r
    dx, dy = num(dx), num(dy)
    west, east, north, south = (handle.contains(c) for c in "wens")
    nw = F.when(east, w + dx).when(west, w - dx).otherwise(w)
    nh = F.when(south, h + dy).when(north, h - dy).otherwise(h)
    return F.when(west, x + dx).otherwise(x), F.when(north, y + dy).otherwise(y), nw, nh


def resize_rect(r: Rect, handle: Column, dx, dy, width, height) -> Rect:
    return clamp_rect(normalise_rect(drag_rect(r, handle, dx, dy)), width, height)


def to_full(r: Rect, scale) -> Rect:
    return tuple(half_up(c * num(scale)).cast("long") for c in r)


def pad(r: Rect, ratio: float = 0.18) -> Rect:
    x, y, w, h = r
    grow = h * ratio
    return x - grow, y - grow, w + grow * 2, h + grow * 2


def pad_code(r: Rect, width, height) -> Rect:
    x, y, w, h = r
    grow = F.greatest(w, h) * CODE_PAD
    return clamp_rect((x - grow, y - grow, w + grow * 2, h + grow * 2), width, height)


def expand_face(r: Rect, width, height) -> Rect:
    x, y, w, h = r
    gx, gy = w * FACE_GROWTH, h * FACE_GROWTH
    return clamp_rect((x - gx, y - gy, w + gx * 2, h + gy * 2), width, height)


def shared(a: Rect, b: Rect) -> Column:
    """The common area, 0 where the rectangles are apart."""
    zero = num(0)
    w = F.greatest(zero, F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return w * h


def covers(a: Rect, b: Rect) -> Column:
    """The share of b that lies in a."""
    area = b[2] * b[3]
    return F.when(area > 0, shared(a, b) / area).otherwise(num(0))


def overlap(a: Rect, b: Rect) -> Column:
    """The common area as a share of the smaller rectangle."""
    both = shared(a, b)
    return F.when(both > 0, both / F.least(a[2] * a[3], b[2] * b[3])).otherwise(num(0))


def overlaps_vertically(a: Rect, b: Rect) -> Column:
    """Is over half the height of the flatter one common?"""
    return F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]) > F.least(a[3], b[3]) / 2


def ocr_scale(edge: Column) -> Column:
    return F.when(edge <= 0, num(1)).otherwise(F.least(num(MAX_SCALE), F.greatest(num(1), num(TARGET_EDGE) / F.when(edge > 0, edge))))


def code_scales(edge: Column) -> Column:
    def a(*v):
        return F.array(*map(F.lit, v))

    return F.when((edge <= 0) | (edge >= 1600), a(1)).when(edge >= 800, a(1, 2)).otherwise(a(1, 2, 3))


def work_size(width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Width and height of the working raster, and the scale back to the full one."""
    ratio = F.least(num(1), num(WORK_EDGE) / F.greatest(width, height))
    whole = ratio == 1
    return (
        F.when(whole, width).otherwise(half_up(width * ratio)).cast("long"),
        F.when(whole, height).otherwise(half_up(height * ratio)).cast("long"),
        num(1) / ratio,
    )


def stamp_layout(width: Column, height: Column) -> list[Column]:
    size = F.greatest(F.lit(11), half_up(F.least(width, height) * 0.042))
    return [size.cast("long").alias("font_size"), (size * 4.2).alias("line_gap"), (size * 2.4).alias("column_gap"), (F.lit(-3.141592653589793) / 9).alias("angle")]


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def is_finder_ratio(runs: Column) -> Column:
    """Five runs in the proportions 1:1:3:1:1."""
    module = F.aggregate(runs, num(0), lambda a, x: a + x) / 7
    expected = F.array(*map(F.lit, (1.0, 1.0, 3.0, 1.0, 1.0)))
    close = F.zip_with(runs, expected, lambda r, e: F.abs(r - e * module) <= module * TOLERANCE)
    return (F.size(runs) == 5) & (module >= MIN_MODULE) & F.forall(close, lambda c: F.coalesce(c, F.lit(False)))


def squareness(a: Column, b: Column, c: Column) -> Column:
    """How far three finder centres (structs x, y, module) are from a right isosceles triangle, or null."""

    def far(p, q):
        return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))

    module = (a["module"] + b["module"] + c["module"]) / 3
    sides = F.array_sort(F.array(far(a, b), far(b, c), far(a, c)))
    leg1, leg2, diagonal = F.get(sides, F.lit(0)), F.get(sides, F.lit(1)), F.get(sides, F.lit(2))
    root = num(2**0.5)
    legs, leg_error = leg2 / module, F.try_divide(leg2 - leg1, leg2)
    diagonal_error = F.try_divide(F.abs(diagonal - leg2 * root), leg2 * root)
    return F.when((legs >= 11) & (legs <= 190) & (leg_error <= 0.3) & (diagonal_error <= 0.25), leg_error + diagonal_error)

"""The purpose stamp: letters as strokes, tiled over a page at an angle, in dark ink with a pale edge.

How much of a pixel a stroke covers follows from the distance of the pixel's centre to it, so
edges are smooth at any angle; all tiles of a page share one field of distances.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from .raster import mapped

# Colours and their shares, widths in parts of the letter size.
INK, PALE = (10, 10, 11), (255, 255, 255)
INK_SHARE, PALE_SHARE, EDGE = 0.34, 0.5, 0.14
ADVANCE, WEIGHT, UNIT = 0.6, 0.09, 0.1167
# Strokes of each letter as points (column 0 to 4, row 0 to 9, 2 the base line, 8 the height of capitals).
STROKES = {
    "A": "0206284642 0444", "B": "02083847463505 3544433202", "C": "4738180703123243", "D": "02082846442202", "E": "48080242 0535", "F": "480802 0535",
    "G": "47381807031232434525", "H": "0208 4248 0545", "I": "1232 2228 1838", "J": "0312324348", "K": "0208 480542", "L": "080242", "M": "0208254842",
    "N": "02084248", "O": "123243473818070312", "P": "02083847463505", "Q": "123243473818070312 2442", "R": "02083847463505 2542",
    "S": "473818070615354443321203", "T": "0848 2822", "U": "080312324348", "V": "082248", "W": "0812263248", "X": "0248 0842", "Y": "082548 2522", "Z": "08480242",
    "a": "16364542 441403123243", "b": "0802 0516364543321203", "c": "4536160503123243", "d": "4842 4536160503123243", "e": "04444536160503123243",
    "f": "48382722 1636", "g": "4536160503123243 4641301001", "h": "0802 0516364542", "i": "162622 1232 28", "j": "36312010 38", "k": "0802 460442",
    "l": "182822 1232", "m": "0602 05162522 25364542", "n": "0602 0516364542", "o": "123243453616050312", "p": "0600 0516364543321203", "q": "4640 4536160503123243",
    "r": "0602 05163645", "s": "45361605143443321203", "t": "1813223243 0636", "u": "0603123243 4642", "v": "062246", "w": "0612253246", "x": "0246 0642",
    "y": "0622 46221000", "z": "06460242",
    "0": "123243473818070312 0347", "1": "172822 1232", "2": "07183847460242", "3": "07183847463515 354443321203", "4": "32380444", "5": "480805354443321203",
    "6": "38180703123243443505", "7": "084822", "8": "15354443321203041506071838474635", "9": "12324347381807061545",
    " ": "", ".": "22", ",": "2211", ":": "22 25", ";": "2211 25", "-": "1434", "–": "0444", "/": "0248", "(": "38262432", ")": "18262412", "'": "2826", "’": "2826", '"': "1816 3836",
    "&": "420607182837360403122244", "+": "0444 2622", "!": "2824 22", "?": "0718384746352524 22", "@": "42120307183847443436262434", "#": "1218 3238 0444 0646",
    "%": "0248 07 43", "_": "0141", "=": "0343 0545", "*": "2723 0446 0644", "·": "25", "\\": "0842", "[": "38282232", "]": "18282212", "<": "460442", ">": "064402",
    "|": "2820", "~": "0415253445", "^": "062846", "$": "473818070615354443321203 2921", "`": "1827",
}
UNKNOWN = "0208484202"


def text_width(text: Column, size: Column) -> Column:
    """Letters are all of one width."""
    return F.length(text) * F.lit(ADVANCE) * size


def segments(text: str, size: float) -> np.ndarray:
    """(n, 4): strokes x0, y0, x1, y1 of a line of text around its middle, y downwards."""
    out = []
    left = -len(text) * ADVANCE * size / 2 + (ADVANCE - 4 * UNIT) * size / 2
    for i, letter in enumerate(text):
        for stroke in STROKES.get(letter, UNKNOWN).split():
            points = [(left + (i * ADVANCE + int(stroke[k]) * UNIT) * size, (5 - int(stroke[k + 1])) * UNIT * size) for k in range(0, len(stroke), 2)]
            out += [(*a, *b) for a, b in zip(points, points[1:] or points)]
    return np.array(out, float).reshape(-1, 4)


def centres(width: int, height: int, wide: float, line_gap: float, column_gap: float):
    """Middles of all tiles before the page is turned: rows and columns reach past the corners by half a stamp."""
    reach = np.hypot(width, height) / 2
    for row in range(int(np.floor((reach + line_gap) * 2 / line_gap)) + 1):
        for column in range(int(np.floor((reach + wide / 2) * 2 / (wide + column_gap))) + 1):
            yield column * (wide + column_gap) - reach - wide / 2, row * line_gap - reach - line_gap


def distances(strokes: np.ndarray, width: int, height: int, most: float) -> np.ndarray:
    """Each pixel centre's distance to the nearest stroke, where it is under ``most``; else ``most``."""
    field = np.full((height, width), most, np.float32)
    low, high = np.minimum(strokes[:, :2], strokes[:, 2:]) - most, np.maximum(strokes[:, :2], strokes[:, 2:]) + most
    first = np.clip(np.floor(low), 0, (width, height)).astype(int)
    last = np.clip(np.ceil(high), 0, (width, height)).astype(int)
    for (x0, y0, x1, y1), (left, top), (right, bottom) in zip(strokes, first, last):
        if right <= left or bottom <= top:
            continue
        x, y = np.arange(left, right) + 0.5 - x0, (np.arange(top, bottom) + 0.5 - y0)[:, None]
        dx, dy = x1 - x0, y1 - y0
        along = np.clip((x * dx + y * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        part = field[top:bottom, left:right]
        np.minimum(part, np.hypot(x - along * dx, y - along * dy), out=part)
    return field


def stamp(pixels: np.ndarray, text: str, size: float, line_gap: float, column_gap: float, angle: float) -> np.ndarray:
    """A copy with the text tiled over it; colours change, transparency does not."""
    height, width = pixels.shape[:2]
    out = pixels.copy()
    if not text:
        return out
    c, s = np.cos(angle), np.sin(angle)
    turn = np.array([[c, s], [-s, c]])
    own = segments(text, size).reshape(-1, 2) @ turn
    wide, half, edge = len(text) * ADVANCE * size, WEIGHT * size / 2, max(1.0, size * EDGE) / 2
    middle = np.array([width, height]) / 2
    tiles = [(own + (np.array(at) @ turn + middle)).reshape(-1, 4) for at in centres(width, height, wide, line_gap, column_gap)]
    most = half + edge + 1
    far = wide / 2 + size
    strokes = np.concatenate([t for t in tiles if len(t) and (t[:, ::2].max() > -far and t[:, ::2].min() < width + far)] or [np.zeros((0, 4))])
    field = distances(strokes, width, height, most)
    within = lambda r: np.clip(r + 0.5 - field, 0, 1)
    pale = (within(half + edge) - (within(half - edge) if half > edge else 0)) * PALE_SHARE
    dark = within(half) * INK_SHARE
    n = min(3, out.shape[2])
    colours = out[..., :n].astype(np.float32)
    for share, colour in ((pale, PALE), (dark, INK)):
        colours += (np.array(colour[:n], np.float32) - colours) * share[..., None]
    out[..., :n] = np.rint(colours).astype(np.uint8)
    return out


def stamped(pages: DataFrame, text: Column) -> DataFrame:
    """pages with a stamp over each; an empty or null text leaves its page as it is."""
    size, line, column, angle = G.stamp_layout(F.col("width"), F.col("height"))
    how = [F.coalesce(text, F.lit("")).alias("stamp"), *(c.cast("double") for c in (size, line, column, angle))]
    added = ("stamp", "font_size", "line_gap", "column_gap", "angle")
    return mapped(pages.select("*", *how), lambda raster, row: stamp(raster, *(row[c] for c in added)), drop=added)

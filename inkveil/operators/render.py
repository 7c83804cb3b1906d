"""Pages of a PDF as pixels: images, filled and stroked paths, clips and forms on white.

Text, shadings, patterns and some image codecs are not drawn; ``draw`` names what it left out.
"""

from __future__ import annotations

import math

import numpy as np

from ..sources.pdf import Damaged, Name, Stream, Word, parse
from . import fill, jpeg
from .raster import resize

EDGE = 2400
DEPTH = 12  # forms within forms
_TEXT = {b"Tj", b"TJ", b"'", b'"'}
_PLAIN = {
    b"BT", b"ET", b"Tc", b"Tw", b"Tz", b"TL", b"Tf", b"Tr", b"Ts", b"Td", b"TD", b"Tm", b"T*", b"d", b"j", b"J", b"M", b"ri", b"i",
    b"BMC", b"BDC", b"EMC", b"MP", b"DP", b"BX", b"EX", b"d0", b"d1",
}
_PAINTS = {b"S": "s", b"s": "cs", b"f": "f", b"F": "f", b"f*": "F", b"B": "fs", b"B*": "Fs", b"b": "cfs", b"b*": "cFs", b"n": ""}


def times(a, b):
    """The matrix that does a, then b."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def viewport(page, edge: int = EDGE):
    """(matrix to pixels, width, height) of a page with that long edge, turned as it says."""
    x0, y0, x1, y1 = page.box
    w, h = x1 - x0, y1 - y0
    s = edge / max(w, h)
    base = {0: (s, 0, 0, -s, -x0 * s, y1 * s), 90: (0, s, s, 0, -y0 * s, -x0 * s), 180: (-s, 0, 0, s, x1 * s, -y0 * s), 270: (0, -s, -s, 0, y1 * s, x1 * s)}
    turn = page.rotate // 90 * 90 % 360
    if turn in (90, 270):
        w, h = h, w
    return base[turn], max(1, math.floor(w * s + 0.5)), max(1, math.floor(h * s + 0.5))


def rgb(values: np.ndarray, n: int) -> np.ndarray:
    """Colours 0 to 1 of one, three or four components as RGB 0 to 255."""
    v = np.clip(np.asarray(values, float), 0, 1)
    if n == 4:
        v = (1 - v[..., :3]) * (1 - v[..., 3:])
    return np.rint(np.broadcast_to(v, (*v.shape[:-1], 3)) * 255) if n != 3 else np.rint(v * 255)


def draw(file, page, edge: int = EDGE) -> tuple[np.ndarray, list[str]]:
    """(RGB pixels, what was left out) of a page."""
    matrix, width, height = viewport(page, edge)
    canvas = _Canvas(file, np.full((height, width, 3), 255, np.uint8))
    canvas.missed.update(page.trouble)
    canvas.run(page.contents, page.resources, matrix, 0)
    return canvas.pixels, sorted(canvas.missed)


class _Canvas:
    def __init__(self, file, pixels: np.ndarray):
        self.file, self.pixels, self.missed = file, pixels, set()

    def run(self, contents: bytes, resources: dict, matrix, depth: int, clip=None) -> None:
        get = self.file.get
        state = {"m": matrix, "fill": (0, 0, 0), "stroke": (0, 0, 0), "fa": 1.0, "sa": 1.0, "w": 1.0, "clip": clip, "n": {}}
        stack, operands, at = [], [], 0
        paths, here, start, clipped = [], None, None, None
        while True:
            try:
                token, at = parse(contents, at, refs=False)
            except Damaged as e:
                if str(e) != "an object is missing":
                    self.missed.add("damaged contents")
                return
            if not isinstance(token, Word):
                operands.append(token)
                continue
            args, operands = operands[-40:], []
            try:
                v = [float(x) for x in args if isinstance(x, (int, float)) and not isinstance(x, bool)]
                if token == b"q":
                    stack.append(dict(state))
                elif token == b"Q":
                    state = stack.pop() if stack else state
                elif token == b"cm":
                    state["m"] = times(v[:6], state["m"])
                elif token in (b"m", b"l"):
                    here = self._point(state, *v[:2])
                    if token == b"m" or not paths:
                        paths.append([here])
                        start = here
                    else:
                        paths[-1].append(here)
                elif token in (b"c", b"v", b"y"):
                    p = [self._point(state, *v[i : i + 2]) for i in range(0, len(v), 2)]
                    p = [here, *p] if token == b"v" else [*p, p[-1]] if token == b"y" else p
                    paths[-1].extend(map(tuple, fill.flat([here, *p[:3]])))
                    here = tuple(p[2])
                elif token == b"h" and paths:
                    paths[-1].append(start)
                    here = start
                elif token == b"re":
                    x, y, w, h = v[:4]
                    paths.append([self._point(state, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))])
                    here = start = paths[-1][0]
                elif token in (b"W", b"W*"):
                    clipped = token
                elif token in _PAINTS:
                    how = _PAINTS[token]
                    self._paint(state, paths, how)
                    if clipped and paths:
                        state["clip"] = self._cut(state["clip"], fill.polygons(paths, *self.pixels.shape[1::-1], even_odd=clipped == b"W*"))
                    paths, clipped = [], None
                elif token in (b"g", b"G", b"rg", b"RG", b"k", b"K"):
                    n = {b"g": 1, b"r": 3, b"k": 4}[token[:1].lower()]
                    state["fill" if token.islower() else "stroke"] = tuple(rgb(v[:n], n))
                elif token in (b"cs", b"CS"):
                    kind = self._space(args[0], resources)
                    state["n"] = state["n"] | {token.islower(): kind}
                    state["fill" if token.islower() else "stroke"] = (0, 0, 0)
                elif token in (b"sc", b"scn", b"SC", b"SCN"):
                    kind = state["n"].get(token.islower(), ("plain", len(v)))
                    if kind[0] == "plain" and kind[1] in (1, 3, 4) and len(v) >= kind[1]:
                        state["fill" if token.islower() else "stroke"] = tuple(rgb(v[: kind[1]], kind[1]))
                    elif kind[0] == "indexed" and v:
                        state["fill" if token.islower() else "stroke"] = tuple(kind[2][min(int(v[0]), len(kind[2]) - 1)])
                    else:
                        self.missed.add("pattern or special colour")
                elif token == b"w":
                    state["w"] = v[0]
                elif token == b"gs":
                    own = get((get(resources.get("ExtGState")) or {}).get(args[0])) or {}
                    state["fa"], state["sa"] = float(get(own.get("ca", state["fa"]))), float(get(own.get("CA", state["sa"])))
                    if isinstance(get(own.get("SMask")), dict):
                        self.missed.add("soft mask")
                    if get(own.get("BM")) not in (None, "Normal", "Compatible"):
                        self.missed.add("blend mode")
                elif token == b"Do":
                    own = get((get(resources.get("XObject")) or {}).get(args[0]))
                    self._object(own, resources, state, depth)
                elif token == b"BI":
                    at = self._inline(contents, at, resources, state)
                elif token in _TEXT:
                    self.missed.add("text")
                elif token == b"sh":
                    self.missed.add("shading")
                elif token not in _PLAIN:
                    self.missed.add(f"operator {token.decode('latin-1')[:20]}")
            except (ValueError, TypeError, IndexError, KeyError, AttributeError, OverflowError):
                self.missed.add(f"wrong use of {token.decode('latin-1')[:20]}")

    @staticmethod
    def _point(state, x: float, y: float):
        a, b, c, d, e, f = state["m"]
        return a * x + c * y + e, b * x + d * y + f

    def _cut(self, clip, found):
        rows, cols, cover = found
        out = np.zeros(self.pixels.shape[:2], np.float32)
        out[rows, cols] = cover if clip is None else cover * clip[rows, cols]
        return out

    def _paint(self, state, paths, how: str) -> None:
        height, width = self.pixels.shape[:2]
        if ("f" in how or "F" in how) and paths:
            fill.paint(self.pixels, self._filled(paths, width, height, "F" in how), state["fill"], state["fa"], state["clip"])
        if "s" in how:
            a, b, c, d, *_ = state["m"]
            wide = max(1.0, state["w"] * math.sqrt(abs(a * d - b * c)))
            lines = [[*p, p[0]] if "c" in how else p for p in paths]
            parts = [x for p in lines for x in fill.outline(p, wide, len(p) > 2)]
            fill.paint(self.pixels, fill.polygons(parts, width, height), state["stroke"], state["sa"], state["clip"])

    @staticmethod
    def _filled(paths, width: int, height: int, even_odd: bool):
        """Upright rectangles are exact."""
        if len(paths) == 1 and len(p := paths[0]) in (4, 5) and (len(p) == 4 or p[4] == p[0]):
            xs, ys = {x for x, _ in p}, {y for _, y in p}
            if len(xs) <= 2 and len(ys) <= 2 and all(p[i][0] == p[i + 1][0] or p[i][1] == p[i + 1][1] for i in range(3)):
                return fill.box(min(xs), min(ys), max(xs), max(ys), width, height)
        return fill.polygons(paths, width, height, even_odd)

    def _space(self, space, resources, depth: int = 0):
        """("plain", components), ("indexed", 1, colours) or ("other", 0)."""
        get = self.file.get
        space = get(space)
        if isinstance(space, Name):
            known = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}
            if space in known:
                return "plain", known[space]
            named = (get(resources.get("ColorSpace")) or {}).get(space)
            return self._space(named, resources, depth + 1) if named is not None and depth < 5 else ("other", 0)
        if isinstance(space, list) and space:
            kind = get(space[0])
            if kind in ("CalGray", "CalRGB") or len(space) == 1:
                return self._space(kind, resources, depth + 1)
            if kind == "ICCBased":
                n = get(get(space[1]).head.get("N"))
                return ("plain", n) if n in (1, 3, 4) else ("other", 0)
            if kind in ("Indexed", "I") and depth < 5:
                base = self._space(space[1], resources, depth + 1)
                table = get(space[3])
                table = self.file.decoded(table)[0] if isinstance(table, Stream) else table
                if base[0] == "plain":
                    table = table[: len(table) // base[1] * base[1]]
                    return "indexed", 1, rgb(np.frombuffer(table, np.uint8).reshape(-1, base[1]) / 255, base[1])
        return "other", 0

    def _inline(self, contents: bytes, at: int, resources, state) -> int:
        head = {}
        short = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "IM": "ImageMask", "D": "Decode", "F": "Filter", "DP": "DecodeParms", "I": "Interpolate"}
        while True:
            key, at = parse(contents, at, refs=False)
            if key == b"ID":
                break
            head[short.get(key, key)], at = parse(contents, at, refs=False)
        at += 1
        end = at
        while (end := contents.find(b"EI", end)) >= 0 and not (contents[end - 1 : end].isspace() and (contents[end + 2 : end + 3].isspace() or end + 2 >= len(contents))):
            end += 2
        if end < 0:
            raise Damaged("an image has no end")
        self._image(Stream(head, contents[at : end - 1]), resources, state)
        return end + 2

    def _object(self, own, resources, state, depth: int) -> None:
        get = self.file.get
        if not isinstance(own, Stream):
            self.missed.add("missing object")
        elif get(own.head.get("Subtype")) == "Image":
            self._image(own, resources, state)
        elif get(own.head.get("Subtype")) == "Form" and depth < DEPTH:
            data, left, _ = self.file.decoded(own)
            m = [float(get(x)) for x in get(own.head.get("Matrix")) or (1, 0, 0, 1, 0, 0)]
            inner = dict(state, m=times(m, state["m"]))
            x0, y0, x1, y1 = (float(get(x)) for x in get(own.head.get("BBox")))
            border = [self._point(inner, *p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
            clip = self._cut(state["clip"], self._filled([border], *self.pixels.shape[1::-1], False))
            self.run(b"" if left else data, get(own.head.get("Resources")) or resources, inner["m"], depth + 1, clip)
        else:
            self.missed.add("other object")

    def _samples(self, image: Stream, resources, n: int | None):
        """(height, width, components) of 0 to 1 (or of places in a table), n if the components are known."""
        get = self.file.get
        data, left, _ = self.file.decoded(image)
        width, height = int(get(image.head["Width"])), int(get(image.head["Height"]))
        if left in ("DCTDecode", "DCT"):
            return jpeg.decode(data) / 255
        if left:
            raise jpeg.Unreadable(f"codec {left}")
        bits = 1 if get(image.head.get("ImageMask")) else int(get(image.head.get("BitsPerComponent", 8)))
        n = n or 1
        if bits not in (1, 2, 4, 8, 16) or not 0 < width * height < 1 << 28:
            raise jpeg.Unreadable("image of no proper size")
        line = -(-width * n * bits // 8)
        rows = np.frombuffer(data[: line * height].ljust(line * height, b"\0"), np.uint8).reshape(height, line)
        if bits == 16:
            rows = rows[:, ::2]
        elif bits < 8:
            shifts = np.arange(8 - bits, -1, -bits)
            rows = (rows[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(height, -1)
        return rows[:, : width * n].reshape(height, width, n) / (255 if bits == 16 else (1 << bits) - 1)

    def _image(self, image: Stream, resources, state) -> None:
        get = self.file.get
        try:
            stencil = bool(get(image.head.get("ImageMask")))
            space = ("plain", 1) if stencil else self._space(image.head.get("ColorSpace"), resources) if "ColorSpace" in image.head else ("plain", None)
            values = self._samples(image, resources, space[1])
            decode = get(image.head.get("Decode"))
            indexed = space[0] == "indexed"
            if decode and not indexed:
                pairs = np.array([float(get(x)) for x in decode]).reshape(-1, 2)[: values.shape[2]]
                values = pairs[:, 0] + values * (pairs[:, 1] - pairs[:, 0])
            alpha = None
            if stencil:
                alpha, colour = 1 - values[..., 0], np.broadcast_to(np.array(state["fill"], np.uint8), (*values.shape[:2], 3))
            elif indexed:
                bits = int(get(image.head.get("BitsPerComponent", 8)))
                colour = space[2][np.minimum(np.rint(values[..., 0] * ((1 << min(bits, 8)) - 1)).astype(int), len(space[2]) - 1)]
            elif space[0] == "plain" and values.shape[2] in (1, 3, 4):
                colour = rgb(values, values.shape[2])
            else:
                raise jpeg.Unreadable("image of a special colour")
            mask = get(image.head.get("SMask"))
            if isinstance(mask, Stream):
                alpha = self._samples(mask, resources, 1)[..., 0]
            elif "Mask" in image.head:
                if isinstance(own := get(image.head["Mask"]), Stream):
                    alpha = 1 - self._samples(own, resources, 1)[..., 0]
                else:
                    self.missed.add("colour mask")
            if alpha is not None and alpha.shape != colour.shape[:2]:
                alpha = resize(np.rint(alpha * 255).astype(np.uint8), colour.shape[1], colour.shape[0]) / 255
            full = np.dstack([colour, np.full(colour.shape[:2], 255.0) if alpha is None else alpha * 255]).astype(np.uint8)
            self._place(full, state)
        except jpeg.Unreadable as e:
            self.missed.add(f"image: {e}")

    def _place(self, image: np.ndarray, state) -> None:
        """Images stand on a unit square, upside down."""
        a, b, c, d, e, f = state["m"]
        height, width = self.pixels.shape[:2]
        if abs(b) + abs(c) < 1e-6 * (abs(a) + abs(d)):  # upright: fitted to whole pixels
            x0, x1, y0, y1 = (math.floor(v + 0.5) for v in (min(e, e + a), max(e, e + a), min(f, f + d), max(f, f + d)))
            if x1 <= x0 or y1 <= y0 or (x1 - x0) * (y1 - y0) > 64 * width * height:
                return
            if a < 0:
                image = image[:, ::-1]
            if d > 0:
                image = image[::-1]
            scaled = resize(image, x1 - x0, y1 - y0) if image.shape[:2] != (y1 - y0, x1 - x0) else image
            left, top, right, bottom = max(x0, 0), max(y0, 0), min(x1, width), min(y1, height)
            if right <= left or bottom <= top:
                return
            part = scaled[top - y0 : bottom - y0, left - x0 : right - x0]
        else:
            det = a * d - b * c
            corners = np.array([self._point(state, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
            (left, top), (right, bottom) = np.clip(np.floor(corners.min(axis=0)), 0, (width, height)).astype(int), np.clip(np.ceil(corners.max(axis=0)), 0, (width, height)).astype(int)
            if not det or right <= left or bottom <= top:
                return
            y, x = np.mgrid[top:bottom, left:right] + 0.5
            u, v = (d * (x - e) - c * (y - f)) / det, (a * (y - f) - b * (x - e)) / det
            inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
            col = np.clip((u * image.shape[1]).astype(int), 0, image.shape[1] - 1)
            row = np.clip(((1 - v) * image.shape[0]).astype(int), 0, image.shape[0] - 1)
            part = image[row, col].copy()
            part[..., 3] *= inside
        share = part[..., 3].astype(np.float32) / 255 * state["fa"]
        fill.paint(self.pixels, (slice(top, bottom), slice(left, right), share), part[..., :3], 1.0, state["clip"])

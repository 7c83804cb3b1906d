"""Lossless WEBP files to pixels.  Lossy ones and animations are not read; ``Unreadable`` says so."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .jpeg import Unreadable

# Fixed values of the format: the order in which lengths of length codes come, and the cache's multiplier.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
#: Short distances stand for pixels near by: those above and to the left, nearest first, within eight columns and seven rows.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
PREDICT, COLOUR, GREEN, PALETTE = range(4)


class _Bits:
    """Bits of a file, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.n = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        if not part:
            if self.at > len(self.data) + 64:
                raise Unreadable("the image is cut short")
            part = b"\0" * 8  # as if zeros followed; only so many
            self.at += 8
        else:
            self.at += len(part)
        self.have |= int.from_bytes(part, "little") << self.n
        self.n += 8 * len(part)

    def read(self, n: int) -> int:
        while self.n < n:
            self.fill()
        value = self.have & ((1 << n) - 1)
        self.have >>= n
        self.n -= n
        return value


class _Code:
    """A prefix code from its lengths: looked up 15 bits at a time."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        if not used:
            raise Unreadable("a code has no symbol")
        if self.only is None:
            if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
                raise Unreadable("a code is not complete")
            self.most = max(n for n, _ in used)
            self.table, code, last = [0] * (1 << self.most), 0, 0
            for n, s in sorted(used):
                code <<= n - last
                last = n
                first = int(format(code, f"0{n}b")[::-1], 2)
                self.table[first :: 1 << n] = [s << 4 | n] * (1 << (self.most - n))
                code += 1

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        while bits.n < self.most:
            bits.fill()
        got = self.table[bits.have & ((1 << self.most) - 1)]
        bits.have >>= got & 15
        bits.n -= got & 15
        return got >> 4


def _code(bits: _Bits, size: int) -> _Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for s in [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]:
            if s >= size:
                raise Unreadable("a symbol is out of range")
            lengths[s] = 1
        return _Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    code = _Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before, at = s or before, at + 1
            continue
        n, value = ((3 + bits.read(2), before), (3 + bits.read(3), 0), (11 + bits.read(7), 0))[s - 16]
        if at + n > size:
            raise Unreadable("a code is too long")
        lengths[at : at + n] = [value] * n
        at += n
    return _Code(lengths)


def _prefixed(symbol: int, bits: _Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _image(bits: _Bits, width: int, height: int, main: bool = False) -> list[int]:
    """Pixels as alpha, red, green, blue in one number each."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Unreadable("a cache is too large")
    block, groups, n = 0, [0], 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        wide = (width + (1 << block) - 1) >> block
        groups = [p >> 8 & 0xFFFF for p in _image(bits, wide, (height + (1 << block) - 1) >> block)]
        n = max(groups) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_code(bits, s) for s in sizes] for _ in range(n)]
    total, out, cache, known = width * height, [], [0] * (1 << cache_bits), 0
    shift = 32 - cache_bits
    while len(out) < total:
        at = len(out)
        if block:
            y, x = divmod(at, width)
            own = codes[groups[(y >> block) * wide + (x >> block)]]
        else:
            own = codes[0]
        s = own[0].read(bits)
        if s < 256:
            red, blue, alpha = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _prefixed(s - 256, bits)
            distance = _prefixed(own[4].read(bits), bits)
            if distance > len(NEAR):
                distance -= len(NEAR)
            else:
                x, y = NEAR[distance - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise Unreadable("a copy reaches outside the image")
            for _ in range(length):
                out.append(out[-distance])
        else:
            while known < at:  # the cache follows what was read
                cache[(HASH * out[known] & 0xFFFFFFFF) >> shift] = out[known]
                known += 1
            out.append(cache[s - 280])
    return out


def _planes(pixels: list[int], width: int) -> np.ndarray:
    """(height, width, 4): red, green, blue, alpha."""
    raw = np.array(pixels, np.uint32).reshape(-1, width)
    return np.stack([raw >> s & 255 for s in (16, 8, 0, 24)], axis=2).astype(np.uint8)


def _half(a, b):
    return (a.astype(np.int16) + b) >> 1


def _guess(mode: int, left, top, corner, right):
    """What a pixel is predicted to be from those around it."""
    l, t, c, r = (x.astype(np.int16) for x in (left, top, corner, right))  # noqa: E741
    if mode == 5:
        return _half(_half(l, r), t)
    if mode == 6:
        return _half(l, c)
    if mode == 7:
        return _half(l, t)
    if mode == 10:
        return _half(_half(l, c), _half(t, r))
    if mode == 11:
        return l if np.abs(t - c).sum() < np.abs(l - c).sum() else t
    if mode == 12:
        return np.clip(l + t - c, 0, 255)
    mean = _half(l, t)
    return np.clip(mean + np.trunc((mean - c) / 2).astype(np.int16), 0, 255)


def _predicted(x: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = x.shape[:2]
    out = x.copy()
    out[0, 0, 3] = (int(out[0, 0, 3]) + 255) % 256
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] += above[0]
        begins = [1, *range(1 << block, width, 1 << block)]
        for a, b in zip(begins, [*begins[1:], width]):
            mode = modes[y >> block, a >> block] & 15
            here, top, corner = slice(a, b), above[a:b], above[a - 1 : b - 1]
            after = above[a + 1 : b + 1] if b < width else np.vstack([above[a + 1 :], row[:1]])
            if mode == 1:
                row[here] = (np.cumsum(row[here], axis=0, dtype=np.uint8) + row[a - 1]).astype(np.uint8)
            elif mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                black = np.array([0, 0, 0, 255], np.uint8)
                row[here] += {2: top, 3: after, 4: corner, 8: _half(corner, top), 9: _half(top, after)}.get(mode, np.broadcast_to(black, top.shape)).astype(np.uint8)
            else:
                for i in range(a, b):
                    row[i] += _guess(mode, row[i - 1], above[i], above[i - 1], after[i - a]).astype(np.uint8)
    return out


def _recoloured(x: np.ndarray, multipliers: np.ndarray, block: int) -> np.ndarray:
    height, width = x.shape[:2]
    m = np.repeat(np.repeat(multipliers, 1 << block, axis=0), 1 << block, axis=1)[:height, :width].view(np.int8).astype(np.int32)
    times = lambda a, b: a * b.view(np.int8).astype(np.int32) >> 5
    out = x.copy()
    green = np.ascontiguousarray(x[..., 1])
    out[..., 0] = x[..., 0] + times(m[..., 2], green)
    out[..., 2] = x[..., 2] + times(m[..., 1], green) + times(m[..., 0], np.ascontiguousarray(out[..., 0]))
    return out


def _lossless(data: bytes, most: int) -> np.ndarray:
    bits = _Bits(data)
    if bits.read(8) != 0x2F:
        raise Unreadable("not lossless WEBP")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3) or width * height > most:
        raise Unreadable("of another version or too large")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (k for k, *_ in undo):
            raise Unreadable("a transform comes twice")
        if kind in (PREDICT, COLOUR):
            block = bits.read(3) + 2
            across = (wide + (1 << block) - 1) >> block
            undo.append((kind, _planes(_image(bits, across, (height + (1 << block) - 1) >> block), across), block, wide))
        elif kind == GREEN:
            undo.append((kind, None, 0, wide))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_planes(_image(bits, n, 1), n)[0], axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, table, pack, wide))
            wide = (wide + (1 << pack) - 1) >> pack
    x = _planes(_image(bits, wide, height, True), wide)
    for kind, own, n, wide in reversed(undo):
        if kind == PREDICT:
            x = _predicted(x, own[..., 1], n)
        elif kind == COLOUR:
            x = _recoloured(x, own, n)
        elif kind == GREEN:
            x = x.copy()
            x[..., 0] += x[..., 1]
            x[..., 2] += x[..., 1]
        else:
            each = 8 >> n
            places = (x[..., 1][:, :, None] >> (np.arange(1 << n) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            x = np.vstack([own, np.zeros((256, 4), np.uint8)])[places]
    return x if alpha else x[..., :3]


def decode(data: bytes, most: int = 200_000_000) -> np.ndarray:
    """Pixels (height, width, 3, or 4 with transparency) of a still lossless WEBP."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Unreadable("not a WEBP")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"VP8L":
            try:
                return _lossless(data[at + 8 : at + 8 + size], most)
            except (IndexError, ValueError) as e:
                raise e if isinstance(e, Unreadable) else Unreadable("the image contradicts itself") from e
        if kind in (b"VP8 ", b"ANIM"):
            raise Unreadable("lossy WEBP" if kind == b"VP8 " else "an animation")
        at += 8 + size + size % 2
    raise Unreadable("there is no image in it")


def decoded(files: DataFrame) -> DataFrame:
    """files with width, height, pixels (RGB or RGBA) of the WEBP in ``content``, or a reason why it can't be read."""
    kept = files.drop("content")
    schema = kept.withColumns({"width": F.lit(0), "height": F.lit(0), "pixels": F.lit(b""), "reason": F.lit("")}).schema

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: rasters are large
                one, got = b.slice(i, 1), (None, None, None, None)
                try:
                    x = decode(one.column("content")[0].as_py() or b"")
                    got = (x.shape[1], x.shape[0], x.tobytes(), None)
                except Unreadable as e:
                    got = (None, None, None, str(e))
                out = one.select([c for c in one.schema.names if c != "content"])
                for name, value, kind in zip(("width", "height", "pixels", "reason"), got, (pa.int32(), pa.int32(), pa.binary(), pa.string())):
                    out = out.append_column(name, pa.array([value], kind))
                yield out

    return files.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema]))

"""JPEG in NumPy: writing (baseline, no subsampling, Huffman codes made for the image) and reading baseline files.

Only what cannot be said in columns: called for each raster of an Arrow batch by ``sinks.export``
and ``sources``.  Progressive, arithmetic and 12-bit files are not read; ``Unreadable`` says so.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

QUALITY = 0.92
# Quantisation of brightness and of colour at quality 0.5, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)

#: Places of a block along its diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_k, _n = np.mgrid[:8, :8]
DCT = np.where(_k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _n + 1) * _k * np.pi / 16)


class Unreadable(ValueError):
    """Why a file can't be read."""


def quantiser(table, quality: float = QUALITY) -> np.ndarray:
    q = round(quality * 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits; one more symbol keeps the code of all ones free."""
    heap = [(int(c), 0, [s]) for s, c in enumerate(counts) if c] + [(0, 0, [-1])]
    heapq.heapify(heap)
    length = dict.fromkeys((s for _, _, m in heap for s in m), 0)
    tie = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            length[s] += 1
        tie += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
    by = np.bincount(list(length.values()), minlength=80)
    for n in range(len(by) - 1, 16, -1):  # pairs that are too deep move up beside a shorter one
        while by[n]:
            m = next(m for m in range(n - 2, 0, -1) if by[m])
            by[n] -= 2
            by[n - 1] += 1
            by[m + 1] += 2
            by[m] -= 1
    by[max(n for n in range(80) if by[n])] -= 1  # the symbol that does not exist
    order = sorted((s for s in length if s >= 0), key=lambda s: (length[s], s))
    return dict(zip(order, np.repeat(np.arange(80), by).tolist()))


def codes(length: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol, shorter codes first."""
    code, value, last = np.zeros(256, np.int64), 0, 0
    size = np.zeros(256, np.int64)
    for symbol, n in length.items():
        value <<= n - last
        code[symbol], size[symbol], last = value, n, n
        value += 1
    return code, size


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def encode(pixels: np.ndarray, quality: float = QUALITY) -> bytes:
    """A JFIF file of RGB, RGBA (on black, as canvases are) or grey pixels, and nothing else: no metadata."""
    height, width = pixels.shape[:2]
    if not (0 < height < 65536 and 0 < width < 65536):
        raise ValueError("a JPEG has 1 to 65535 rows and columns")
    x = pixels.reshape(height, width, -1).astype(float)
    if x.shape[2] == 4:
        x = x[..., :3] * (x[..., 3:] / 255)
    if x.shape[2] == 1:
        planes = [x[..., 0]]
    else:
        r, g, b = np.moveaxis(x, 2, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    tables = [quantiser(LUMA, quality), quantiser(CHROMA, quality)][: len(planes)]
    found = [np.rint((DCT @ (_blocks(p) - 128) @ DCT.T).reshape(-1, 64) / tables[min(i, 1)])[:, ZIGZAG] for i, p in enumerate(planes)]
    z = np.stack(found, axis=1).astype(np.int64)  # block, plane, coefficient
    z[1:, :, 0] -= z[:-1, :, 0].copy()
    rows = z.reshape(-1, 64)
    kind = np.tile(np.minimum(np.arange(len(planes)), 1), len(z)) * 2  # table: + 0 for the first coefficient, + 1 for others
    # One event for each code, in order: the first coefficient, runs of 16 zeros, others, the end of the block.
    row, col = np.nonzero(rows[:, 1:])
    before = np.where(np.r_[True, row[1:] != row[:-1]] if len(row) else [], -1, np.r_[-1, col[:-1]][: len(col)])
    run, value = col - before - 1, rows[row, col + 1]
    long = np.repeat(np.arange(len(row)), run // 16)
    last = np.full(len(rows), -1)
    last[row] = col
    ends = np.flatnonzero(last < 62)
    bits = lambda v: np.frexp(np.abs(v).astype(float))[1].astype(np.int64)
    first = rows[:, 0]
    n = np.arange(len(rows))
    at = np.concatenate([n * 256, row[long] * 256 + col[long] * 2 + 1, row * 256 + col * 2 + 2, ends * 256 + 255])
    table = np.concatenate([kind, kind[row[long]] + 1, kind[row] + 1, kind[ends] + 1])
    symbol = np.concatenate([bits(first), np.full(len(long), 0xF0), (run % 16) * 16 + bits(value), np.zeros(len(ends), np.int64)])
    number = np.concatenate([first, np.zeros(len(long), np.int64), value, np.zeros(len(ends), np.int64)])
    order = np.argsort(at, kind="stable")
    table, symbol, number = table[order], symbol[order], number[order]
    extra = symbol & 15
    extra = np.where(number == 0, 0, extra)
    number = np.where(number < 0, number + (1 << extra) - 1, number)
    made = [code_lengths(np.bincount(symbol[table == t], minlength=256)) for t in range(2 * len(tables))]
    books = [codes(m) for m in made]
    code, size = (np.choose(table, [b[i][symbol] for b in books]) for i in (0, 1))
    word, wide = code << extra | number, size + extra
    ends_at = np.cumsum(wide)
    place = np.repeat(ends_at, wide) - 1 - np.arange(ends_at[-1])
    stream = (np.repeat(word, wide) >> place & 1).astype(np.uint8)
    stream = np.packbits(np.r_[stream, np.ones(-len(stream) % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\0")

    def segment(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(len(planes))))
    for t, m in enumerate(made):
        counts = np.bincount(list(m.values()), minlength=17)[1:17]
        out += segment(0xC4, bytes([t % 2 * 16 + t // 2]) + bytes(counts.tolist()) + bytes(m))
    out += segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, min(i, 1) * 17]) for i in range(len(planes))) + b"\0\x3f\0")
    return out + stream + b"\xff\xd9"


def segments(data: bytes):
    """(marker, body) of a JPEG up to its first scan, whose body is the rest of the file."""
    if data[:2] != b"\xff\xd8":
        raise Unreadable("not a JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unreadable("a marker is missing")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise Unreadable("a segment is cut short")
        yield mark, data[at + 4 : at + 2 + size]
        if mark == 0xDA:
            yield 0, data[at + 2 + size :]
            return
        at += 2 + size
    raise Unreadable("there is no image in it")


def _lookup(lengths: bytes, symbols: bytes) -> list[int]:
    """symbol * 32 + length for each 16 bits that may follow."""
    table, code, k = np.zeros(65536, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            if k >= len(symbols) or (code + 1) << (16 - n) > 65536:
                raise Unreadable("a code table is wrong")
            table[code << (16 - n) : (code + 1) << (16 - n)] = symbols[k] * 32 + n
            code, k = code + 1, k + 1
        code <<= 1
    return table.tolist()


class _Bits:
    """16 bits from any position of a scan; windows are made for a part at a time."""

    PART = 1 << 15

    def __init__(self, data: bytes):
        self.data, self.start, self.words, self.end = data, 0, [], 0

    def load(self, at: int) -> None:
        if at > len(self.data) * 8 + 64:
            raise Unreadable("the image is cut short")
        first = at // 8
        x = np.frombuffer(self.data[first : first + self.PART + 8] + b"\xff" * 12, np.uint8).astype(np.uint32)
        w = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        self.words = ((w[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).ravel().tolist()
        self.start = first * 8
        self.end = self.start + min(self.PART, len(self.data) + 8 - first) * 8


def _wider(x: np.ndarray, times: int) -> np.ndarray:
    """Rows of a thinner plane for the image's: a quarter of the neighbour where there are half as many, else repeated."""
    if times != 2:
        return np.repeat(x, times, axis=0)
    out = np.repeat(x * 0.75, 2, axis=0)
    out[0::2] += np.concatenate([x[:1], x[:-1]]) / 4
    out[1::2] += np.concatenate([x[1:], x[-1:]]) / 4
    return out


def decode(data: bytes, most: int = 200_000_000) -> np.ndarray:
    """Pixels (height, width, 1 or 3) of a baseline JPEG of ``most`` pixels or fewer."""
    try:
        return _decode(data, most)
    except (IndexError, struct.error, ValueError) as e:
        raise e if isinstance(e, Unreadable) else Unreadable("a segment contradicts itself") from e


def _decode(data: bytes, most: int) -> np.ndarray:
    quant, tables, frame, every, adobe = {}, {}, None, 0, None
    scan = stream = b""
    for mark, body in segments(data):
        if mark == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                if len(raw) < 64:
                    raise Unreadable("a quantisation table is cut short")
                quant[which] = np.zeros(64)
                quant[which][ZIGZAG] = raw
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while len(body) > 16:
                n = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise Unreadable("more than 8 bits a sample")
            if n not in (1, 3) or not height or not width or height * width > most:
                raise Unreadable("neither grey nor colour, or of no proper size")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 < mark < 0xD0 and mark not in (0xC8, 0xCC):
            raise Unreadable("progressive or arithmetic JPEG")
        elif mark == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11] if len(body) > 11 else None
        elif mark == 0xDA:
            scan = body
        elif mark == 0:
            stream = body
    if frame is None or len(scan) < 1 + 2 * len(frame) or scan[0] != len(frame):
        raise Unreadable("its planes come one by one")
    uses = {scan[1 + 2 * i]: scan[2 + 2 * i] for i in range(scan[0])}
    across, down = (max(f[i] for f in frame) for i in (1, 2))
    if not across or not down or any(not f[1] or not f[2] or f[0] not in uses or f[3] not in quant for f in frame):
        raise Unreadable("its header contradicts itself")
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        across = down = 1
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    coefs = [np.zeros((high * v * wide * h, 64), np.int32) for _, h, v, _ in frame]
    plan = []  # of a unit: plane, first of its blocks within the unit
    for p, (i, h, v, _) in enumerate(frame):
        try:
            own = (tables[uses[i] >> 4], tables[16 + (uses[i] & 15)])
        except KeyError:
            raise Unreadable("a code table is missing") from None
        plan += [(p, *own, r, c, h, v) for r in range(v) for c in range(h)]
    parts, at = [], 0
    while (hit := stream.find(b"\xff", at)) >= 0 and hit + 1 < len(stream) and (stream[hit + 1] == 0 or 0xD0 <= stream[hit + 1] <= 0xD7 or stream[hit + 1] == 0xFF):
        if 0xD0 <= stream[hit + 1] <= 0xD7:
            parts.append(hit)
        at = hit + 1 if stream[hit + 1] == 0xFF else hit + 2
    cuts = [0, *(p + 2 for p in parts)], [*parts, hit if hit >= 0 else len(stream)]
    units = wide * high
    step = every or units
    for k, (a, b) in enumerate(zip(*cuts)):
        if k * step >= units:
            break
        _scan(_Bits(stream[a:b].replace(b"\xff\0", b"\xff")), range(k * step, min(units, k * step + step)), plan, coefs, wide)
    planes = []
    for (_, h, v, q), c in zip(frame, coefs):
        x = np.zeros((len(c), 64))
        x[:, ZIGZAG] = c
        x = DCT.T @ (x * quant[q]).reshape(-1, 8, 8) @ DCT + 128
        x = x.reshape(high * v, wide * h, 8, 8).swapaxes(1, 2).reshape(high * v * 8, wide * h * 8)
        x = x[: -(-height * v // down), : -(-width * h // across)]
        x = _wider(_wider(x, down // v).T, across // h).T
        planes.append(x[:height, :width])
    if len(planes) == 3 and adobe != 0:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)


def _scan(bits: _Bits, units: range, plan, coefs, wide: int) -> None:
    """The coefficients of one run of units: prediction starts anew."""
    last, at = [0] * len(coefs), 0
    rows, cols, values = ([[] for _ in coefs] for _ in range(3))
    bits.load(0)
    words, start, end = bits.words, bits.start, bits.end
    for u in units:
        for p, first, rest, r, c, h, v in plan:
            block = ((u // wide) * v + r) * (wide * h) + (u % wide) * h + c
            k, table = 0, first
            while k < 64:
                if at >= end:
                    bits.load(at)
                    words, start, end = bits.words, bits.start, bits.end
                    if at >= end:
                        raise Unreadable("the image is cut short")
                got = table[words[at - start]]
                if not got:
                    raise Unreadable("a code is wrong")
                at += got & 31
                symbol = got >> 5
                n = symbol & 15
                if k:
                    if not n and symbol != 0xF0:
                        break
                    k += symbol >> 4
                    if k > 63:
                        raise Unreadable("a block is too long")
                if n:
                    value = words[at - start] >> (16 - n)
                    at += n
                    if value < 1 << (n - 1):
                        value -= (1 << n) - 1
                else:
                    value = 0
                if not k:
                    value += last[p]
                    last[p] = value
                if value:
                    rows[p].append(block)
                    cols[p].append(k)
                    values[p].append(value)
                k += 1
                table = rest
    for p, c in enumerate(coefs):
        c[rows[p], cols[p]] = values[p]


def decoded(files: DataFrame) -> DataFrame:
    """files with width, height, pixels (RGB or grey) of the JPEG in ``content``, or a reason why it can't be read."""
    kept = files.drop("content")
    schema = kept.withColumns({"width": F.lit(0), "height": F.lit(0), "pixels": F.lit(b""), "reason": F.lit("")}).schema

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: rasters are large
                one, reason = b.slice(i, 1), None
                try:
                    x = decode(one.column("content")[0].as_py() or b"")
                except Unreadable as e:
                    x, reason = None, str(e)
                out = one.select([c for c in one.schema.names if c != "content"])
                got = (x.shape[1], x.shape[0], x.tobytes()) if x is not None else (None, None, None)
                for name, value, kind in zip(("width", "height", "pixels", "reason"), (*got, reason), (pa.int32(), pa.int32(), pa.binary(), pa.string())):
                    out = out.append_column(name, pa.array([value], kind))
                yield out

    return files.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema]))

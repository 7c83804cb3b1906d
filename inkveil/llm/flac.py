"""FLAC in NumPy: a lossless mono codec whose frames are coded and decoded in lockstep.

The format is the public one (RFC 9639).  Written streams have a STREAMINFO block with the
MD5 of the samples, a SEEKTABLE with one point for every frame, and frames of ``BLOCK``
samples (the last may be shorter), each coded by the cheapest of: constant, verbatim, fixed
predictors of order 0 to 2, a linear predictor of order 4 with 9-bit coefficients; residuals
are Rice-coded.  Reading takes any mono stream of 4 to 16 bits a sample with these and all
other fixed and linear predictors, both Rice methods, partitions, escapes and wasted bits.

All frames of a batch advance together, one sample a step, so that each step is a few array
operations over all frames; a frame's header CRC-8 and its CRC-16 are verified the same way.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

BLOCK, ORDER, PRECISION, SHIFT, RATE = 1024, 4, 9, 6, 44_100
MAGIC = b"fLaC"
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # fixed values of the format


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CLZ16 = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _crc16(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many slices at once; zeros before a slice leave a CRC that begins at zero."""
    out = np.zeros(len(start), np.int64)
    if not len(start):
        return out
    order = np.argsort(-size, kind="stable")
    first, longest = start[order], int(size.max())
    begins = (longest - size)[order]  # the step at which each slice begins, ascending
    upto = np.searchsorted(begins, np.arange(longest), side="right")
    crc = np.zeros(len(start), np.int64)
    at = first - begins
    for step in range(longest):
        n = upto[step]
        c = crc[:n]
        crc[:n] = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ buf[at[:n] + step]]
    out[order] = crc
    return out


def _utf8(n: int) -> bytes:
    """The frame number as the format codes it: UTF-8 carried on to 36 bits."""
    if n < 0x80:
        return bytes((n,))
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 1)][::-1]
    return bytes(((0xFF00 >> size) & 0xFF | n >> (6 * (size - 1)), *tail))


def _frame_header(number: int, size: int) -> bytes:
    code, more = (0b1010, b"") if size == 1024 else (0b0111, (size - 1).to_bytes(2, "big"))
    head = b"\xff\xf8" + bytes((code << 4, 0b0000_001_0)) + _utf8(number) + more
    return head + bytes((crc8(head),))


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 63)


def _rice(u_sum: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A parameter near the best for the mean of the zigzagged residuals."""
    mean = u_sum / np.maximum(n, 1)
    return np.clip(np.floor(np.log2(np.maximum(mean * 0.693147 + 1e-9, 1e-9))) + 1, 0, 14).astype(np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of 8-bit samples for each payload: byte b is sample b - 128."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    coded: list[list[bytes]] = [[] for _ in payloads]
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[owner] + number * BLOCK
    for at in range(0, len(owner), 512):
        part = slice(at, at + 512)
        for i, frame in zip(owner[part].tolist(), _encode_frames(raw, begin[part], length[part], number[part])):
            coded[i].append(frame)
    return [_stream(p, frames) for p, frames in zip(payloads, coded)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    signed = bytes(payload).translate(_TO_SIGNED)
    least, most = min(map(len, frames), default=0), max(map(len, frames), default=0)
    info = (
        BLOCK.to_bytes(2, "big") * 2
        + least.to_bytes(3, "big")
        + most.to_bytes(3, "big")
        + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
        + hashlib.md5(signed).digest()
    )
    points, offset = [], 0
    for k, f in enumerate(frames):
        points.append((k * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(payload) - k * BLOCK).to_bytes(2, "big"))
        offset += len(f)
    # A metadata block holds 2**24 - 1 bytes, so a longer table is several blocks.
    per = ((1 << 24) - 1) // 18
    tables = [b"".join(points[i : i + per]) for i in range(0, len(points), per)]
    blocks = [(0, info), *((3, t) for t in tables)]
    meta = b"".join(bytes((kind | (0x80 if i == len(blocks) - 1 else 0),)) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(blocks))
    return b"".join((MAGIC, meta, *frames))


_TO_SIGNED = bytes((b - 128) & 0xFF for b in range(256))


def _encode_frames(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, number: np.ndarray) -> list[bytes]:
    lanes, width = len(begin), int(length.max())
    t = np.arange(width)
    inside = t[None, :] < length[:, None]
    s = np.where(inside, raw[np.minimum(begin[:, None] + t, len(raw) - 1)].astype(np.int32) - 128, 0)
    # Candidates: (order, residual), fixed 0 to 2 and a linear predictor.
    d1 = s.copy()
    d1[:, 1:] -= s[:, :-1]
    d2 = d1.copy()
    d2[:, 1:] -= d1[:, :-1]
    f = s.astype(np.float32)
    lags = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : width - k]) if k < width else np.zeros(lanes, np.float32) for k in range(ORDER + 1)], axis=1).astype(np.float64)
    toeplitz = lags[:, np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))]
    toeplitz = toeplitz + np.eye(ORDER) * (1.0 + 1e-4 * lags[:, :1, None])
    coef = np.linalg.solve(toeplitz, lags[:, 1:, None])[:, :, 0]
    limit = 1 << (PRECISION - 1)
    coef = np.clip(np.rint(coef * (1 << SHIFT)), -limit, limit - 1).astype(np.int32)
    guess = np.zeros_like(s)
    for j in range(ORDER):
        if width > j + 1:
            guess[:, j + 1 :] += coef[:, j : j + 1] * s[:, : width - j - 1]
    lpc = s - (guess >> SHIFT)
    best = np.full(lanes, 8 * 0, np.int64) + 8 * length  # verbatim
    kind, k, residual = np.full(lanes, -1), np.zeros(lanes, np.int64), s.astype(np.int64)
    for order, which, e in ((0, 0, s), (1, 1, d1), (2, 2, d2), (ORDER, 3, lpc)):
        u = (e << 1) ^ (e >> 31)
        u = np.where(inside & (t >= order), u, 0)
        n = np.maximum(length - order, 0)
        kk = _rice(u.sum(axis=1), n)
        bits = (u >> kk[:, None]).sum(axis=1) + n * (kk + 1) + 10 + 8 * order + (9 + PRECISION * ORDER if which == 3 else 0)
        better = (bits < best) & (length > order)
        best[better], kind[better], k[better] = bits[better], which, kk[better]
        residual[better] = e[better]
    same = (np.where(inside, s, s[:, :1]) == s[:, :1]).all(axis=1)
    kind[same] = -2
    order = np.select([kind == 0, kind == 1, kind == 2, kind == 3], [0, 1, 2, ORDER], 0)

    heads = [_frame_header(n, size) for n, size in zip(number.tolist(), length.tolist())]
    head_bits = np.array([8 * len(h) for h in heads])
    rice = kind >= 0
    u = np.where(inside & (t >= order[:, None]) & rice[:, None], _zigzag(residual), 0)
    q = u >> k[:, None]
    code = np.where(inside & (t >= order[:, None]) & rice[:, None], q + 1 + k[:, None], 0)
    extra = np.where(kind == 3, 9 + PRECISION * ORDER, 0)
    body = 8 + np.select([kind == -2, kind == -1], [8, 8 * length], order * 8 + extra + 10 + code.sum(axis=1))
    size = head_bits // 8 + (body + 7) // 8 + 2
    start = np.cumsum(size) - size
    bits = np.zeros(8 * int(size.sum()), np.uint8)

    def put(at: np.ndarray, value: np.ndarray, n: int) -> None:
        for i in range(n):
            bits[at + i] = (value >> (n - 1 - i)) & 1

    p = 8 * start + head_bits
    subtype = np.select([kind == -2, kind == -1, kind == 3], [0, 1, 32 + ORDER - 1], 8 + np.maximum(kind, 0))
    put(p, subtype << 1, 8)
    p = p + 8
    put(p[kind == -2], s[kind == -2, 0] & 0xFF, 8)
    plain = np.flatnonzero(kind == -1)
    if len(plain):
        i, j = np.nonzero(inside[plain])
        put(p[plain][i] + 8 * j, s[plain[i], j] & 0xFF, 8)
    for j in range(ORDER):
        warm = np.flatnonzero(rice & (order > j))
        put(p[warm] + 8 * j, s[warm, j] & 0xFF, 8)
    p = p + 8 * order
    linear = np.flatnonzero(kind == 3)
    if len(linear):
        put(p[linear], np.full(len(linear), PRECISION - 1), 4)
        put(p[linear] + 4, np.full(len(linear), SHIFT), 5)
        for j in range(ORDER):
            put(p[linear] + 9 + PRECISION * j, coef[linear, j] & ((1 << PRECISION) - 1), PRECISION)
        p[linear] += 9 + PRECISION * ORDER
    put(p[rice] + 6, k[rice], 4)
    p = p + 10
    where = p[:, None] + np.cumsum(code, axis=1) - code
    i, j = np.nonzero(code)
    stop = where[i, j] + q[i, j]
    bits[stop] = 1
    low, kk = u[i, j], k[i]
    for b in range(int(k.max()) if lanes else 0):
        has = kk > b
        bits[(stop + kk - b)[has]] = (low[has] >> b) & 1
    packed = np.packbits(bits)
    for a, h in zip(start.tolist(), heads):
        packed[a : a + len(h)] = np.frombuffer(h, np.uint8)
    check = _crc16(packed, start, size - 2)
    packed[start + size - 2], packed[start + size - 1] = check >> 8, check & 0xFF
    data = packed.tobytes()
    return [data[a : a + n] for a, n in zip(start.tolist(), size.tolist())]


@dataclass
class Stream:
    bits: int
    rate: int
    samples: int
    block: int
    md5: bytes
    points: list[tuple[int, int, int]]  # sample, byte offset from the first frame, samples
    audio: int  # where the first frame begins


def metadata(data: bytes) -> Stream:
    if data[:4] != MAGIC:
        raise FlacError("no FLAC stream")
    at, info, points = 4, None, []
    while True:
        if at + 4 > len(data):
            raise FlacError("the metadata is cut off")
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if kind & 0x7F == 0:
            x = int.from_bytes(body[10:18], "big")
            if x >> 41 & 7:
                raise FlacError("only mono is read")
            info = ((x >> 36 & 31) + 1, x >> 44, x & ((1 << 36) - 1), int.from_bytes(body[2:4], "big"), body[18:34])
        elif kind & 0x7F == 3:
            for i in range(0, n, 18):
                a, b, c = (int.from_bytes(body[i + f : i + g], "big") for f, g in ((0, 8), (8, 16), (16, 18)))
                if a != (1 << 64) - 1:
                    points.append((a, b, c))
        if kind & 0x80:
            break
    if info is None:
        raise FlacError("no STREAMINFO")
    return Stream(*info, points, at)


def _header(data, at: int, stream: Stream) -> tuple[int, int, int]:
    """(frame or sample number, samples, bytes of the header), after the CRC-8 has been verified."""
    h = bytes(data[at : at + 20])
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should begin")
    code, rate = h[2] >> 4, h[2] & 15
    if h[3] >> 4:
        raise FlacError("only mono is read")
    lead = h[4]
    more = 0 if lead < 0x80 else (lead ^ 0xFF).bit_length() and 7 - (lead ^ 0xFF).bit_length()
    number = lead if not more else lead & ((1 << (6 - more)) - 1) if more < 6 else 0
    for i in range(more):
        number = number << 6 | h[5 + i] & 0x3F
    p = 5 + more
    if code == 6:
        size, p = h[p] + 1, p + 1
    elif code == 7:
        size, p = int.from_bytes(h[p : p + 2], "big") + 1, p + 2
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(h[:p]) != h[p]:
        raise FlacError("a frame header's CRC-8 is wrong")
    return number, size, p + 1


class _Reader:
    def __init__(self, buf: np.ndarray):
        x = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.window = ((x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]).astype(np.int64)
        self.last = len(self.window) - 1

    def peek(self, p: np.ndarray) -> np.ndarray:
        """32 bits from bit p on, of which at least 25 are real."""
        return (self.window[np.minimum(p >> 3, self.last)] << (p & 7)) & 0xFFFFFFFF

    def bits(self, p: np.ndarray, n) -> np.ndarray:
        """The next n (at most 24) bits; n may differ from lane to lane."""
        return self.peek(p) >> (32 - n)

    def signed(self, p: np.ndarray, n) -> np.ndarray:
        v = self.bits(p, n)
        n = np.asarray(n)
        return np.where(n > 0, v - ((v >> np.maximum(n - 1, 0)) << n), 0)

    def unary(self, p: np.ndarray) -> np.ndarray:
        z = _CLZ16[self.peek(p) >> 16]
        run = np.flatnonzero(z == 16)
        while len(run):
            q = p[run] + z[run]
            if (q >> 3 > self.last).any():
                raise FlacError("a frame is cut off")
            step = _CLZ16[self.peek(q) >> 16]
            z[run] += step
            run = run[step == 16]
        return z


def _frames(buf: np.ndarray, at: np.ndarray, size: np.ndarray, bps: int, ends: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Decodes subframes from byte positions ``at``; returns samples (lane, t) and the frames' ends in bytes."""
    read, lanes, width = _Reader(buf), len(at), int(size.max())
    out = np.zeros((width, lanes), np.int64)
    p = 8 * at
    kind = read.bits(p + 1, 6)
    wasted = read.bits(p + 7, 1)
    p = p + 8
    some = np.flatnonzero(wasted)
    if len(some):
        z = read.unary(p[some])
        wasted[some] = z + 1
        p[some] += z + 1
    depth = bps - wasted
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind <= 1)).all():
        raise FlacError("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    if (order > size).any():
        raise FlacError("a predictor longer than its block")
    most = int(order.max())
    constant = np.flatnonzero(kind == 0)
    if len(constant):
        out[:, constant] = read.signed(p[constant], depth[constant])
        p[constant] += depth[constant]
    for t in range(width if (kind == 1).any() else 0):
        own = np.flatnonzero((kind == 1) & (size > t))
        out[t, own] = read.signed(p[own], depth[own])
        p[own] += depth[own]
    for t in range(most):
        own = np.flatnonzero(order > t)
        out[t, own] = read.signed(p[own], depth[own])
        p[own] += depth[own]
    coef, shift = np.zeros((most, lanes), np.int64), np.zeros(lanes, np.int64)
    for o in range(1, min(4, most) + 1):
        for j, c in enumerate(FIXED[o]):
            coef[j, fixed & (order == o)] = c
    own = np.flatnonzero(linear)
    if len(own):
        precision = read.bits(p[own], 4) + 1
        shift[own] = read.signed(p[own] + 4, 5)
        if (precision == 16).any() or (shift < 0).any():
            raise FlacError("a reserved precision or shift")
        p[own] += 9
        for j in range(most):
            has = order[own] > j
            coef[j, own[has]] = read.signed(p[own[has]], precision[has])
            p[own[has]] += precision[has]
    coded = np.flatnonzero(fixed | linear)
    if len(coded):
        method = read.bits(p[coded], 2)
        if (method > 1).any():
            raise FlacError("a reserved residual coding")
        parts = read.bits(p[coded] + 2, 4)
        p[coded] += 6
        # The longest first, so that the lanes still open are the first ones.
        by = np.argsort(-size[coded], kind="stable")
        lane, method, parts = coded[by], method[by], parts[by]
        n, first, pos = size[lane], order[lane], p[lane]
        step = np.maximum(n >> parts, 1)
        if ((n >> parts) << parts != n).any() or (first > step).any():
            raise FlacError("partitions that don't fit their block")
        k, escape = np.zeros(len(lane), np.int64), np.full(len(lane), -1)
        open_at = np.searchsorted(-n, -np.arange(width), side="left")
        least = int(first.min())
        c, sh = coef[:, lane], shift[lane]
        hist = out[:, lane]
        uneven = (parts > 0).any() or bool((first != least).any())
        flat = bool((sh == 0).all())
        for t in range(least, width):
            m = int(open_at[t])
            if not m:
                break
            q = pos[:m]
            live = None
            if t == least or uneven:
                begin = (first[:m] == t) | ((t % step[:m] == 0) & (t > first[:m])) if uneven else np.ones(m, bool)
                own = np.flatnonzero(begin)
                if len(own):
                    wide = 4 + method[own]
                    k[own] = read.bits(q[own], wide)
                    q[own] += wide
                    esc = k[own] == (1 << wide) - 1
                    escape[own] = -1
                    if esc.any():
                        e = own[esc]
                        escape[e] = read.bits(q[e], 5)
                        q[e] += 5
                        k[e] = 0
                if t < int(first.max()):
                    live = np.flatnonzero(first[:m] <= t)
            if live is None:
                kk, v = k[:m], read.peek(q)
                z = _CLZ16[v >> 16]
                if (z + kk > 22).any() or (z == 16).any():
                    z = read.unary(q)
                    low = read.bits(q + z + 1, kk)
                else:
                    low = ((v << (z + 1)) & 0xFFFFFFFF) >> (32 - kk)
                u = (z << kk) | low
                e = (u >> 1) ^ -(u & 1)
                used = z + 1 + kk
                raw = np.flatnonzero(escape[:m] >= 0)
                if len(raw):
                    e[raw] = read.signed(q[raw], escape[raw])
                    used[raw] = escape[raw]
                q += used
                guess = np.zeros(m, np.int64)
                for j in range(min(most, t)):
                    guess += c[j, :m] * hist[t - 1 - j, :m]
                hist[t, :m] = e + (guess if flat else guess >> sh[:m])
            elif len(live):
                ql, kk = q[live], k[live]
                z = read.unary(ql)
                u = (z << kk) | read.bits(ql + z + 1, kk)
                e, used = (u >> 1) ^ -(u & 1), z + 1 + kk
                raw = escape[live] >= 0
                e[raw] = read.signed(ql[raw], escape[live][raw])
                used[raw] = escape[live][raw]
                q[live] += used
                guess = np.zeros(len(live), np.int64)
                for j in range(min(most, t)):
                    guess += c[j, live] * hist[t - 1 - j, live]
                hist[t, live] = e + (guess >> sh[live])
        out[:, lane] = hist
        p[lane] = pos
    end = (p + 7) // 8
    if (end + 2 > len(buf)).any() or (ends is not None and (end + 2 != ends).any()):
        raise FlacError("a frame does not end where it should")
    return out.T << wasted[:, None], end + 2


def _verified(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    said = (buf[end - 2].astype(np.int64) << 8) | buf[end - 1]
    if (_crc16(buf, start, end - 2 - start) != said).any():
        raise FlacError("a frame's CRC-16 is wrong")


def decode(streams: list[bytes], lanes: int = 4096) -> list[np.ndarray]:
    """The samples of each stream, all CRCs and MD5s verified."""
    infos = [metadata(s) for s in streams]
    out = [np.zeros(i.samples, np.int64) for i in infos]
    whole = [_complete(i) for i in infos]
    for which in range(len(streams)):
        if not whole[which]:
            out[which] = _one_by_one(streams[which], infos[which])
    work = [(i, k) for i, info in enumerate(infos) if whole[i] for k in range(len(info.points))]
    for at in range(0, len(work), lanes):
        part = work[at : at + lanes]
        used = sorted({i for i, _ in part})
        offset, total = {}, 0
        for i in used:
            offset[i] = total
            total += len(streams[i])
        buf = np.frombuffer(b"".join(streams[i] for i in used), np.uint8)
        start, end, body, size = (np.zeros(len(part), np.int64) for _ in range(4))
        for n, (i, k) in enumerate(part):
            info = infos[i]
            start[n] = offset[i] + info.audio + info.points[k][1]
            end[n] = offset[i] + (info.audio + info.points[k + 1][1] if k + 1 < len(info.points) else len(streams[i]))
            _, size[n], head = _header(buf, int(start[n]), info)
            body[n] = start[n] + head
        _verified(buf, start, end)
        for bits in {infos[i].bits for i in used}:
            own = np.array([infos[i].bits == bits for i, _ in part])
            got, _ = _frames(buf, body[own], size[own], bits, end[own])
            for (i, k), n, row in zip([w for w, o in zip(part, own) if o], size[own].tolist(), got):
                a, _, c = infos[i].points[k]
                if n != c:
                    raise FlacError("a seek point and its frame disagree")
                out[i][a : a + c] = row[:c]
    for i, info in enumerate(infos):
        if info.md5 != bytes(16) and hashlib.md5(pcm(out[i], info.bits)).digest() != info.md5:
            raise FlacError("the samples' MD5 is wrong")
    return out


def _complete(info: Stream) -> bool:
    """Is there a seek point for every frame?  If not, frames are read one after the other."""
    at, offset = 0, -1
    for sample, where, count in info.points:
        if sample != at or where <= offset:
            return False
        at, offset = at + count, where
    return at == info.samples


def _one_by_one(data: bytes, info: Stream) -> np.ndarray:
    buf, at, got, have = np.frombuffer(data, np.uint8), info.audio, [], 0
    while at < len(data) and (not info.samples or have < info.samples):
        _, size, head = _header(buf, at, info)
        rows, end = _frames(buf, np.array([at + head]), np.array([size]), info.bits, None)
        _verified(buf, np.array([at]), end)
        got.append(rows[0])
        have += size
        at = int(end[0])
    return np.concatenate(got) if got else np.zeros(0, np.int64)


def read_samples(data: bytes, first: int, count: int) -> np.ndarray:
    """Samples first .. first + count - 1, decoding only the frames that hold them."""
    info = metadata(data)
    own = [(k, p) for k, p in enumerate(info.points) if p[0] < first + count and p[0] + p[2] > first]
    if not own:
        return np.zeros(0, np.int64)
    buf = np.frombuffer(data, np.uint8)
    rows = []
    for k, (a, off, c) in own:
        at = info.audio + off
        _, size, head = _header(buf, at, info)
        got, end = _frames(buf, np.array([at + head]), np.array([size]), info.bits, None)
        _verified(buf, np.array([at]), end)
        rows.append(got[0])
    flat = np.concatenate(rows)
    return flat[first - own[0][1][0] :][:count]


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Little-endian signed PCM of whole bytes a sample."""
    wide = (bits + 7) // 8
    if wide == 1:
        return samples.astype(np.int8).tobytes()
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()

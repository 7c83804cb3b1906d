"""Lossless WEBP: a writer made of the format's rules, for each of its means, and the reader."""

import struct

import numpy as np
import pytest
from inkveil.operators import jpeg, webp
from test_pdf import photo


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def data(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(x << i for i, x in enumerate(b[k : k + 8])) for k in range(0, len(b), 8))


def put_code(out, counts, size):
    """Writes a code for the symbols with counts and returns symbol -> (bits, length)."""
    used = sorted(s for s, c in counts.items() if c)
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1), out.put(len(used) - 1, 1), out.put(1, 1), out.put(used[0], 8)
        if len(used) == 2:
            out.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    lengths = jpeg.code_lengths(np.array([counts.get(s, 0) for s in range(size)]))
    longest = max(lengths.values())  # no code is kept free here, so the last one moves up
    spare = 2**longest - sum(2 ** (longest - n) for n in lengths.values())
    for s in sorted(lengths, key=lambda s: -lengths[s]):
        while lengths[s] > 1 and 2 ** (longest - lengths[s]) <= spare:
            spare -= 2 ** (longest - lengths[s])
            lengths[s] -= 1
    assert spare == 0 and longest <= 15
    out.put(0, 1)
    alphabet = sorted({*lengths.values(), 0})
    fixed = {n: 5 for n in range(19)}  # lengths of the lengths' code: all 16 plain ones of 4 bits
    del fixed
    out.put(15, 4)
    for k in webp.LENGTH_ORDER:
        out.put(4 if k < 16 else 0, 3)
    out.put(0, 1)
    for s in range(size):
        n = lengths.get(s, 0)
        out.put(int(format(n, "04b")[::-1], 2), 4)
    assert alphabet[-1] < 16
    code, book, last = 0, {}, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        book[s] = (int(format(code, f"0{last}b")[::-1], 2), last)
        code += 1
    return book


def prefix(value):
    """(symbol, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 1
    second = v >> (n - 1) & 1
    return 2 * n + second, v & ((1 << (n - 1)) - 1), n - 1


def put_image(out, pixels, width, main=False, cache=0, copies=False, split=False):
    """pixels: (n, 4) red, green, blue, alpha."""
    p = [tuple(map(int, x)) for x in pixels]
    number = [a << 24 | r << 16 | g << 8 | b for r, g, b, a in p]
    tokens, store, i, done = [], {}, 0, 0
    while i < len(p):
        if cache:
            while done < i:
                store[(webp.HASH * number[done] & 0xFFFFFFFF) >> (32 - cache)] = number[done]
                done += 1
            key = (webp.HASH * number[i] & 0xFFFFFFFF) >> (32 - cache)
            if store.get(key, 0) == number[i]:
                tokens.append(("cache", i, key))
                i += 1
                continue
        best = (0, 0)
        for code, (x, y) in list(enumerate(webp.NEAR, 1)) + [(d + 120, (d, 0)) for d in range(1, min(i, 40) + 1)] if copies else ():
            d = max(1, x + y * width)
            if d <= i:
                n = 0
                while i + n < len(p) and p[i + n] == p[i + n - d] and n < 300:
                    n += 1
                best = max(best, (n, -code))
        if best[0] > 2:
            tokens.append(("copy", i, best[0], -best[1]))
            i += best[0]
        else:
            tokens.append(("pixel", i, p[i]))
            i += 1
    out.put(1, 1) if cache else out.put(0, 1)
    if cache:
        out.put(cache, 4)
    groups = lambda i: 0
    n = 1
    if main:
        out.put(int(split), 1)
        if split:
            out.put(0, 3)
            wide = (width + 3) >> 2
            marks = [(0, (k % 2), 0, 0) for k in range(wide * ((len(p) // width + 3) >> 2))]
            put_image(out, marks, wide)
            groups, n = (lambda i: ((i // width >> 2) * wide + (i % width >> 2)) % 2), 2
    counts = [[{} for _ in range(5)] for _ in range(n)]

    def walk(put):
        for t in tokens:
            own = counts[groups(t[1])]
            if t[0] == "pixel":
                r, g, b, a = t[2]
                for k, s in ((0, g), (1, r), (2, b), (3, a)):
                    put(own[k], s)
            elif t[0] == "cache":
                put(own[0], 280 + t[2])
            else:
                for k, v in ((0, t[2]), (4, t[3])):
                    s, extra, wide_ = prefix(v)
                    put(own[k], s + (256 if k == 0 else 0))
                    put(None, extra, wide_)

    def count(c, s, *_):
        if c is not None:
            c[s] = c.get(s, 0) + 1

    walk(count)
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    counts = [[put_code(out, c, s) for c, s in zip(g, sizes)] for g in counts]
    walk(lambda c, s, *n: out.put(s, n[0]) if c is None else out.put(*c[s]))


def file_of(out, width, height, alpha, extended=False):
    body = out.data()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    if extended:
        chunk = b"VP8X" + struct.pack("<I", 10) + bytes(10) + b"ICCP" + struct.pack("<I", 3) + b"abc\0" + chunk
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk


def begin(width, height, alpha):
    out = Out()
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(int(alpha), 1), out.put(0, 3)
    return out


def rgba(image):
    return image if image.shape[2] == 4 else np.dstack([image, np.full(image.shape[:2], 255, np.uint8)])


@pytest.fixture
def image():
    x = photo(23, 37)
    x[5:15, 8:30] = (200, 30, 90)
    x[16:20] = x[2]
    return x


@pytest.mark.parametrize("kind", [{}, {"cache": 5}, {"copies": True}, {"split": True}, {"cache": 3, "copies": True, "split": True}])
def test_codes_copies_and_cache(image, kind):
    for x, extended in ((image, False), (np.dstack([image, image[..., 0]]), True), (image[:1, :1], False)):
        out = begin(x.shape[1], x.shape[0], x.shape[2] == 4)
        out.put(0, 1)
        put_image(out, rgba(x).reshape(-1, 4), x.shape[1], main=True, **kind)
        assert (webp.decode(file_of(out, x.shape[1], x.shape[0], x.shape[2] == 4, extended)) == x).all()


def around(x, y, i):
    z = x.astype(int)
    right = z[y - 1, i + 1] if i + 1 < x.shape[1] else z[y, 0]
    return z[y, i - 1], z[y - 1, i], z[y - 1, i - 1], right


def guess(mode, left, top, corner, right):
    avg = lambda a, b: (a + b) // 2
    clamp = lambda v: np.clip(v, 0, 255)
    total = left + top - corner
    return {
        0: np.array([0, 0, 0, 255]), 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top), 8: avg(corner, top),
        9: avg(top, right), 10: avg(avg(left, corner), avg(top, right)), 11: left if abs(total - left).sum() < abs(total - top).sum() else top, 12: clamp(total),
        13: clamp(avg(left, top) + np.array([int(v / 2) for v in avg(left, top) - corner])),
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_prediction(image, mode):
    x = np.dstack([image, image[..., 1]])
    rest = x.astype(int)
    for y in range(x.shape[0]):
        for i in range(x.shape[1]):
            want = np.array([0, 0, 0, 255]) if not y and not i else x[y, i - 1].astype(int) if not y else x[y - 1, i].astype(int) if not i else guess(mode, *around(x, y, i))
            rest[y, i] = (rest[y, i] - want) % 256
    out = begin(37, 23, True)
    out.put(1, 1), out.put(webp.PREDICT, 2), out.put(1, 3)
    wide = (37 + 7) >> 3
    put_image(out, [(0, mode, 0, 0)] * (wide * ((23 + 7) >> 3)), wide)
    out.put(0, 1)
    put_image(out, rest.reshape(-1, 4), 37, main=True)
    assert (webp.decode(file_of(out, 37, 23, True)) == x).all()


def test_colours_and_green(image):
    signed = lambda v: v - 256 if v > 127 else v
    red_blue, green_blue, green_red = 20, 250, 130
    x = rgba(image).astype(int)
    rest = x.copy()
    g = np.vectorize(signed)(x[..., 1])
    rest[..., 0] = (x[..., 0] - (signed(green_red) * g >> 5)) % 256
    rest[..., 2] = (x[..., 2] - (signed(green_blue) * g >> 5) - (signed(red_blue) * np.vectorize(signed)(x[..., 0]) >> 5)) % 256
    plain = rest.copy()
    plain[..., 0] = (rest[..., 0] - rest[..., 1]) % 256
    plain[..., 2] = (rest[..., 2] - rest[..., 1]) % 256
    out = begin(37, 23, False)
    out.put(1, 1), out.put(webp.COLOUR, 2), out.put(2, 3)
    wide = (37 + 15) >> 4
    put_image(out, [(red_blue, green_blue, green_red, 0)] * (wide * 2), wide)
    out.put(1, 1), out.put(webp.GREEN, 2), out.put(0, 1)
    put_image(out, plain.reshape(-1, 4), 37, main=True)
    assert (webp.decode(file_of(out, 37, 23, False)) == image).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(n):
    rng = np.random.default_rng(n)
    table = rng.integers(0, 256, (n, 4))
    places = rng.integers(0, n, (9, 21))
    out = begin(21, 9, True)
    out.put(1, 1), out.put(webp.PALETTE, 2), out.put(n - 1, 8)
    put_image(out, np.diff(np.vstack([np.zeros((1, 4), int), table]), axis=0) % 256, n)
    out.put(0, 1)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    padded = np.pad(places, ((0, 0), (0, -21 % (1 << pack))))
    green = (padded.reshape(9, -1, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2)
    put_image(out, [(0, g, 0, 255) for g in green.ravel()], green.shape[1], main=True)
    assert (webp.decode(file_of(out, 21, 9, True)) == table[places]).all()


def test_what_is_not_read(spark, image):
    out = begin(37, 23, False)
    out.put(0, 1)
    put_image(out, rgba(image).reshape(-1, 4), 37, main=True, copies=True)
    good = file_of(out, 37, 23, False)
    lossy = good.replace(b"VP8L", b"VP8 ")
    for bad in (b"", b"RIFF\0\0\0\0WEBP", good[:60], good.replace(b"VP8L", b"ANIM"), lossy, good[:12] + b"VP8L\5\0\0\0\0\0\0\0\0"):
        with pytest.raises(webp.Unreadable):
            webp.decode(bad)
    rng = np.random.default_rng(0)
    for _ in range(100):
        torn = bytearray(good)
        for at in rng.integers(20, len(torn), 3):
            torn[at] = rng.integers(0, 256)
        try:
            webp.decode(bytes(torn), most=10_000)
        except webp.Unreadable:
            pass
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(lossy)), (3, None)], "doc_id long, content binary")
    got = {r["doc_id"]: r for r in webp.decoded(files).collect()}
    assert got[1]["pixels"] == image.tobytes() and got[2]["reason"] == "lossy WEBP" and got[3]["reason"] == "not a WEBP"

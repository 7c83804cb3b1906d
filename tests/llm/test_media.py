import hashlib
import random
import zlib

import numpy as np
import pytest

from inkveil.llm import flac, media


def payloads():
    rng = random.Random(2)
    out = [bytes(64), bytes(range(256)) * 40, rng.randbytes(5000), b"a" * 3000 + rng.randbytes(64), bytes([0, 255] * 3000), bytes(int(127 + 120 * np.sin(i / 9)) for i in range(7777)),
           b"x", b"ab", b"abc", bytes([5] * 1024) + b"q", b""]
    return out + [bytes(rng.choices(range(256), k=rng.randrange(1, 40))) for _ in range(100)]


def test_round_trip():
    data = payloads()
    coded = flac.encode(data)
    for p, s in zip(data, flac.decode(coded)):
        assert (s + 128).astype(np.uint8).tobytes() == p
    assert len(coded[5]) < 0.6 * len(data[5]) and len(coded[0]) < 90


def test_seeking_and_serial_reading():
    data = payloads()[5]
    (coded,) = flac.encode([data])
    assert (flac.read_samples(coded, 1500, 2000) + 128).astype(np.uint8).tobytes() == data[1500:3500]
    info = flac.metadata(coded)
    assert (flac._one_by_one(coded, info) + 128).astype(np.uint8).tobytes() == data
    assert [p[0] for p in info.points] == list(range(0, len(data), flac.BLOCK))


@pytest.mark.parametrize("at", [-1, -200, 30])
def test_damage_is_found(at):
    coded = bytearray(flac.encode([payloads()[5]])[0])
    coded[at] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(coded)])


def test_a_wrong_seek_table_is_passed_over():
    coded = bytearray(flac.encode([payloads()[5]])[0])
    coded[52] ^= 4
    assert (flac.decode([bytes(coded)])[0] + 128).astype(np.uint8).tobytes() == payloads()[5]


def bits(*fields):
    """(value, width) -> bytes, padded with zeros."""
    s = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)
    return int(s + "0" * (-len(s) % 8), 2).to_bytes((len(s) + 7) // 8, "big")


def rice(e, k):
    u = 2 * e if e >= 0 else -2 * e - 1
    return [(1, (u >> k) + 1), (u, k)] if k else [(1, u + 1)]


def stream(samples, depth, *body):
    head = bytes((0xFF, 0xF8, 0x70, {8: 2, 16: 8}[depth], 0)) + (len(samples) - 1).to_bytes(2, "big")
    frame = head + bytes((flac.crc8(head),)) + bits(*body)
    crc = 0
    for b in frame:
        crc = int(((crc << 8) & 0xFFFF) ^ int(flac._CRC16[(crc >> 8) ^ b]))
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (depth - 1) << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(flac.pcm(np.array(samples), depth)).digest()
    return b"fLaC" + bytes((0x80, 0, 0, 34)) + info + frame + crc.to_bytes(2, "big")


def test_foreign_streams():
    s = [3, 5, 8, 12, 17, 22, 30, 41]
    third = [s[i] - 3 * s[i - 1] + 3 * s[i - 2] - s[i - 3] for i in range(3, 8)]
    fixed3 = stream(s, 16, (0, 1), (11, 6), (0, 1), *[(v, 16) for v in s[:3]], (0, 2), (0, 4), (1, 4), *[f for e in third for f in rice(e, 1)])
    assert flac.decode([fixed3])[0].tolist() == s
    # Two partitions, the second one escaped to plain 7-bit numbers; long Rice parameters.
    first = [s[1] - s[0], s[2] - s[1], s[3] - s[2]]
    rest = [s[i] - s[i - 1] for i in range(4, 8)]
    parts = stream(s, 8, (0, 1), (9, 6), (0, 1), (s[0], 8), (1, 2), (1, 4), (2, 5), *[f for e in first for f in rice(e, 2)], (31, 5), (7, 5), *[(e, 7) for e in rest])
    assert flac.decode([parts])[0].tolist() == s
    wasted = [8, 16, -24, 32]
    shifted = stream(wasted, 16, (0, 1), (1, 6), (1, 1), (1, 3), *[(v >> 3, 13) for v in wasted])
    assert flac.decode([shifted])[0].tolist() == wasted
    lpc = [10, 12, 15]
    pred = (3 * lpc[1] - 1 * lpc[0]) >> 1
    linear = stream(lpc, 8, (0, 1), (33, 6), (0, 1), (10, 8), (12, 8), (3, 4), (1, 5), (3, 4), (-1, 4), (0, 2), (0, 4), (0, 4), *rice(15 - pred, 0))
    assert flac.decode([linear])[0].tolist() == lpc


def test_query(make, texts):
    rows = media.round_trip(make(texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        raw = (t or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    by = {t: tuple(r)[1:] for r, t in zip(rows, texts)}
    assert all(by[t] == tuple(r)[1:] for r, t in zip(rows, texts))
    assert media.round_trip(make(["x"]).where("false")).count() == 0


def test_pcm_blocks(spark, make, texts):
    stored = media.stored(make(texts[:3] + [texts[-1]]))
    rows = media.pcm_blocks(stored).orderBy("doc_id", "sample_offset").collect()
    joined = {}
    for r in rows:
        assert r["sample_offset"] == len(joined.setdefault(r["doc_id"], b""))
        joined[r["doc_id"]] += bytes(r["pcm"])
    payload = media.padded(texts[-1].encode())
    assert bytes((b + 128) & 0xFF for b in joined[3]) == payload
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"nope"))], "doc_id long, media binary")
    assert all(r["error"] for r in media.pcm_blocks(bad).collect())

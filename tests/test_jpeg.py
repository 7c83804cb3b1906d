"""JPEG and Exif."""

import struct

import numpy as np
import pytest
from inkveil.operators import jpeg
from inkveil.sources import exif, files
from test_pdf import photo


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-9, ((a.astype(float) - b) ** 2).mean()))


@pytest.mark.parametrize("shape", [(1, 1, 3), (7, 5, 3), (8, 8, 1), (64, 200, 3), (33, 17, 1), (300, 300, 3)])
def test_round_trip(shape):
    image = photo(*shape[:2])[..., : shape[2]]
    got = jpeg.decode(jpeg.encode(image))
    assert got.shape == image.shape and psnr(got, image) > 36


def test_extreme_blocks():
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 2, (64, 64, 3)) * 255, np.zeros((16, 16, 3)), np.full((9, 9, 3), 255), rng.integers(0, 256, (40, 40, 3))):
        image = image.astype(np.uint8)
        assert psnr(jpeg.decode(jpeg.encode(image, 1.0)), image) > 40
    assert (jpeg.decode(jpeg.encode(np.dstack([photo(8, 8), np.zeros((8, 8, 1), np.uint8)]))) == 0).all()  # what is seen through is black


def test_code_lengths():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    for counts in (fib, [1], [5, 5], list(range(1, 200))):
        got = jpeg.code_lengths(np.array(counts))
        assert set(got) == set(range(len(counts))) and max(got.values()) <= 16
        assert sum(2.0**-n for n in got.values()) < 1  # and the code of all ones is free
        code, size = jpeg.codes(got)
        words = {format(code[s], f"0{size[s]}b") for s in got}
        assert len(words) == len(counts) and not any(a != b and b.startswith(a) for a in words for b in words) and "1" * 16 not in words


def test_spark_reads_what_is_written(spark, tmp_path):
    image = photo(120, 170)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(image))
    r = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    got = np.frombuffer(r["data"], np.uint8).reshape(120, 170, 3)[..., ::-1]
    assert psnr(got, image) > 36 and np.abs(got.astype(int) - jpeg.decode(jpeg.encode(image))).max() <= 2


def test_reads_thinned_colours_and_restarts(spark, tmp_path):
    """Files of another writer, which thins colour; and restart marks, put in by hand."""
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(photo(75, 101)))
    io = spark._jvm.javax.imageio.ImageIO
    io.write(io.read(spark._jvm.java.io.File(str(tmp_path / "a.jpg"))), "jpg", spark._jvm.java.io.File(str(tmp_path / "b.jpg")))
    r = spark.read.format("image").load(str(tmp_path / "b.jpg")).select("image.*").first()
    got = jpeg.decode((tmp_path / "b.jpg").read_bytes())
    assert np.abs(np.frombuffer(r["data"], np.uint8).reshape(75, 101, 3)[..., ::-1].astype(int) - got).max() <= 6
    one = jpeg.encode(np.full((8, 8, 3), 90, np.uint8))
    head, scan = one[: one.index(b"\xff\xda")], one[one.index(b"\xff\xda") :]
    frame = head.index(b"\xff\xc0")
    wide = head[: frame + 7] + struct.pack(">H", 24) + head[frame + 9 :] + b"\xff\xdd\0\4\0\1"
    start, body = scan[:14], scan[14:-2]
    restarted = wide + start + body + b"\xff\xd0" + body + b"\xff\xd1" + body + b"\xff\xd9"
    assert (jpeg.decode(restarted) == 90).all() and jpeg.decode(restarted).shape == (8, 24, 3)


def test_what_is_not_read():
    good = jpeg.encode(photo(40, 40))
    for bad in (b"", b"GIF89a", good[:100], good[:-400], good.replace(b"\xff\xc0", b"\xff\xc2"), good.replace(b"\xff\xc4", b"\xff\xfe", 1)):
        with pytest.raises(jpeg.Unreadable):
            jpeg.decode(bad)
    rng = np.random.default_rng(0)
    for _ in range(200):
        torn = bytearray(good)
        for at in rng.integers(0, len(torn), 4):
            torn[at] = rng.integers(0, 256)
        try:
            jpeg.decode(bytes(torn), most=10_000)
        except jpeg.Unreadable:
            pass


def noted(image, turn, order="little", entries=(), kind=3, cut=None):
    """A JPEG whose Exif directory has a turn."""
    e = "<" if order == "little" else ">"
    all_ = [*entries, (0x0112, kind, 1, turn)]
    tiff = (b"II" if order == "little" else b"MM") + struct.pack(e + "HI", 42, 8) + struct.pack(e + "H", len(all_))
    tiff += b"".join(struct.pack(e + "HHIHH", *x, 0) for x in all_) + b"\0\0\0\0"
    body = b"Exif\0\0" + tiff[:cut]
    data = jpeg.encode(image)
    return data[:2] + struct.pack(">BBH", 0xFF, 0xE1, len(body) + 2) + body + data[2:]


@pytest.mark.parametrize("order", ["little", "big"])
def test_orientations(order):
    image = photo(16, 24)
    for turn in range(1, 9):
        assert exif.orientation(noted(image, turn, order, [(0x010F, 3, 1, 9), (0x0110, 4, 1, 0)])) == turn


def test_broken_directories_are_upright():
    image = photo(16, 16)
    for data in (noted(image, 9), noted(image, 0), noted(image, 6, kind=4), noted(image, 6, cut=9), noted(image, 6, cut=12), noted(image, 6, cut=1), jpeg.encode(image), b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\0\x08Exif\0\0"):
        assert exif.orientation(data) == 1


def test_eight_turns():
    """A pixel at row r and column c of the file is seen where the standard says."""
    seen = {1: (0, 0), 2: (0, -1), 3: (-1, -1), 4: (-1, 0), 5: (0, 0), 6: (0, -1), 7: (-1, -1), 8: (-1, 0)}  # where its first pixel goes
    along = {1: (0, 1), 2: (0, -1), 3: (0, -1), 4: (0, 1), 5: (1, 0), 6: (1, 0), 7: (-1, 0), 8: (-1, 0)}  # and which way its first row runs
    image = np.arange(12).reshape(3, 4)
    for turn in range(1, 9):
        got = exif.upright(image, turn)
        r, c = (v % n for v, n in zip(seen[turn], got.shape))
        row = [got[r + k * along[turn][0], c + k * along[turn][1]] for k in range(4)]
        assert row == [0, 1, 2, 3], turn


def test_folder_of_photographs(spark, tmp_path):
    image = photo(40, 60)
    for turn in range(1, 9):
        (tmp_path / f"t{turn}.jpg").write_bytes(noted(exif.upright(image, {6: 8, 8: 6}.get(turn, turn)), turn))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    for few in (True, False):
        rows = files.read_images(spark, str(tmp_path)).collect() if few else None
        for r in rows or ():
            assert (r["full_w"], r["full_h"]) == (60, 40), r["source_name"]
            got = np.frombuffer(r["pixels_bgr"], np.uint8).reshape(40, 60, 3)[..., ::-1]
            assert psnr(got, image) > 33
        if rows:
            assert len(rows) == 8
    base = spark.read.format("image").load(str(tmp_path / "t6.jpg")).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").withColumnRenamed("nChannels", "channels")
    got = exif.set_upright(base, exif.turned(spark, str(tmp_path)), few=False).first()
    assert (got["width"], got["height"]) == (60, 40)

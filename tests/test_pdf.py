"""Reading PDF files and drawing their pages."""

import zlib

import numpy as np
import pytest
from inkveil.operators import fill, jpeg, render
from inkveil.sinks import export
from inkveil.sources import files, pdf


def photo(height, width, seed=0):
    y, x = np.mgrid[:height, :width]
    grain = np.random.default_rng(seed).normal(0, 3, (height, width, 3))
    base = np.stack([120 + 90 * np.sin(x / 40 + seed), 120 + 90 * np.cos(y / 30), 40 + 150 * (x + y) / (height + width)], axis=2)
    return np.clip(base + grain, 0, 255).astype(np.uint8)


def made(objects, trailer="/Root 1 0 R", streamed=False):
    """A file from the bodies of its objects 1, 2, ...; streamed: all but streams in an object stream, with a table stream."""
    out, at, inner = bytearray(b"%PDF-1.5\n"), {}, []
    for n, body in enumerate(objects, 1):
        if streamed and b"stream" not in body:
            inner.append((n, body))
            continue
        at[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    size = len(objects) + 1
    if not streamed:
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % at[n][1] for n in range(1, size))
        return bytes(out + b"trailer << /Size %d %s >>\nstartxref\n%d\n%%%%EOF" % (size, trailer.encode(), start))
    bodies, index = b"", []
    for k, (n, body) in enumerate(inner):
        index.append(b"%d %d" % (n, len(bodies)))
        bodies += body + b" "
        at[n] = (2, size, k)
    head = b" ".join(index) + b" "
    packed = zlib.compress(head + bodies)
    at[size] = (1, len(out), 0)
    out += b"%d 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n" % (size, len(inner), len(head), len(packed)) + packed + b"\nendstream endobj\n"
    at[size + 1] = (1, len(out), 0)
    rows = b"\0\0\0\0\0\0" + b"".join(bytes([at[n][0]]) + at[n][1].to_bytes(4, "big") + bytes([at[n][2]]) for n in range(1, size + 2))
    lines = np.frombuffer(rows, np.uint8).reshape(-1, 6)
    up = np.diff(np.vstack([np.zeros((1, 6), np.uint8), lines]).astype(int), axis=0).astype(np.uint8)  # PNG's "up"
    packed = zlib.compress(np.hstack([np.full((len(up), 1), 2, np.uint8), up]).tobytes())
    start = len(out)
    out += b"%d 0 obj << /Type /XRef /Size %d /W [1 4 1] %s /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length %d >> stream\n" % (size + 1, size + 2, trailer.encode(), len(packed))
    return bytes(out + packed + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % start)


def stream(data, head=b""):
    return b"<< %s /Length %d >> stream\n" % (head, len(data)) + data + b"\nendstream"


def one_page(contents, resources=b"", box=b"0 0 240 120", more=b"", objects=(), **kind):
    page = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R %s >>" % more
    return made([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [%s] /Resources << %s >> >>" % (box, resources), page, stream(contents), *objects], **kind)


def drawn(data, edge=240):
    own, pages, reason = pdf.opened(data)
    assert reason is None
    return render.draw(own, pages[0], edge)


@pytest.mark.parametrize("streamed", [False, True])
def test_image_pages_are_drawn_pixel_for_pixel(streamed):
    image = photo(1200, 2400)
    up = np.diff(np.vstack([np.zeros((1, 2400, 3), np.uint8), image]).astype(int), axis=0).astype(np.uint8).reshape(1200, -1)
    packed = zlib.compress(np.hstack([np.full((1200, 1), 2, np.uint8), up]).tobytes())
    x = stream(packed, b"/Subtype /Image /Width 2400 /Height 1200 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors 3 /Columns 2400 >>")
    pixels, missed = drawn(one_page(b"q 240 0 0 120 0 0 cm /I Do Q", b"/XObject << /I 5 0 R >>", objects=[x], streamed=streamed), 2400)
    assert missed == [] and (pixels == image).all()


def test_round_trip_of_written_files():
    images = [photo(300, 400), photo(400, 300, 1)]
    data = export.build_pdf([(jpeg.encode(i), i.shape[1], i.shape[0]) for i in images])
    own, pages, reason = pdf.opened(data)
    assert reason is None and len(pages) == 2
    for page, image in zip(pages, images):
        pixels, missed = render.draw(own, page, 400)
        assert missed == [] and pixels.shape == image.shape
        assert np.abs(pixels.astype(int) - image).mean() < 3


def test_paths_clips_forms_and_states():
    form = stream(b"0 0 1 rg 0 0 500 500 re f", b"/Subtype /Form /BBox [0 0 10 10] /Matrix [1 0 0 1 100 50]")
    contents = b"q 1 0 0 rg 10 10 20 30 re f Q 50 10 40 40 re 60 20 20 20 re f* q 200 0 m 240 0 l 240 40 l h W n 0 1 0 rg 0 0 240 120 re f Q /F Do 0.5 g 150 100 m 170 100 l 170 110 l 150 110 l b"
    pixels, missed = drawn(one_page(contents, b"/XObject << /F 5 0 R >>", objects=[form]))
    assert missed == []
    assert (pixels[80:110, 10:30] == (255, 0, 0)).all() and (pixels[75, 5:9] == 255).all()
    assert (pixels[70:110, 50:60] == 0).all() and (pixels[80:100, 60:80] == 255).all()
    assert tuple(pixels[115, 238]) == (0, 255, 0) and (pixels[85, 205] == 255).all()
    assert (pixels[60:70, 100:110] == (0, 0, 255)).all() and (pixels[60:70, 111:115] == 255).all()
    assert (pixels[15, 155:165] == 128).all()


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_pages_are_turned(turn):
    pixels, _ = drawn(one_page(b"1 0 0 rg 0 0 24 12 re f", more=b"/Rotate %d" % turn))
    upright = np.full((120, 240, 3), 255)
    upright[108:, :24] = (255, 0, 0)
    assert (pixels == np.rot90(upright, -turn // 90)).all()


def test_crop_boxes_and_inheritance():
    pixels, _ = drawn(one_page(b"0 g 100 50 20 10 re f", more=b"/CropBox [100 50 220 110]"), 120)
    assert pixels.shape == (60, 120, 3) and (pixels[50:, :20] == 0).all() and pixels.sum() == (60 * 120 - 200) * 765


@pytest.mark.parametrize(
    "head, data, want",
    [
        (b"/ColorSpace /DeviceGray /BitsPerComponent 1", b"\x80\x40", [[255, 0], [0, 255]]),
        (b"/ColorSpace /DeviceGray /BitsPerComponent 1 /Decode [1 0]", b"\x80\x40", [[0, 255], [255, 0]]),
        (b"/ColorSpace [/Indexed /DeviceRGB 1 <000000FFFFFF>] /BitsPerComponent 4", b"\x01\x10", [[0, 255], [255, 0]]),
        (b"/ColorSpace /DeviceGray /BitsPerComponent 16", b"\x80\0\0\0\0\0\xff\xff", [[128, 0], [0, 255]]),
        (b"/ColorSpace /DeviceCMYK /BitsPerComponent 8", b"\0\0\0\0" + b"\0\0\0\xff" * 2 + b"\0\0\0\x80", [[255, 0], [0, 127]]),
        (b"/ImageMask true", b"\x80\x40", [[255, 0], [0, 255]]),
        (b"/ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /ASCIIHexDecode", b"FF 00 00 ff>", [[255, 0], [0, 255]]),
        (b"/ColorSpace /DeviceGray /BitsPerComponent 8 /Filter [/ASCII85Decode /RunLengthDecode]", b"!<E3%!!*'\"~>", None),
    ],
)
def test_kinds_of_images(head, data, want):
    x = stream(data, b"/Subtype /Image /Width 2 /Height 2 " + head)
    pixels, missed = drawn(one_page(b"q 2 0 0 2 0 0 cm /I Do Q", b"/XObject << /I 5 0 R >>", b"0 0 2 2", objects=[x]), 2)
    assert missed == []
    if want:
        assert pixels[..., 0].tolist() == want and (pixels == pixels[..., :1]).all()


def test_inline_images_and_turned_ones():
    pixels, missed = drawn(one_page(b"q 0 20 -20 0 20 0 cm BI /W 2 /H 1 /CS /G /BPC 8 ID \x00\x80 EI Q", box=b"0 0 20 20"), 20)
    assert missed == [] and (pixels[:10] == 128).all() and (pixels[10:] == 0).all()


def test_what_is_not_drawn_is_named():
    x = stream(b"?", b"/Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /JPXDecode")
    _, missed = drawn(one_page(b"BT /F 12 Tf (secret) Tj ET /S sh q /I Do Q xyz 1 cm", b"/XObject << /I 5 0 R >>", objects=[x]))
    assert missed == ["image: codec JPXDecode", "operator xyz", "shading", "text", "wrong use of cm"]


def test_protected_and_damaged_files():
    good = one_page(b"0 g 0 0 9 9 re f")
    assert pdf.opened(one_page(b"", trailer="/Root 1 0 R /Encrypt << /Filter /Standard >>"))[2] == pdf.PROTECTED
    for bad in (b"", b"%PDF-1.4", b"no pdf at all", good[:60], b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj trailer << /Root 1 0 R >>"):
        assert pdf.opened(bad)[2] == pdf.DAMAGED
    # A table that is wrong or gone does not matter: objects are found by their marks.
    for torn in (good[: good.rindex(b"xref\n0")], good.replace(b"startxref\n", b"startxref\n9"), good.replace(b"0000000009", b"0000000010")):
        assert drawn(torn)[0][119, 0].tolist() == [0, 0, 0]


def test_files_of_random_bytes_never_raise():
    rng = np.random.default_rng(2)
    good = bytearray(one_page(b"q 1 0 0 rg 0 0 9 9 re f BI /W 2 /H 1 ID ab EI Q", streamed=True))
    for _ in range(150):
        bad = bytearray(good)
        for at in rng.integers(0, len(bad), 6):
            bad[at] = rng.integers(0, 256)
        own, pages, _ = pdf.opened(bytes(bad))
        for page in pages[:2]:
            if 0 < max(page.box[2] - page.box[0], page.box[3] - page.box[1]) < 1e6:
                render.draw(own, page, 50)


def test_folder_of_files(spark, tmp_path):
    image = photo(60, 80)
    (tmp_path / "a.pdf").write_bytes(export.build_pdf([(jpeg.encode(image), 80, 60)] * 3))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 torn")
    (tmp_path / "c.pdf").write_bytes(one_page(b"", trailer="/Root 1 0 R /Encrypt 9 0 R"))
    (tmp_path / "em pt+y%é.pdf").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"x")
    rows = sorted(pdf.read_pdfs(spark, str(tmp_path)).drop("pixels").collect(), key=lambda r: (r["source_name"], r["page_no"] or 0))
    assert [(r["source_name"], r["page_no"], r["page_count"], r["width"], r["height"], r["reason"]) for r in rows[:3]] == [("a.pdf", i, 3, 2400, 1800, None) for i in range(3)]
    assert rows[0]["work_w"] == 2000 and rows[0]["scale_to_full"] == 1.2
    assert [(r["source_name"], r["page_no"], r["reason"]) for r in rows[3:]] == [("b.pdf", None, pdf.DAMAGED), ("c.pdf", None, pdf.PROTECTED)]
    accepted, rejected = files.read_files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["reject_reason"] for r in rejected.select("path", "reject_reason").collect()} == {
        "em pt+y%é.pdf": "There is nothing in that file.",
        "note.txt": "Only JPG, PNG, WEBP and PDF files can be read.",
    }
    docs = spark.createDataFrame([(1, (tmp_path / "a.pdf").read_bytes()), (2, None)], "doc_id long, content binary")
    images = sorted(pdf.page_images(docs).collect())
    assert [(r["doc_id"], r["page_no"], r["name"], r["width"], r["height"]) for r in images[:3]] == [(1, i, "Im0", 80, 60) for i in range(3)]
    assert images[0]["jpeg"] == jpeg.encode(image) and images[3]["reason"] == pdf.DAMAGED


def test_coverage_against_many_samples():
    rng = np.random.default_rng(4)
    for even_odd in (False, True):
        path = rng.uniform(-5, 35, (7, 2))
        rows, cols, cover = fill.polygons([path], 30, 25, even_odd)
        got = np.zeros((25, 30))
        got[rows, cols] = cover
        n = 16
        y, x = (np.mgrid[: 25 * n, : 30 * n] + 0.5) / n
        wound = np.zeros(y.shape, int)
        for (x0, y0), (x1, y1) in zip(path, np.roll(path, -1, axis=0)):
            hit = ((y0 <= y) != (y1 <= y)) & (x > x0 + (y - y0) * (x1 - x0) / (y1 - y0))
            wound += np.where(hit, 1 if y1 > y0 else -1, 0)
        inside = wound % 2 == 1 if even_odd else wound != 0
        want = inside.reshape(25, n, 30, n).mean(axis=(1, 3))
        assert np.abs(got - want).max() < 0.2 and np.abs(got - want).mean() < 0.01

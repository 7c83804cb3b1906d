"""Stamps, whole files and the folder they are written to."""

import os

import numpy as np
import pytest
from inkveil.functions import geometry as G
from inkveil.operators import jpeg, raster, stamp
from inkveil.plans import redact
from inkveil.sinks import export, folder
from inkveil.sources import pdf
from pyspark.sql import functions as F
from test_jpeg import psnr
from test_pdf import photo


def test_every_letter_is_drawn_and_differs():
    seen = {}
    for letter in map(chr, range(33, 127)):
        field = stamp.distances(stamp.segments(letter, 60) + 40, 80, 80, 9)
        assert (field < 3).any(), letter
        seen.setdefault(field.tobytes(), []).append(letter)
    unknown = [v for v in seen.values() if len(v) > 1]
    assert unknown in ([], [["{", "}"]])  # letters without strokes are a box
    assert len(stamp.segments("", 20)) == 0 and len(stamp.segments("क", 20)) == 4


def test_coverage_against_many_samples():
    strokes = stamp.segments("Ag·8", 22) @ np.kron(np.eye(2), [[0.94, -0.34], [0.34, 0.94]]) + 35
    n, half = 8, 2.0
    field = stamp.distances(strokes, 70, 70, 6)
    fine = stamp.distances(strokes * n, 70 * n, 70 * n, 6 * n) <= half * n
    want = fine.reshape(70, n, 70, n).mean(axis=(1, 3))
    got = np.clip(half + 0.5 - field, 0, 1)
    off = np.abs(got - want)[want > 0]
    assert off.mean() < 0.03 and np.quantile(off, 0.98) < 0.12 and off.max() < 0.5  # the last in notches where strokes meet


def test_tiles_stand_where_the_positions_say(spark):
    pages = spark.createDataFrame([(1, 0, 900, 500, 10)], "doc_id long, page_no int, width int, height int, n int")
    size, line, column, _ = (spark.range(1).select(*G.stamp_layout(F.lit(900), F.lit(500))).first())
    wide = 10 * stamp.ADVANCE * size
    want = {(round(r["x"], 6), round(r["y"], 6)) for r in export.stamp_positions(pages.withColumn("text_width", F.lit(wide))).collect()}
    assert {(round(x, 6), round(y, 6)) for x, y in stamp.centres(900, 500, wide, line, column)} == want
    assert pages.select(stamp.text_width(F.lit("0123456789"), F.lit(float(size)))).first()[0] == pytest.approx(wide)


def test_stamp_darkens_paper_and_lightens_ink(spark):
    blank, dark = np.full((500, 900, 3), 255, np.uint8), np.zeros((500, 900, 4), np.uint8)
    rows = [(1, 0, 900, 500, bytearray(blank.tobytes()), "For KYC only · 01 Jan 2030"), (2, 0, 900, 500, bytearray(dark.tobytes()), "x"), (3, 0, 900, 500, bytearray(blank.tobytes()), None), (4, 0, 900, 500, bytearray(blank.tobytes()), "")]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, width int, height int, pixels binary, said string")
    got = {r["doc_id"]: np.frombuffer(r["pixels"], np.uint8).reshape(500, 900, -1) for r in stamp.stamped(pages, F.col("said")).collect()}
    ink = 255 + (np.array(stamp.INK) - 255) * stamp.INK_SHARE
    assert np.abs(got[1].reshape(-1, 3).min(axis=0) - ink).max() <= 1 and 0.02 < (got[1] < 250).mean() < 0.2
    assert got[2][..., :3].max() in (127, 128) and (got[2][..., 3] == 0).all()
    assert (got[3] == 255).all() and (got[4] == 255).all()
    quarters = [got[1][r : r + 250, c : c + 450] for r in (0, 250) for c in (0, 450)]
    assert all((q < 250).any() for q in quarters)


@pytest.fixture
def pages(spark):
    images = {(1, 0): photo(120, 160), (1, 1): photo(120, 160, 1), (2, 0): photo(90, 100, 2), (3, 0): photo(90, 100, 3)}
    names = {1: ("My scan.PDF", "application/pdf"), 2: ("a.png", "image/png"), 3: ("a.jpg", "image/jpeg")}
    rows = [(d, p, x.shape[1], x.shape[0], bytearray(x.tobytes()), 2.0, *names[d], "t") for (d, p), x in images.items()]
    return images, spark.createDataFrame(rows, "doc_id long, page_no int, width int, height int, pixels binary, scale_to_full double, source_name string, source_type string, mark string")


@pytest.fixture
def boxes(spark):
    rows = [(1, 1, 10.0, 10.0, 30.0, 20.0, "block", True, 1, 0), (2, 0, 0.0, 0.0, 10.0, 10.0, "blur", True, 1, 0), (3, 0, 0.0, 0.0, 10.0, 10.0, "block", False, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, page_no int, x double, y double, w double, h double, style string, enabled boolean, priority int, seq long")


def test_from_pages_to_files(spark, pages, boxes, tmp_path):
    images, table = pages
    place = str(tmp_path / "out")
    folder.save(redact.image_files(table, boxes), place)
    assert sorted(os.listdir(place)) == ["a-redacted.jpg", "a-redacted.png", "my-scan-redacted-1-0.jpg", "my-scan-redacted-1-1.jpg"]
    got = jpeg.decode(open(f"{place}/my-scan-redacted-1-1.jpg", "rb").read())
    assert np.abs(got[28:52, 28:72].astype(int) - raster.REDACT).max() <= 12 and psnr(got[70:], images[1, 1][70:]) > 34
    assert psnr(jpeg.decode(open(f"{place}/a-redacted.jpg", "rb").read()), images[3, 0]) > 34
    r = spark.read.format("image").load(f"{place}/a-redacted.png").select("image.*").first()
    shown = np.frombuffer(r["data"], np.uint8).reshape(90, 100, 3)[..., ::-1]
    assert (shown[25:] == images[2, 0][25:]).all() and (shown[:20, :20] != images[2, 0][:20, :20]).any()


def test_from_pages_to_pdf_and_back(spark, pages, boxes, tmp_path):
    images, table = pages
    folder.save(redact.pdf_files(table, boxes, F.lit("For tests only"), ()), str(tmp_path / "pdf"))
    assert sorted(os.listdir(tmp_path / "pdf")) == ["a-redacted-2.pdf", "a-redacted-3.pdf", "my-scan-redacted.pdf"]
    back = pdf.read_pdfs(spark, str(tmp_path / "pdf")).where("source_name = 'my-scan-redacted.pdf'").orderBy("page_no").collect()
    assert [(r["page_no"], r["width"], r["height"], r["not_drawn"]) for r in back] == [(0, 2400, 1800, []), (1, 2400, 1800, [])]
    covered = np.frombuffer(back[1]["pixels"], np.uint8).reshape(1800, 2400, 3)[330:870, 330:1170]
    assert covered.mean() < 120  # the block, with a stamp over it
    assert redact.rendered(table, boxes, F.col("mark"), ("mark",)).columns == ["doc_id", "page_no", "width", "height", "pixels", "mark"]


def test_many_regions_without_broadcast(spark, pages, boxes, monkeypatch):
    _, table = pages
    some = {tuple(r) for r in redact.redact(table, boxes).select("doc_id", "page_no", F.sha2("pixels", 256)).collect()}
    monkeypatch.setattr(raster, "BROADCAST", 0)
    assert {tuple(r) for r in redact.redact(table, boxes).select("doc_id", "page_no", F.sha2("pixels", 256)).collect()} == some


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    place = str(tmp_path / "out")
    good = spark.createDataFrame([(f"f{i}.bin", bytearray([i])) for i in range(20)], "name string, content binary")
    folder.save(good, place)
    assert len(os.listdir(place)) == 20 and open(f"{place}/f7.bin", "rb").read() == b"\7"
    more = spark.createDataFrame([(f"g{i}.bin" if i else "../evil", bytearray([i])) for i in range(20)], "name string, content binary").repartition(4)
    for bad in (more, good.select(F.lit("same.bin").alias("name"), "content").repartition(5)):
        with pytest.raises(Exception):
            folder.save(bad, place)
        assert sorted(os.listdir(place)) == sorted(f"f{i}.bin" for i in range(20))


def test_names_are_told_apart(spark, monkeypatch):
    rows = [(1, "a.jpg"), (2, "a.jpg"), (3, "b"), (4, "b"), (5, "c.tar.gz")]
    table = spark.createDataFrame(rows, "doc_id long, name string")
    want = {1: "a-1.jpg", 2: "a-2.jpg", 3: "b-3", 4: "b-4", 5: "c.tar.gz"}
    assert {r["doc_id"]: r["name"] for r in folder.told_apart(table, "doc_id").collect()} == want
    monkeypatch.setattr(folder, "BROADCAST", 0)
    assert {r["doc_id"]: r["name"] for r in folder.told_apart(table, "doc_id").collect()} == want

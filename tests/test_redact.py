import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil import schema
from inkveil.operators import raster
from inkveil.plans import redact
from inkveil.sources import recognise


def test_sizes():
    page = np.random.default_rng(0).integers(0, 255, (60, 80, 3)).astype(np.uint8)
    small = raster.resize(page, 40, 30)
    assert small.shape == (30, 40, 3) and abs(float(small.mean()) - float(page.mean())) < 1
    assert np.abs(small[0, 0].astype(float) - page[:2, :2].reshape(4, 3).mean(axis=0)).max() <= 1
    assert (raster.resize(np.full((5, 7), 90, np.uint8), 70, 50) == 90).all()
    grown, scale = raster.prepare_for_ocr(page)
    assert scale == 2.5 and grown.shape == (150, 200)
    assert raster.shrink(page)[1] == 1 and raster.shrink(np.zeros((1800, 10), np.uint8))[0].shape == (900, 5)
    faint = np.linspace(100, 140, 100).astype(np.uint8).reshape(10, 10)
    assert raster.lifted(page) is None and raster.lifted(faint).max() == 255


def test_deadline():
    assert recognise.with_deadline(lambda: 5, 1) == 5
    with pytest.raises(TimeoutError):
        recognise.with_deadline(lambda: time.sleep(2), 0.05)
    with pytest.raises(ZeroDivisionError):
        recognise.with_deadline(lambda: 1 / 0, 1)
    assert recognise.with_deadline(lambda: [("ü", 1.0)] * 100_000, 5)[-1] == ("ü", 1.0)
    with pytest.raises(RuntimeError):
        recognise.with_deadline(lambda: os._exit(3), 5)
    with pytest.raises(RuntimeError):
        recognise.with_deadline(lambda: (x for x in "no pickle"), 5)


def test_overdue_work_is_ended(tmp_path):
    def late():
        time.sleep(0.6)
        (tmp_path / "done").touch()

    with pytest.raises(TimeoutError):
        recognise.with_deadline(late, 0.1)
    time.sleep(1)
    assert not (tmp_path / "done").exists()


def pages(spark, n=3):
    blank = bytearray(np.full((200, 400, 3), 255, np.uint8).tobytes())
    rows = [(i, 0, 400, 200, blank if i < 2 else bytearray(b"?"), 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, page_no int, width int, height int, pixels binary, scale_to_full double")


def test_pages_to_redacted_copies(spark):
    def loaded():
        def read(page):
            assert page.shape == (500, 1000)
            return [("ABCPE1234F", 90.0, 100.0, 100.0, 450.0, 100.0), (" ", 1.0, 0.0, 0.0, 1.0, 1.0)]

        return read

    words, status = recognise.recognise(pages(spark), loaded)
    assert {r["doc_id"]: r["ocr_status"] for r in status.collect()} == {0: "ready", 1: "ready", 2: "unavailable"}
    (w, _) = words.orderBy("doc_id").collect()
    assert (w["text"], w["x"], w["y"], w["w"], w["h"]) == ("ABCPE1234F", 40.0, 40.0, 180.0, 40.0)
    whole = pages(spark, 2)
    boxes = redact.find_boxes(words, whole, schema.presets(spark), "Hotel check-in")
    done = {r["doc_id"]: np.frombuffer(r["pixels"], np.uint8).reshape(200, 400, 3) for r in redact.redact(whole, boxes.where("doc_id = 0")).collect()}
    assert (done[0][50:70, 50:200] == raster.REDACT).all() and (done[1] == 255).all()
    assert redact.redacted_images(whole, boxes).where(F.length("png") > 60).count() == 2

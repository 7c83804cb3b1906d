"""Running a pluggable recogniser over pages: prepared rasters in, words and a status out."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import raster

DEADLINE = 60.0
_fork = multiprocessing.get_context("fork")
READY, UNAVAILABLE = "ready", "unavailable"
_WORD = "struct<text:string,confidence:double,x:double,y:double,w:double,h:double>"


def with_deadline(work: Callable, seconds: float):
    """work()'s result; TimeoutError if it takes longer.  Its own errors pass through.

    The work runs in a child process, which has what this one has loaded and is ended when it is
    overdue, so a page that hangs holds neither a processor nor memory.
    """
    mine, theirs = _fork.Pipe(duplex=False)

    def run() -> None:
        try:
            answer = (True, work())
        except BaseException as e:  # handed to the caller below
            answer = (False, e)
        try:
            theirs.send(answer)
        except Exception as e:  # what can't be sent
            theirs.send((False, RuntimeError(f"{type(e).__name__}: {e}")))

    child = _fork.Process(target=run, daemon=True)
    child.start()
    theirs.close()
    try:
        if not mine.poll(seconds):
            raise TimeoutError(f"no answer within {seconds} s")
        good, value = mine.recv()
    except EOFError:
        raise RuntimeError("the recogniser died") from None
    finally:
        mine.close()
        if child.is_alive():
            child.join(0.2)
        if child.is_alive():
            child.kill()
        child.join()
    if not good:
        raise value
    return value


def recognise(pages: DataFrame, load: Callable[[], Callable], deadline: float = DEADLINE) -> tuple[DataFrame, DataFrame]:
    """(words, statuses) of pages (doc_id, page_no, width, height, pixels).

    load() is called once a Python worker and gives read(raster) -> [(text, confidence, x, y, w, h)]
    in the coordinates of the raster it got.  A page that fails or takes too long has no words
    and the status ``unavailable``; it never fails the job.
    """

    def run(parts: Iterator[pd.DataFrame]):
        read = load()
        for part in parts:
            words, status = [], []
            for r in part.itertuples():
                try:
                    page, scale = raster.prepare_for_ocr(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, -1))
                    found = with_deadline(lambda: read(page), deadline)
                    words.append([dict(zip(("text", "confidence", "x", "y", "w", "h"), (t, c, *(v / scale for v in box)))) for t, c, *box in found if t.strip()])
                    status.append(READY)
                except Exception:  # degrade to no words: the review gate shows the page
                    words.append([])
                    status.append(UNAVAILABLE)
            yield pd.DataFrame({"doc_id": part["doc_id"], "page_no": part["page_no"], "words": words, "ocr_status": status})

    read = pages.select("doc_id", "page_no", "width", "height", "pixels").mapInPandas(run, f"doc_id long, page_no int, words array<{_WORD}>, ocr_status string")
    words = read.select("doc_id", "page_no", F.posexplode("words").alias("word_idx", "word")).select("doc_id", "page_no", F.col("word_idx").cast("long").alias("word_idx"), "word.*")
    return words, read.select("doc_id", "page_no", "ocr_status")

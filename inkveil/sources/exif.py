"""Which way up a photograph is: the orientation that its file notes, and the turn that mends it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import jpeg

ORIENTATION = 0x0112
#: Rows of a path and a number that are sent to every task at most; more are joined by shuffle.
BROADCAST = 500_000


def orientation(data: bytes) -> int:
    """1 to 8 as a JPEG's Exif directory says; 1 where there is none or it is broken."""
    try:
        for mark, body in jpeg.segments(data):
            if mark == 0xE1 and body[:6] == b"Exif\0\0":
                return _from_directory(body[6:])
            if mark == 0xDA:
                break
    except jpeg.Unreadable:
        pass
    return 1


def _from_directory(tiff: bytes) -> int:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return 1
    number = lambda at, n: int.from_bytes(tiff[at : at + n], order) if at + n <= len(tiff) else -1
    at = number(4, 4)
    if number(2, 2) != 42 or at < 8:
        return 1
    for entry in range(at + 2, at + 2 + 12 * max(0, number(at, 2)), 12):
        if number(entry, 2) == ORIENTATION and number(entry + 2, 2) == 3 and number(entry + 4, 4) == 1:
            value = number(entry + 8, 2)
            return value if 1 <= value <= 8 else 1
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Pixels as they are to be seen: mirrored, turned, or both."""
    if turn in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def turned(spark: SparkSession, folder: str) -> DataFrame:
    """origin, turn of the photographs of a folder that do not stand upright."""
    schema = pa.schema([("origin", pa.string()), ("turn", pa.int32())])

    def run(batches):
        for b in batches:
            found = [(p, orientation(c.as_py() or b"")) for p, c in zip(b.column("path").to_pylist(), b.column("content"))]
            found = [(p, t) for p, t in found if t > 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ([], []), schema.types)], schema=schema)

    photos = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(folder).select("path", "content")
    return photos.mapInArrow(run, "origin string, turn int")


def set_upright(images: DataFrame, turns: DataFrame, few: bool) -> DataFrame:
    """images (origin, width, height, channels, data and others) with those of turns turned; few: turns may be broadcast.

    Only turned rows change, but all pass a Python worker, so that images are decoded once and rasters never shuffled.
    """
    turns = turns.select(F.col("origin").alias("turned_origin"), "turn")
    same = F.regexp_replace("origin", "^([a-z0-9]+):///", "$1:/") == F.col("turned_origin")  # one reader writes it with three slashes
    met = images.join(F.broadcast(turns) if few else turns, same, "left").drop("turned_origin")
    names = ["width", "height", "data"]

    def run(batches):
        for b in batches:
            values = {n: b.column(n).to_pylist() for n in (*names, "channels", "turn")}
            for i, t in enumerate(values["turn"]):
                if t:
                    x = upright(np.frombuffer(values["data"][i], np.uint8).reshape(values["height"][i], values["width"][i], values["channels"][i]), t)
                    values["data"][i], values["height"][i], values["width"][i] = x.tobytes(), *x.shape[:2]
            yield pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in names else b.column(f.name) for f in b.schema], schema=b.schema)

    return met.mapInArrow(run, met.schema).drop("turn")

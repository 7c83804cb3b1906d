"""Photographs: the windows a face model is run on, and what becomes of its answers.

The model itself is a pluggable input: its raw detections are a table (face_raw).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G
from .layout import PAGE
from .policy import first_level, keep_new


def search_size(pages: DataFrame) -> DataFrame:
    """pages with search_w, search_h and search_scale: long edge 900 at most."""
    scale = F.least(F.lit(1.0), F.lit(float(G.SEARCH_EDGE)) / F.greatest("width", "height"))
    out = pages.withColumn("search_scale", scale)
    return out.withColumn("search_w", G.half_up(F.col("width") * F.col("search_scale")).cast("int")).withColumn("search_h", G.half_up(F.col("height") * F.col("search_scale")).cast("int"))


def windows(pages: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """One row for each frame: 1, 9 and 49 of them a page, coarse to fine, half a window apart, row by row."""
    levels = F.explode(F.array(*map(F.lit, G.FACE_LEVELS))).alias("fraction")
    p = pages.select(*PAGE, F.col(width).cast("double").alias("page_w"), F.col(height).cast("double").alias("page_h"), levels)
    steps = (F.round(F.lit(1.0) / F.col("fraction")) * 2 - 2).cast("int")
    p = p.withColumn("row", F.explode(F.sequence(F.lit(0), steps))).withColumn("col", F.explode(F.sequence(F.lit(0), steps)))
    w, h = F.col("page_w") * F.col("fraction"), F.col("page_h") * F.col("fraction")
    return p.select(*PAGE, "fraction", "row", "col", (F.col("col") * w / 2).alias("x"), (F.col("row") * h / 2).alias("y"), w.alias("w"), h.alias("h"))


def photographs(face_raw: DataFrame, pages: DataFrame) -> DataFrame:
    """face_raw: doc_id, page_no, version, fraction, frame struct<x,y,w,h>, nth, origin_x, origin_y, width, height, score.

    Drops weak, huge and odd-shaped answers, grows the others to photographs, takes the first
    level with any, drops doubles, and returns them in page coordinates as extra boxes.
    """
    sized = search_size(pages).select(*PAGE, "search_w", "search_h", "search_scale")
    raw = face_raw.withColumnRenamed("width", "face_w").withColumnRenamed("height", "face_h").join(sized, list(PAGE))
    fw, sw = F.col("frame.w"), F.col("search_w")
    floor = F.when(fw >= sw, G.FACE_FLOORS[0]).when(fw >= sw / 2, G.FACE_FLOORS[1]).otherwise(G.FACE_FLOORS[2])
    raw = raw.where((F.coalesce("score", F.lit(1.0)) >= floor) & F.col("origin_x").isNotNull())
    grown = G.expand_face((F.col("frame.x") + F.col("origin_x"), F.col("frame.y") + F.col("origin_y"), F.col("face_w"), F.col("face_h")), F.col("search_w"), F.col("search_h"))
    kept = raw.withColumns(dict(zip("xywh", grown)))
    shape = F.try_divide(F.col("w"), F.col("h"))
    kept = kept.where((F.col("w") * F.col("h") <= F.col("search_w") * F.col("search_h") * G.MAX_FACE_AREA) & (F.col("h") > 0) & shape.between(*G.ASPECT))
    order = ["version", "level", "frame_y", "frame_x", "nth"]
    kept = kept.withColumns({"level": -F.col("fraction"), "frame_y": F.col("frame.y"), "frame_x": F.col("frame.x")})
    found = keep_new(first_level(kept, ["version", "level"]).select(*PAGE, *order, "x", "y", "w", "h"), order).join(sized, list(PAGE))
    scaled = [(F.col(c) / F.col("search_scale")).alias(c) for c in "xywh"]
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)).cast("long")
    return found.withColumn("seq", seq).select(*PAGE, F.lit(7).alias("priority"), "seq", *scaled, F.lit("Photograph").alias("label"), F.lit("auto").alias("source"))

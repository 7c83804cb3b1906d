"""From words and pages to redacted copies: the whole path as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators import detect as D, policy as P, raster, stamp
from ..sinks import export, folder


def find_boxes(words: DataFrame, pages: DataFrame, presets: DataFrame | None = None, preset: str | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Boxes of every page; with a preset, enabled as it says."""
    boxes = D.suppress(D.detect(D.on_pages(words, pages), extra))
    return boxes if preset is None else P.apply_preset(boxes, presets, F.lit(preset))


def redact(pages: DataFrame, boxes: DataFrame, keep: tuple = ()) -> DataFrame:
    """doc_id, page_no, width, height, pixels (and what to keep) with the enabled boxes painted over.

    pages: full rasters with scale_to_full; boxes: in working coordinates.
    """
    scaled = boxes.join(pages.select("doc_id", "page_no", "scale_to_full"), ["doc_id", "page_no"])
    return raster.redact_pages(pages, P.regions(scaled), keep)


def redacted_images(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, png of all pages, with or without boxes."""
    return export.pngs(redact(pages, boxes))


def rendered(pages: DataFrame, boxes: DataFrame, text: Column | None = None, keep: tuple = ()) -> DataFrame:
    """Pages redacted, then stamped; without a text redacted only.  The text may be a column that is kept."""
    painted = redact(pages, boxes, keep)
    return painted if text is None else stamp.stamped(painted, text)


def image_files(pages: DataFrame, boxes: DataFrame, text: Column | None = None, keep: tuple = ()) -> DataFrame:
    """name, content of each page (with source_name, source_type): PNG for what came as PNG, else JPEG.

    Pages whose names would be equal get their document and page into them.  Rasters go through
    in one piece, from painting to encoding.
    """
    mime, ext = export.format_for(F.col("source_type"))
    named = folder.told_apart(pages.withColumn("name", T.redacted_name(F.col("source_name"), ext)).withColumn("mime", mime), "doc_id", "page_no")
    return export.encoded(rendered(named, boxes, text, (*keep, "name", "mime"))).select("name", "content")


def pdf_files(pages: DataFrame, boxes: DataFrame, text: Column | None = None, keep: tuple = ()) -> DataFrame:
    """name, content: one PDF of JPEG pages for each document, named after its source_name."""
    names = pages.select("doc_id", T.redacted_name(F.col("source_name"), F.lit("pdf")).alias("name")).distinct()
    whole = rendered(pages, boxes, text, keep).withColumn("mime", F.lit("image/jpeg"))
    files = export.pdfs(export.encoded(whole).withColumnRenamed("content", "jpeg"))
    return folder.told_apart(names, "doc_id").join(files.withColumnRenamed("pdf", "content"), "doc_id").select("name", "content")

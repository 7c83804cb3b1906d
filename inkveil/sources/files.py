"""Files as they come in: checks, kinds, sizes, and images as pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema
from ..functions import geometry as G

_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "pdf": "application/pdf"}


def mime_of(path: Column) -> Column:
    """The type that a file's extension stands for, else application/octet-stream."""
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)\\z", 1))
    kinds = F.create_map(*[F.lit(v) for pair in _TYPES.items() for v in pair])
    return F.coalesce(F.try_element_at(kinds, ext), F.lit("application/octet-stream"))


def reject_reason(mime: Column, size: Column) -> Column:
    """Why a file is turned away, or null: its type, its size, nothing in it, in that order."""
    mb = 1024 * 1024
    return (
        F.when(~F.coalesce(mime, F.lit("")).isin(*schema.ACCEPTED_TYPES), "Only JPG, PNG, WEBP and PDF files can be read.")
        .when(size > schema.MAX_FILE_BYTES, F.concat(F.lit("A file of "), G.half_up(size / mb).cast("long").cast("string"), F.lit(f" MB is too large: {schema.MAX_FILE_BYTES // mb} MB at most.")))
        .when(size == 0, "There is nothing in that file.")
    )


def is_pdf(mime: Column) -> Column:
    return mime == "application/pdf"


def read_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder; rejected ones have a reject_reason and no content.

    Spark's reader makes no task for files of no bytes.  Its list of files has them, so what is
    listed and not read is of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sized = files.select("path", "modificationTime", "length", "content")
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "url string")  # the driver's list of what to read, escaped
    path = F.url_decode(F.replace("url", F.lit("+"), F.lit("%2B")))
    listed = listed.select(F.regexp_replace(path, "^([a-z0-9]+):///", "$1:/").alias("path"))
    nothing = listed.join(sized.select("path"), "path", "left_anti").select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")
    )
    files = sized.unionByName(nothing).withColumn("mime", mime_of(F.col("path"))).withColumn("reject_reason", reject_reason(F.col("mime"), F.col("length")))
    return sized.withColumn("mime", mime_of(F.col("path"))).where(reject_reason(F.col("mime"), F.col("length")).isNull()), files.where("reject_reason is not null").drop("content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a folder of JPEG and PNG images: one page a document, upright pixels, working size and scale.

    Spark decodes; photographs that note another orientation are turned (``exif``).  What
    can't be decoded is left out, WEBP too, which needs a decoder that is not bundled.
    """
    from . import exif

    image = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    image = image.select("origin", "width", "height", F.col("nChannels").alias("channels"), "data")
    turns = exif.turned(spark, path)
    image = exif.set_upright(image, turns, turns.limit(exif.BROADCAST + 1).count() <= exif.BROADCAST)
    w, h = F.col("width"), F.col("height")
    work_w, work_h, scale = G.work_size(w, h)
    return image.select(
        F.xxhash64("origin").alias("doc_id"), F.lit(0).alias("page_no"), w.alias("full_w"), h.alias("full_h"), work_w.alias("work_w"), work_h.alias("work_h"),
        scale.alias("scale_to_full"), F.regexp_extract("origin", "([^/]*)\\z", 1).alias("source_name"), mime_of(F.col("origin")).alias("source_type"),
        "channels", F.col("data").alias("pixels_bgr"),
    )

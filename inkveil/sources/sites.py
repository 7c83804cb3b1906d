"""Static site exports: scanning texts for addresses of content networks, rewriting, verifying."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

TEXTS = ("js", "mjs", "css", "html", "json", "txt")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every text file under a folder."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return named.where(F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)\\z", 1)).isin(*TEXTS))


def scrubbed(texts: DataFrame) -> DataFrame:
    """texts with found (distinct addresses), scrubbed text and what is left after it."""
    out = texts.withColumn("found", T.cdn_urls(F.col("text"))).withColumn("scrubbed", T.scrub(F.col("text")))
    return out.withColumn("left", T.cdn_urls(F.col("scrubbed")))


def report(done: DataFrame) -> DataFrame:
    """scanned, rewritten, remaining: counts of files."""
    return done.agg(
        F.count("*").alias("scanned"), F.coalesce(F.sum((F.size("found") > 0).cast("long")), F.lit(0)).alias("rewritten"),
        F.coalesce(F.sum((F.size("left") > 0).cast("long")), F.lit(0)).alias("remaining"),
    )


def assert_clean(done: DataFrame) -> None:
    """Raises if an address survived."""
    remaining = report(done).collect()[0]["remaining"]
    if remaining:
        raise ValueError(f"addresses of content networks survive in {remaining} files")

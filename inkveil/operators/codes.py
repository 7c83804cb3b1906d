"""Two-dimensional codes: answers of a barcode reader, and finder geometry where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema
from ..functions import geometry as G
from .layout import PAGE


def from_reader(code_raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of a barcode reader's answers: doc_id, page_no, nth, x, y, width, height, format."""
    raw = code_raw.where(F.col("format").isin(*schema.CODE_FORMATS)).select(*PAGE, "nth", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"))
    joined = raw.join(pages.select(*PAGE, "width", "height"), list(PAGE))
    placed = G.pad_code(G.rect(), F.col("width"), F.col("height"))
    return joined.select(*PAGE, F.lit(7).alias("priority"), F.col("nth").cast("long").alias("seq"), *G.named(placed), F.lit("QR code").alias("label"), F.lit("auto").alias("source"))


def finder_bounds(centres: DataFrame) -> DataFrame:
    """doc_id, page_no, error, x, y, w, h: the squarest triple of finder centres (nth, x, y, module) of a page.

    A page has a bounded handful of centres, and triples are made within the page's row.
    """
    c = F.struct("nth", "x", "y", "module")
    page = centres.groupBy(*PAGE).agg(F.array_sort(F.collect_list(c)).alias("all"))
    alike = F.filter("all", lambda a: F.size(F.filter(F.col("all"), lambda b: F.abs(b["module"] - a["module"]) <= a["module"] * 0.35)) >= 3)
    page = page.select(*PAGE, alike.alias("g")).where(F.size("g") >= 3)
    n = F.size("g")
    i = page.select("*", F.explode(F.sequence(F.lit(0), n - 3)).alias("i"))
    ij = i.select("*", F.explode(F.sequence(F.col("i") + 1, n - 2)).alias("j"))
    ijk = ij.select(*PAGE, "i", "j", F.explode(F.sequence(F.col("j") + 1, n - 1)).alias("k"), F.get("g", F.col("i")).alias("a"), F.get("g", F.col("j")).alias("b"), "g")
    ijk = ijk.withColumn("c", F.get("g", F.col("k"))).drop("g")
    scored = ijk.withColumn("error", G.squareness(F.col("a"), F.col("b"), F.col("c"))).where(F.col("error").isNotNull())
    best = scored.groupBy(*PAGE).agg(F.min(F.struct("error", "i", "j", "k", "a", "b", "c")).alias("t"))
    three = [F.col(f"t.{n}") for n in "abc"]
    edge = (three[0]["module"] + three[1]["module"] + three[2]["module"]) / 3 * G.EDGE_MODULES
    x, y = (F.least(*[p[d] for p in three]) - edge for d in "xy")
    right, bottom = (F.greatest(*[p[d] for p in three]) + edge for d in "xy")
    return best.select(*PAGE, F.col("t.error").alias("error"), x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))

"""Grey-level histograms: counts, threshold, quantiles, spread, share of dark.

Input: a key column and a grey level (0 to 255) for each pixel.  Pixels are counted before
anything meets by key, so a page costs at most 256 rows, however many pixels it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G

CLIP = 0.02


def histogram(pixels: DataFrame, key: str) -> DataFrame:
    return pixels.groupBy(key, "grey").agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, key: str) -> DataFrame:
    """key, threshold: the level that parts the pixels best; of equally good ones the last."""
    up = Window.partitionBy(key).orderBy("grey").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    n, v = F.col("n").cast("double"), F.col("grey").cast("double")
    h = hist.select(
        key, "grey", F.sum(n).over(up).alias("wb"), F.sum(n * v).over(up).alias("sb"), F.sum(n).over(whole).alias("total"), F.sum(n * v).over(whole).alias("all"),
        F.coalesce(F.lead("grey").over(Window.partitionBy(key).orderBy("grey")), F.lit(256)).alias("next"),
    )
    wf = F.col("total") - F.col("wb")
    apart = F.try_divide(F.col("sb"), F.col("wb")) - F.try_divide(F.col("all") - F.col("sb"), wf)
    # Levels without pixels part as the one below them does, so the last equal level is just before the next used one.
    h = h.withColumn("variance", F.when(wf > 0, F.col("wb") * wf * apart * apart)).withColumn("level", F.col("next") - 1)
    best = h.groupBy(key).agg(F.max(F.when(F.col("variance").isNotNull(), F.struct("variance", "level"))).alias("best"))
    return best.select(key, F.coalesce(F.col("best.level"), F.lit(128)).cast("long").alias("threshold"))


def quantile(hist: DataFrame, key: str, share: float) -> DataFrame:
    """key, level: the first grey level at which the running count reaches share of the pixels."""
    up = Window.partitionBy(key).orderBy("grey").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.select(key, "grey", F.sum("n").over(up).alias("seen"), F.sum("n").over(Window.partitionBy(key)).alias("total"))
    reached = F.when(F.col("seen") >= F.col("total") * F.lit(share), F.col("grey"))
    return h.groupBy(key).agg(F.coalesce(F.min(reached), F.lit(255)).cast("long").alias("level"))


def contrast_spread(hist: DataFrame, key: str, clip: float = CLIP) -> DataFrame:
    low, high = quantile(hist, key, clip), quantile(hist, key, 1 - clip)
    return low.withColumnRenamed("level", "low").join(high.withColumnRenamed("level", "high"), key).withColumn("spread", F.col("high") - F.col("low"))


def dark_ratio(pixels: DataFrame, rects: DataFrame, key: str, salts: int = 16, large: int = 1 << 20) -> DataFrame:
    """key, ratio: the share of dark pixels (key, px, py, dark) in a rectangle (key, x, y, w, h); 0 where it is empty.

    The pixels of a page of more than ``large`` are dealt to ``salts`` tasks, each with the page's
    rectangle, and counted there before its counts meet.  Pages so large are few for their pixels
    and broadcast; all others keep one row for their rectangle.
    """
    left, top = F.greatest(F.lit(0), F.floor("x")), F.greatest(F.lit(0), F.floor("y"))
    r = rects.select(key, left.alias("l"), top.alias("t"), F.ceil(F.col("x") + F.col("w")).alias("r"), F.ceil(F.col("y") + F.col("h")).alias("b"))
    inside: Column = (F.col("px") >= F.col("l")) & (F.col("px") < F.col("r")) & (F.col("py") >= F.col("t")) & (F.col("py") < F.col("b"))
    parts = F.broadcast(pixels.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > large).select(key, F.lit(salts).alias("_parts")))
    dealt = pixels.join(parts, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.hash("px", "py"), F.col("_parts")), F.lit(0))).drop("_parts")
    each = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    dark = dealt.join(r.join(parts, key, "left").select(*r.columns, F.explode(each).alias("_salt")), [key, "_salt"]).where(inside)
    empty = rects.select(key, F.lit(None).cast("double").alias("dark"))
    return dark.select(key, F.col("dark").cast("double").alias("dark")).unionByName(empty).groupBy(key).agg(F.coalesce(F.avg("dark"), F.lit(0.0)).alias("ratio"))


def stretched(grey: Column, low: Column, high: Column) -> Column:
    """A grey level after contrast stretching; halves go to the even level, as clamped bytes do."""
    value = F.least(F.lit(255.0), F.greatest(F.lit(0.0), (grey - low) * F.try_divide(F.lit(255.0), (high - low).cast("double"))))
    return F.when(high - low < 16, grey.cast("double")).otherwise(F.rint(value))


luma = G.luma

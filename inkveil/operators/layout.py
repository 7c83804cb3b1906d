"""Words on pages: reading order, lines and numeric runs.

All windows here and in the detectors hash by (doc_id, page_no), so that one exchange by
page serves them all: a page never needs another page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, text as T

PAGE = ("doc_id", "page_no")


def _tasks(texts: DataFrame, pages: int = 40_000) -> int:
    """Into how many parts pages are dealt: as lines are small for the memory that their words take, sizes would give too few."""
    few = 2 * texts.sparkSession.sparkContext.defaultParallelism
    return few if texts.isStreaming else max(few, texts.count() // pages)


def tasks_by_chars(texts: DataFrame, chars: int = 8_000_000) -> int:
    """As _tasks, for pages of any length whose words are all wanted: a window's sort holds some twenty times their characters."""
    few = 2 * texts.sparkSession.sparkContext.defaultParallelism
    return max(few, (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // chars)


def with_digits(page: Column) -> Column:
    """Of an array of lines (row, line_no, line) those that a numeric word can be in."""
    return F.filter(page, lambda s: s["line"].rlike("[0-9]"))


def lines_from_text(
    texts: DataFrame, keep=None, unit: int = 18, gap: int = 15, left: int = 50, top: int = 40, pitch: int = 60, height: int = 40, tasks: int | None = None
) -> DataFrame:
    """lines(words) of pages set from plain text, whose rows are their lines: no window over the page's words.

    texts has doc_id, page_no and text, and width and height if these are wanted along.  Words
    are what spaces part; empty ones are dropped.  keep: from an array of lines (row, line_no,
    line) to those whose words are wanted, so that no other word leaves the scan.  Null texts
    have no words.  tasks: into how many parts pages are dealt, where their number does not tell.
    """
    if pitch * 2 < height:
        raise ValueError("rows of text that overlap by more than half are not lines")
    more = [c for c in ("width", "height") if c in texts.columns]
    split = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("row"), line.alias("line")))
    held = F.filter(split, lambda s: s["line"].rlike("[^ ]"))
    numbered = F.transform(held, lambda s, i: F.struct(s["row"].alias("row"), i.alias("line_no"), s["line"].alias("line")))
    # page_no goes through the generator: a constant one would be folded out of later keys but not of
    # this exchange, which would then serve none of them, and every step would shuffle the words anew.
    told = F.transform(numbered if keep is None else keep(numbered), lambda s: F.struct(F.col("page_no").alias("page_no"), s["row"].alias("row"), s["line_no"].alias("line_no"), s["line"].alias("line")))
    each = texts.select("doc_id", *more, F.inline(told)).repartition(tasks or _tasks(texts), *PAGE)
    rows = each.select(*PAGE, *more, "row", "line_no", F.posexplode(F.filter(F.split("line", " ", -1), lambda w: w != "")).alias("pos", "text"))
    # By line_no, as in the windows of detectors, which then find the words in order.
    before = Window.partitionBy(*PAGE, "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    return rows.select(
        *PAGE,
        (F.col("row").cast("long") * 1_000_000 + F.col("pos")).alias("word_idx"),
        "text",
        F.lit(90.0).alias("confidence"),
        (F.lit(left) + chars * unit + F.col("pos") * gap).cast("double").alias("x"),
        (F.lit(top) + F.col("row") * pitch).cast("double").alias("y"),
        (F.length("text") * unit).cast("double").alias("w"),
        F.lit(float(height)).alias("h"),
        *([F.col("width"), F.col("height")] if more else []),
        "line_no", "pos",
    )


def words_from_text(texts: DataFrame, **metrics: int) -> DataFrame:
    """A words table set from plain text: one page a row, one row of words a line."""
    return lines_from_text(texts.select(*PAGE, "text"), **metrics).drop("line_no", "pos")


def lines_of_texts(texts: DataFrame, keep=None, tasks: int | None = None) -> DataFrame:
    """lines(words_from_text(texts)); with keep, of a page that is one text only the lines that it wants.

    Texts that share a page lie over each other; only these pages need windows over all their words.
    """
    texts = texts.select(*PAGE, "text")
    shared = texts.groupBy(*PAGE).count().where("count > 1").select(F.col("doc_id").alias("_doc"), F.col("page_no").alias("_page"))
    if shared.isEmpty():
        return lines_from_text(texts, keep, tasks=tasks)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("page_no").eqNullSafe(F.col("_page"))
    alone, over = (texts.join(shared, same, how) for how in ("left_anti", "left_semi"))
    return lines_from_text(alone, keep, tasks=tasks).unionByName(lines(words_from_text(over, tasks=tasks)))


def read_words(recognised: DataFrame) -> DataFrame:
    """Flattens an OCR result (blocks of paragraphs of lines of words, in a scaled raster) to words.

    recognised: doc_id, page_no, scale and blocks
    array<struct<paragraphs: array<struct<lines: array<struct<words: array<struct<text, confidence, x0, y0, x1, y1>>>>>>>>.
    Blank words are dropped; coordinates come back to the page's.
    """
    words = F.flatten(F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["paragraphs"], lambda p: F.transform(p["lines"], lambda n: n["words"]))))))
    rows = recognised.select(*PAGE, "scale", F.posexplode(words).alias("word_idx", "word"))
    s, w = F.col("scale"), F.col("word")
    return rows.where(F.length(F.regexp_replace(w["text"], f"[{T.SPACE}]", "")) > 0).select(
        *PAGE, F.col("word_idx").cast("long").alias("word_idx"), w["text"].alias("text"), w["confidence"].alias("confidence"),
        (w["x0"] / s).alias("x"), (w["y0"] / s).alias("y"), ((w["x1"] - w["x0"]) / s).alias("w"), ((w["y1"] - w["y0"]) / s).alias("h"),
    )


def lines(words: DataFrame) -> DataFrame:
    """words with line_no and pos: a line ends where a word does not overlap the one before it by (y, x)."""
    order = Window.partitionBy(*PAGE).orderBy("y", "x", "word_idx")
    before = tuple(F.lag(c).over(order) for c in ("x", "y", "w", "h"))
    broken = F.when(before[1].isNull() | ~G.overlaps_vertically(before, G.rect()), 1).otherwise(0)
    numbered = words.withColumn("_broken", broken).withColumn("line_no", (F.sum("_broken").over(order) - 1).cast("int")).drop("_broken")
    across = Window.partitionBy(*PAGE, "line_no").orderBy("x", "word_idx")
    return numbered.withColumn("pos", (F.row_number().over(across) - 1).cast("int"))


def numeric_runs(lined: DataFrame) -> DataFrame:
    """Numeric words of lines with digits and run_no: maximal runs of neighbours in a line."""
    numeric = lined.withColumn("digits", T.digits_of(F.col("text"))).where(F.col("digits").isNotNull())
    across = Window.partitionBy(*PAGE, "line_no").orderBy("pos")
    return numeric.withColumn("run_no", (F.col("pos") - F.row_number().over(across) + 1).cast("int"))


def union(prefix: str = "") -> list:
    """Aggregates for the smallest rectangle around words."""
    x, y, w, h = G.rect()
    left, top = F.min(x), F.min(y)
    return [left.alias(prefix + "x"), top.alias(prefix + "y"), (F.max(x + w) - left).alias(prefix + "w"), (F.max(y + h) - top).alias(prefix + "h")]

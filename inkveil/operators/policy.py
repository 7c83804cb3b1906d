"""Boxes and people: disclosure policies, review, edits, summaries, pixel regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema
from ..functions import geometry as G, text as T
from .layout import PAGE


def find_preset(presets: DataFrame, name: str) -> DataFrame:
    return presets.where(F.col("name") == name)


def apply_preset(boxes: DataFrame, presets: DataFrame, choice: str | Column = "preset") -> DataFrame:
    """enabled anew for every box: hidden unless its label is on the preset's reveal list.

    choice: the preset's name, a column of boxes.  A box whose preset is unknown stays hidden.
    The presets are a fixed handful of rows, so they are broadcast.
    """
    name = F.col(choice) if isinstance(choice, str) else choice
    small = F.broadcast(presets.select(F.col("name").alias("_name"), F.col("reveal").alias("_reveal")))
    joined = boxes.join(small, name == F.col("_name"), "left")
    return joined.withColumn("enabled", ~F.coalesce(F.array_contains("_reveal", F.col("label")), F.lit(False))).drop("_name", "_reveal")


def revealed(boxes: DataFrame, presets: DataFrame) -> DataFrame:
    """doc_id, page_no, name, labels: which of a page's labels each preset leaves readable, in the order they were found."""
    small = F.broadcast(presets.select("name", F.explode("reveal").alias("label")))
    first = boxes.groupBy(*PAGE, "label").agg(F.min(F.struct("priority", "seq")).alias("at"))
    named = first.join(small, "label")
    return named.groupBy(*PAGE, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]).alias("labels"))


def allows_blur(label: Column) -> Column:
    return ~label.isin(*schema.BLOCK_ONLY)


def relabel(boxes: DataFrame, label: Column) -> DataFrame:
    """A new label; a style that it does not allow becomes block."""
    return boxes.withColumn("label", label).withColumn("style", F.when(allows_blur(F.col("label")), F.col("style")).otherwise("block"))


def regions(boxes: DataFrame, scale: str = "scale_to_full") -> DataFrame:
    """Enabled boxes in whole pixels of the full raster."""
    full = G.to_full(G.rect(), F.col(scale))
    return boxes.where("enabled").select(*PAGE, "priority", "seq", *G.named(full), "style")


def seed(existing: DataFrame, found: DataFrame) -> DataFrame:
    """existing boxes, and found ones of pages that have none yet."""
    fresh = found.join(existing.select(*PAGE).distinct(), list(PAGE), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def blocked(pages: DataFrame, boxes: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pages that were read, have no box and were not dismissed: someone has to look at them."""
    ready = pages.where(F.col("ocr_status") == "ready")
    return ready.join(boxes.select(*PAGE).distinct(), list(PAGE), "left_anti").join(dismissed.select(*PAGE).distinct(), list(PAGE), "left_anti")


def page_counts(boxes: DataFrame) -> DataFrame:
    """Boxes and hidden areas of each page."""
    return boxes.groupBy(*PAGE).agg(F.count("*").alias("n_boxes"), F.sum(F.col("enabled").cast("long")).alias("n_hidden"))


def marked_pages(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, marked, total: how many of a document's pages have a box."""
    own = boxes.select(*PAGE).distinct().withColumn("has", F.lit(1))
    return pages.join(own, list(PAGE), "left").groupBy("doc_id").agg(F.count("has").alias("marked"), F.count("*").alias("total"))


def summary(boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, summary: what was found, by label, and how much of it is a guess."""
    found = boxes.where(F.col("source") != "manual")
    first = found.groupBy(*PAGE, "label").agg(
        F.min(F.struct("priority", "seq")).alias("at"), F.count("*").alias("n"), F.sum((F.col("source") == "suggested").cast("long")).alias("unsure")
    )
    page = first.groupBy(*PAGE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", T.spoken(F.col("label")).alias("said")))), lambda s: s["said"]).alias("said"),
        F.sum("n").alias("n"), F.sum("unsure").alias("unsure"),
    )
    unsure = F.col("unsure")
    guesses = F.when(unsure > 0, F.concat(F.lit("Unsure about "), unsure.cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(".")))
    text = F.concat_ws(" ", F.concat(F.lit("Found "), T.listed(F.col("said")), F.lit(".")), guesses, F.lit("Please look over the whole page."))
    return page.select(*PAGE, text.alias("summary"))


NOTHING_FOUND = "No identifiers were found. Please look over the page and mark what should be hidden."


def drawable(boxes: DataFrame) -> DataFrame:
    """Drawn rectangles, flipped right, of eight pixels a side at least."""
    r = G.normalise_rect(G.rect())
    return boxes.withColumns(dict(zip("xywh", r))).where((F.col("w") >= G.MIN_SIZE) & (F.col("h") >= G.MIN_SIZE))


def _r(s: Column) -> G.Rect:
    return s["x"], s["y"], s["w"], s["h"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


EDIT_KINDS = ("draw", "move", "resize", "relabel", "toggle", "restyle", "delete")
_STATE = "struct<x:double,y:double,w:double,h:double,label:string,source:string,style:string,enabled:boolean,gone:boolean>"


def apply_edits(boxes: DataFrame, edits: DataFrame, pages: DataFrame) -> DataFrame:
    """boxes after an ordered fold of edits.

    edits: doc_id, page_no, box_id, seq, kind (one of EDIT_KINDS), handle, dx, dy, label,
    style, enabled, x, y, w, h (draw only).  A drawn box is manual, and dropped if smaller
    than eight pixels a side; a move or resize stays on the page.
    """
    keys = [*PAGE, "box_id"]
    op = F.struct("seq", "kind", "handle", "dx", "dy", "label", "style", "enabled", "x", "y", "w", "h")
    ops = edits.groupBy(*keys).agg(F.array_sort(F.collect_list(op)).alias("ops"))
    start = F.struct(*[F.col(c) for c in ("x", "y", "w", "h", "label", "source", "style", "enabled")], F.lit(False).alias("gone"))
    had = boxes.select(*keys, start.alias("state"))
    joined = had.join(ops, keys, "full").join(pages.select(*PAGE, "width", "height"), list(PAGE))
    nothing = F.struct(
        *[F.lit(None).cast("double").alias(c) for c in "xywh"], F.lit(None).cast("string").alias("label"), F.lit("manual").alias("source"),
        F.lit("block").alias("style"), F.lit(True).alias("enabled"), F.lit(True).alias("gone"),
    )

    def step(s: Column, e: Column) -> Column:
        r = (s["x"], s["y"], s["w"], s["h"])
        width, height, kind = F.col("width"), F.col("height"), e["kind"]
        dx, dy, handle = F.coalesce(e["dx"], F.lit(0.0)), F.coalesce(e["dy"], F.lit(0.0)), F.coalesce(e["handle"], F.lit(""))
        # Each rule is worked out once, as a rectangle, and only where the edit asks for it.
        flipped = _let(F.struct(*G.named(G.drag_rect(r, handle, dx, dy))), lambda d: F.struct(*G.named(G.normalise_rect(_r(d)))))
        sized = _let(flipped, lambda d: F.struct(*G.named(G.clamp_rect(_r(d), width, height))))
        moved = F.struct(*G.named(G.move_rect(r, dx, dy, width, height)))
        drawn = F.struct(*G.named(G.normalise_rect((e["x"], e["y"], e["w"], e["h"]))))
        place = F.when(kind == "move", moved).when(kind == "resize", sized).when(kind == "draw", drawn).otherwise(F.struct(*G.named(r)))
        label = F.when(kind.isin("relabel", "draw"), F.coalesce(e["label"], F.lit("Other"))).otherwise(s["label"])
        style = F.when(kind == "restyle", e["style"]).otherwise(s["style"])

        def put(p: Column) -> Column:
            small = (kind == "draw") & ((p["w"] < G.MIN_SIZE) | (p["h"] < G.MIN_SIZE))
            return F.struct(
                *[p[c].alias(c) for c in "xywh"], label.alias("label"), s["source"].alias("source"), F.when(allows_blur(label), style).otherwise("block").alias("style"),
                F.when(kind == "toggle", e["enabled"]).otherwise(s["enabled"]).alias("enabled"),
                F.when(kind == "delete", F.lit(True)).when(kind == "draw", small).otherwise(s["gone"]).alias("gone"),
            )

        return _let(place, put)

    begun = F.coalesce(F.col("state").cast(_STATE), nothing.cast(_STATE))
    folded = F.aggregate(F.coalesce("ops", F.array()), begun, lambda s, e: step(s, e).cast(_STATE))
    return joined.select(*keys, folded.alias("s")).where(~F.col("s.gone")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in ("x", "y", "w", "h", "label", "source", "style", "enabled")])


def sticky(pages: DataFrame, choices: DataFrame) -> DataFrame:
    """pages with opened_with, the last preset chosen in their session up to them, and shows, the last one of all.

    pages: session, at (when they were opened, anything that has an order) and others; choices:
    session, at, preset.  A choice holds for all pages of its session, and for those opened
    later; without one both are null.  A null session is one.  Choice and page of one time: the choice was first.
    One pass over a session in order: as the rows before a page stream by, only the last choice is kept.
    """
    own = F.struct(*pages.columns)
    both = pages.select("session", "at", F.lit(1).alias("kind"), own.alias("page"), F.lit(None).cast(choices.schema["preset"].dataType).alias("preset"))
    both = both.unionByName(choices.select("session", "at", F.lit(0).alias("kind"), F.lit(None).cast(both.schema["page"].dataType).alias("page"), "preset"))
    upto = Window.partitionBy("session").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = both.withColumn("opened_with", F.last("preset", ignorenulls=True).over(upto)).where("kind = 1").select("page.*", "opened_with")
    last = choices.groupBy(F.col("session").alias("of_session")).agg(F.max_by("preset", "at").alias("shows"))
    return opened.join(last, F.col("session").eqNullSafe(F.col("of_session")), "left").drop("of_session")


def keep_new(boxes: DataFrame, order: list[str], share: float = 0.4) -> DataFrame:
    """Drops a rectangle that lies on one kept before it: common area over ``share`` of the smaller."""
    own = F.struct(*order, "x", "y", "w", "h")
    kind = boxes.select(own.alias("b")).schema["b"].dataType.simpleString()

    def r(b):
        return b["x"], b["y"], b["w"], b["h"]

    fold = F.aggregate(
        F.array_sort("all"), F.array().cast(f"array<{kind}>"),
        lambda kept, b: F.when(F.exists(kept, lambda k: G.overlap(r(k), r(b)) > share), kept).otherwise(F.concat(kept, F.array(b))),
    )
    return boxes.groupBy(*PAGE).agg(F.collect_list(own).alias("all")).select(*PAGE, F.explode(fold).alias("b")).select(*PAGE, "b.*")


def first_level(found: DataFrame, levels: list[str]) -> DataFrame:
    """Of ordered alternatives only the first that found anything on its page (a search that stops there)."""
    w = Window.partitionBy(*PAGE)
    level = F.struct(*levels)
    return found.withColumn("_first", F.min(level).over(w)).where(level == F.col("_first")).drop("_first")

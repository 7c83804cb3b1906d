"""Detectors: words of pages -> boxes.

Input of each: lines(words) joined with the page's width and height, that is doc_id, page_no,
word_idx, text, x, y, w, h, line_no, pos, width, height.  Output: doc_id, page_no, priority,
seq, x, y, w, h, label, source.  (priority, seq) is the order in which findings count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema
from ..functions import geometry as G, text as T
from .layout import PAGE, lines, lines_from_text, numeric_runs

BOX = (*PAGE, "priority", "seq", "x", "y", "w", "h", "label", "source")
_LONG = "array<struct<start:int,stop:int>>"


def _seq() -> Column:
    return F.col("line_no").cast("long") * 1_000_000 + F.col("pos")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def on_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """lines(words) with the width and height of their page."""
    return lines(words.join(pages.select(*PAGE, "width", "height"), list(PAGE)))


def telling(page: Column) -> Column:
    """Of an array of lines (row, line_no, line) those that a detector can find something in.

    That is lines with a digit, with four characters in a row that can be read as a PAN's
    digits, or with a label, and the six lines below a label.  Detectors find in them what
    they find in all lines.
    """
    labels = {*schema.NAME_LABELS, *schema.ADDRESS_LABELS, *(x for those in schema.NUMBER_LABELS.values() for x in those)}
    digits = f"[0-9{T.CONFUSED}]"
    readable = f"[^ ]{{5}}{digits}(?:[^A-Za-z0-9| ]*{digits}){{3}}[^ ]"

    def told(s: Column) -> Column:
        # Lower case comes last, as it is slow on other scripts; of these, two characters have a Latin one.
        anchors = F.split(F.lower(F.regexp_replace(s["line"], "[^A-Za-z\\u0900-\\u097F/ ]+", "")), " ")
        label = F.arrays_overlap(anchors, F.array(*map(F.lit, sorted(labels)))) | s["line"].rlike("[\\u0130\\u212A]")
        return F.struct(s.alias("line"), label.alias("label"))

    def near(all_: Column) -> Column:
        def above(i: Column) -> Column:
            return F.slice(all_, F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6)))

        def matters(s: Column, i: Column) -> Column:
            return s["label"] | s["line"]["line"].rlike("[0-9]") | s["line"]["line"].rlike(readable) | F.exists(above(i), lambda t: t["label"])

        return F.transform(F.filter(all_, matters), lambda s: s["line"])

    return let(F.transform(page, told), near)


def on_texts(texts: DataFrame) -> DataFrame:
    """What on_pages gives, for pages of plain text, but only the lines that can matter.

    texts: doc_id, page_no, text, width, height.  Other lines go before anything is shuffled.
    """
    return lines_from_text(texts, telling)


def _boxes(df: DataFrame, kind: str, seq: Column, r: G.Rect, label: Column, source: Column, ratio: float = 0.18) -> DataFrame:
    placed = G.clamp_rect(G.pad(r, ratio), F.col("width"), F.col("height"))
    return df.select(*PAGE, F.lit(schema.PRIORITY[kind]).alias("priority"), seq.cast("long").alias("seq"), *G.named(placed), label.alias("label"), source.alias("source"))


def _around(words: Column) -> G.Rect:
    """The smallest rectangle around an array of words."""
    x, y = F.array_min(F.transform(words, lambda w: w["x"])), F.array_min(F.transform(words, lambda w: w["y"]))
    right = F.array_max(F.transform(words, lambda w: w["x"] + w["w"]))
    bottom = F.array_max(F.transform(words, lambda w: w["y"] + w["h"]))
    return x, y, right - x, bottom - y


def id_numbers(lined: DataFrame) -> DataFrame:
    """Virtual ids (runs of 16 digits) and Aadhaar numbers (12 digits within a run, greedily from the left)."""
    word = F.struct("pos", "digits", "x", "y", "w", "h", (~F.substring(T.clean(F.col("text")), 1, 1).rlike("[0-9]")).alias("confused"))
    runs = numeric_runs(lined).groupBy(*PAGE, "line_no", "run_no").agg(
        F.array_sort(F.collect_list(word)).alias("ws"), F.first("width").alias("width"), F.first("height").alias("height")
    )
    runs = runs.withColumn("digits", F.array_join(F.transform("ws", lambda w: w["digits"]), ""))
    vid = F.length("digits") == 16
    # before[i]: digits of the run before word i; a number ends where 12 more have come.
    sizes = F.transform("ws", lambda w: F.length(w["digits"]))
    runs = runs.withColumn("before", F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))))

    def candidate(start: Column) -> Column:
        stop = F.array_position(F.col("before"), F.get(F.col("before"), start) + 12).cast("int") - 1
        return F.struct(start.alias("start"), stop.alias("stop"))

    def accepted(c: Column) -> Column:
        text = F.substring(F.col("digits"), F.get(F.col("before"), c["start"]) + 1, F.lit(12))
        first = F.get(F.col("ws"), c["start"])
        members = F.slice(F.col("ws"), c["start"] + 1, F.greatest(c["stop"] - c["start"], F.lit(0)))
        grouped = (c["stop"] - c["start"] == 3) & F.forall(members, lambda w: F.length(w["digits"]) == 4)
        return (c["stop"] > c["start"]) & (T.looks_like_aadhaar(text) | (first["confused"] & grouped))

    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("ws") - 1), candidate), accepted)
    greedy = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("free"), F.array().cast(_LONG).alias("kept")),
        lambda acc, c: F.when(
            c["start"] >= acc["free"], F.struct(c["stop"].alias("free"), F.concat(acc["kept"], F.array(c)).alias("kept"))
        ).otherwise(acc),
    )["kept"]
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("ws").alias("stop")))
    found = runs.select("*", vid.alias("vid"), F.explode(F.when(vid, whole).otherwise(greedy)).alias("span"))
    members = F.slice("ws", F.col("span.start") + 1, F.col("span.stop") - F.col("span.start"))
    found = found.withColumn("members", members).withColumn("number", F.array_join(F.transform("members", lambda w: w["digits"]), ""))
    return _boxes(
        found, "ids", F.col("line_no").cast("long") * 1_000_000 + F.get("members", F.lit(0))["pos"], _around(F.col("members")),
        F.when(F.col("vid"), "VID").otherwise("Aadhaar number"), F.when(T.verhoeff(F.col("number")), "auto").otherwise("suggested"),
    )


def pans(lined: DataFrame, strict: bool = False) -> DataFrame:
    found = lined.where(T.read_pan(F.col("text"), strict).isNotNull())
    return _boxes(found, "pan", F.col("word_idx"), G.rect(), F.lit("PAN"), F.lit("auto"))


def dates(lined: DataFrame) -> DataFrame:
    """Whole dates, and years with a date label among the three words before."""
    across = Window.partitionBy(*PAGE, "line_no").orderBy("pos").rowsBetween(-3, -1)
    labelled = F.coalesce(F.max(T.anchor(F.col("text")).isin(*schema.DATE_LABELS)).over(across), F.lit(False))
    found = lined.withColumn("labelled", labelled).where(T.is_date(F.col("text")) | (T.is_year(F.col("text")) & F.col("labelled")))
    return _boxes(found, "dates", _seq(), G.rect(), F.lit("Date of birth"), F.lit("auto"))


def rows(lined: DataFrame) -> DataFrame:
    """One row for each line: its words with what tells labels, and the next two lines' words.

    What detectors ask of the few words that labels point at is worked out there.
    """
    text, anchored = F.col("text"), F.col("anchor")
    told = lined.withColumn("anchor", T.anchor(text))
    word = F.struct(
        "pos", F.col("line_no").alias("line"), "x", "y", "w", "h", "anchor",
        "text", text.rlike("[0-9]").alias("digit"), anchored.isin(*schema.FILLER).alias("filler"), anchored.isin(*schema.NAME_LABELS).alias("name_label"),
        T.number_label(anchored).alias("number_label"), anchored.isin(*schema.ADDRESS_LABELS).alias("address_label"),
    )
    grouped = told.groupBy(*PAGE, "line_no").agg(F.array_sort(F.collect_list(word)).alias("ws"), F.first("width").alias("width"), F.first("height").alias("height"))
    down = Window.partitionBy(*PAGE).orderBy("line_no")
    return grouped.withColumn("below1", F.lead("ws", 1).over(down)).withColumn("below2", F.lead("ws", 2).over(down))


def _labelled(lined_rows: DataFrame, is_label) -> DataFrame:
    """label (the word), pos, and the value lists a label points at: rest, or rest and what lies under it."""
    # Only label words are exploded, as each takes its line along.
    heads = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("label"))), lambda s: is_label(s["label"]))
    r = lined_rows.withColumn("heads", heads).where(F.size("heads") > 0)
    r = r.select("*", F.inline("heads")).drop("heads")
    label = F.col("label")
    r = r.withColumn("rest", F.slice("ws", F.col("pos") + 2, F.size("ws")))
    spoken = F.exists("rest", lambda w: w["digit"] | ((w["anchor"] != "") & ~w["filler"]))
    reach = label["x"] + F.greatest(label["w"], label["h"]) * 3

    def under(c: str) -> Column:
        return F.when(~spoken, F.filter(c, lambda w: (w["x"] + w["w"] > label["x"] - label["h"]) & (w["x"] < reach)))

    return r.withColumn("under1", under("below1")).withColumn("under2", under("below2")).drop("below1", "below2")


def labelled_numbers(lined_rows: DataFrame) -> DataFrame:
    """The first reference among the first four words of the first list that has one."""
    found = _labelled(lined_rows, lambda w: w["number_label"].isNotNull())
    value = F.coalesce(*[F.get(F.filter(F.slice(c, 1, 4), lambda w: T.looks_like_reference(w["text"])), F.lit(0)) for c in ("rest", "under1", "under2")])
    found = found.withColumn("value", value).where(F.col("value").isNotNull())
    v = F.col("value")
    return _boxes(found, "numbers", _seq(), (v["x"], v["y"], v["w"], v["h"]), F.col("label.number_label"), F.lit("suggested"))


def names(lined_rows: DataFrame) -> DataFrame:
    """Up to five name-like words after the filler that follows a name label."""
    found = _labelled(lined_rows, lambda w: w["name_label"])
    found = found.where(~F.exists(F.slice("rest", 1, 3), lambda w: w["anchor"].isin(*schema.NOT_A_PERSON)))

    def first_not(a: Column, ok) -> Column:
        """How many elements at the head satisfy ok."""
        return let(F.array_position(F.transform(a, lambda w: ~ok(w)), True).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(F.size(a)))

    def value_of(a: Column) -> Column:
        tail = F.slice(a, first_not(a, lambda w: w["filler"] | (w["anchor"] == "")) + 1, 5)
        return let(tail, lambda t: F.slice(t, 1, first_not(t, lambda w: T.looks_like_name_part(w["text"]) & ~w["name_label"] & w["number_label"].isNull())))

    lists = F.array(*[F.coalesce(value_of(F.col(c)), F.slice("rest", 1, 0)) for c in ("rest", "under1", "under2")])
    found = found.withColumn("value", F.get(F.filter(lists, lambda v: F.size(v) > 0), F.lit(0))).where(F.col("value").isNotNull())
    page = found.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(_seq().alias("own"), "width", "height", "value"))).alias("all"))

    def claim(acc: Column, c: Column) -> Column:
        """Of candidates made of words that earlier ones hold, only the first counts."""
        words = F.transform(c["value"], lambda v: F.struct(v["line"].alias("line"), v["pos"].alias("pos")))
        taken = let(words, lambda w: F.struct(F.array_union(acc["claimed"], w).alias("claimed"), (F.size(F.array_except(w, acc["claimed"])) > 0).alias("fresh")))
        return let(taken, lambda t: F.when(t["fresh"], F.struct(t["claimed"].alias("claimed"), F.concat(acc["kept"], F.array(c)).alias("kept"))).otherwise(acc))

    empty = F.struct(F.array().cast("array<struct<line:int,pos:int>>").alias("claimed"), F.slice("all", 1, 0).alias("kept"))
    found = page.select(*PAGE, F.inline(F.aggregate("all", empty, claim)["kept"]))
    return _boxes(found, "names", F.col("own"), _around(F.col("value")), F.lit("Name"), F.lit("suggested"))


def addresses(lined_rows: DataFrame, most: int = 6) -> DataFrame:
    """From an address label to the line with a PIN code, six lines down at most; the search goes on below the block."""
    start = F.array_position(F.transform("ws", lambda w: w["address_label"]), True).cast("int")
    # Most pages have no such label; the rest is worked out for those that do.
    lined_rows = lined_rows.withColumn("start", start).withColumn("_any", F.max("start").over(Window.partitionBy(*PAGE))).where("_any > 0")
    marked = lined_rows.select(*PAGE, "line_no", "width", "height", "ws", "start", F.exists("ws", lambda w: w["digit"] & T.is_pin(w["text"])).alias("pin"), *G.named(_around(F.col("ws"))))
    down = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(1, most)
    below = F.collect_list(F.struct("line_no", "pin", "x", "y", "w", "h")).over(down)
    marked = marked.withColumn("below", below).where(F.col("start") > 0)
    stop = F.coalesce(F.array_min(F.transform(F.filter("below", lambda r: r["pin"]), lambda r: r["line_no"])), F.array_max(F.transform("below", lambda r: r["line_no"])), F.col("line_no"))
    marked = marked.withColumn("stop", stop)
    # The few lines with a label bring all that their box needs, so no page is put together a second time.
    own = F.struct("line_no", "stop", "width", "height", "ws", "start", "below")
    page = marked.groupBy(*PAGE).agg(F.array_sort(F.collect_list(own)).alias("all"))
    kept = F.aggregate(
        "all",
        F.struct(F.lit(-1).alias("last"), F.slice("all", 1, 0).alias("kept")),
        lambda acc, r: F.when(r["line_no"] > acc["last"], F.struct(r["stop"].alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept"))).otherwise(acc),
    )["kept"]
    found = page.select(*PAGE, F.inline(kept))
    head = F.transform(F.slice("ws", F.col("start"), F.size("ws")), lambda w: F.struct(w["x"].alias("x"), w["y"].alias("y"), w["w"].alias("w"), w["h"].alias("h")))
    rest = F.transform(F.filter("below", lambda r: r["line_no"] <= F.col("stop")), lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h")))
    found = found.withColumn("members", F.concat(head, rest))
    return _boxes(found, "address", F.col("line_no").cast("long") * 1_000_000 + F.col("start") - 1, _around(F.col("members")), F.lit("Address"), F.lit("auto"), 0.03)


def detect(lined: DataFrame, extra: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """All detectors' findings, and those of detectors that read no text (extra, boxes), before suppression."""
    r = rows(lined)
    found = [id_numbers(lined), pans(lined, strict), dates(lined), labelled_numbers(r), names(r), addresses(r)]
    if extra is not None:
        found.append(extra.withColumn("priority", F.lit(schema.PRIORITY["extra"])).select(*BOX))
    return reduce(DataFrame.unionByName, found)


def _apart(boxes: DataFrame, start: str, extent: str, name: str, *within: str) -> DataFrame:
    """boxes with a number that differs where a gap parts them along an axis: such boxes never overlap."""
    order = Window.partitionBy(*PAGE, *within).orderBy(start)
    reached = F.max(F.col(start) + F.col(extent)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = boxes.withColumn(name, F.when(F.col(start) >= reached, 1).otherwise(0))
    return new.withColumn(name, F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def suppress(boxes: DataFrame, share: float = 0.6, safe: bool = False) -> DataFrame:
    """Keeps a box unless one kept before it on its page covers more than ``share`` of it.

    Boxes are compared within heaps that gaps part, so a page of many boxes costs what its
    heaps do.
    safe: a box whose label must be blocked out never gives way to one of another label that
    a policy may reveal.
    """
    box = F.struct("priority", "seq", "x", "y", "w", "h", "label", "source")
    kept_type = "array<struct<priority:int,seq:bigint,x:double,y:double,w:double,h:double,label:string,source:string>>"

    def r(b: Column) -> G.Rect:
        return b["x"], b["y"], b["w"], b["h"]

    def gives_way(k: Column, b: Column) -> Column:
        covered = G.covers(r(k), r(b)) > share
        return covered & ~(b["label"].isin(*schema.BLOCK_ONLY) & ~k["label"].isin(*schema.BLOCK_ONLY)) if safe else covered

    fold = F.aggregate(
        F.array_sort("all"), F.array().cast(kept_type),
        lambda kept, b: F.when(F.exists(kept, lambda k: gives_way(k, b)), kept).otherwise(F.concat(kept, F.array(b))),
    )
    page = _apart(_apart(boxes, "y", "h", "_band"), "x", "w", "_heap", "_band").groupBy(*PAGE, "_band", "_heap").agg(F.collect_list(box).alias("all"))
    out = page.select(*PAGE, F.explode(fold).alias("b"))
    return out.select(*PAGE, F.xxhash64(*PAGE, "b.priority", "b.seq").alias("box_id"), "b.*", F.lit("block").alias("style"), F.lit(True).alias("enabled"))

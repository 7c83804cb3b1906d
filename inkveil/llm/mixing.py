"""Mixing sources to target weights by systematic sampling (operator 13).

Each source is to give ``share`` times all words together with the others, in the proportion of
its weight: sources by code point (null last) weigh ``weights`` in turn.  No source gives more
than ``cap`` times its own words; what is over goes to the others by weight, again and again
until none is above: target = min(cap x words, level x weight) with one level for all.

Within a source every document is expected target / words times.  These expectations are summed
up over the source's documents, a random offset is added, and a document is taken once for
every whole number that its sum passes: the floor or the ceiling of what is expected.  The
documents stand in order of their size class (an eighth of an octave), largest first, so that
neighbours are alike and what one document gives too much the next gives back: a source misses
its target by about the size of one large document at most.

Nothing but DataFrame functions.  A running sum over a source would be one task, and one
source may hold a third of all rows.  So a class of n documents is dealt by a hash of doc_id to
the square root of n chunks: places within a chunk, chunks within a class and classes within a
source are three windows, none of more than about that many rows.  The table that documents
look their class up in is broadcast up to ``BROADCAST`` rows and salted beyond.

Null texts and empty ones have size 0 and are taken 0 words of; a null source is a source, null
doc_ids are documents; repeated rows each have a place of their own; an empty table gives an
empty one; further columns do not matter, whatever their names.  Offset and order come from
hashes of ``seed``, doc_id and source, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 13
#: Rows of three numbers and a source that are sent to every executor at most; sources that one task numbers; parts of a hot class beyond.
BROADCAST, RANGE, SALTS = 100_000, 100_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes below 16 are their own class; above, eight classes to each doubling.  Larger sizes, larger classes."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 8 - 8 + F.call_function("shiftright", size, bits - 4)).cast("int")


def draw(*parts: Column | str) -> Column:
    """A number below 2^32 from the hash of the parts (nulls are passed over)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Equal for equal sources, null too, and never null itself."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """sources with their weight: their place by code point, null last, picks it.  A range of sources is numbered in each task."""
    order = [F.col("key") == "", F.col("key")]
    ranges = 1 + sources.count() // RANGE
    dealt = sources.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "mix-sources")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    cycle = F.array(*map(F.lit, weights))
    return dealt.join(starts, "part").withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights))).cast("int"))).drop("part", "start")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """key, source_size -> also weight and target.  Each round adds the sources that are above their cap at the level of the last."""
    known = staged(numbered(sources, weights), "mix-weights")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        open_ = F.col("weight") * F.lit(level) < F.lit(cap) * F.col("source_size")
        got = known.agg(F.sum(F.when(~open_, F.col("source_size"))), F.sum(F.when(open_, F.col("weight")))).first()
        if not got[1]:
            break
        last, level = level, (share * total - cap * (got[0] or 0)) / got[1]
        if level <= last:
            break
    limit = F.lit(cap) * F.col("source_size")
    return known.withColumn("target", F.when(F.lit(level) * F.col("weight") < limit, F.lit(level) * F.col("weight")).otherwise(limit))


def looked_up(rows: DataFrame, strata: DataFrame, small: bool) -> DataFrame:
    """rows with what their source and class have; salted where strata is too long to broadcast, as a source may be a third of rows."""
    if small:
        return rows.join(F.broadcast(strata), ["key", "class"])
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    rows = rows.withColumn("salt", F.pmod(draw(F.lit("salt"), F.col("doc_id").cast("string")), F.lit(SALTS)))
    return rows.join(strata.withColumn("salt", F.explode(salts)), ["key", "class", "salt"]).drop("salt")


def sampled(rows: DataFrame, keys: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, most: int = BROADCAST) -> DataFrame:
    """rows (doc_id, key, size and others) with source_size, target and copies; keys: the same rows' doc_id, key, size."""
    classes = keys.groupBy("key", size_class(F.col("size")).alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = staged(classes, "mix-classes")
    aims = targets(classes.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, cap)
    larger = Window.partitionBy("key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    strata = classes.join(aims, "key").select(
        "key", "class", "source_size", "target", F.ceil(F.sqrt("n")).alias("chunks"), F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("larger")
    )
    strata = staged(strata, "mix-strata")
    small = strata.count() <= most

    def dealt(df: DataFrame) -> DataFrame:
        df = looked_up(df.withColumn("class", size_class(F.col("size"))), strata, small)
        return df.withColumn("chunk", F.pmod(draw(F.lit(str(seed)), F.col("doc_id").cast("string")), F.col("chunks")))

    chunk = ["key", "class", "chunk"]
    earlier = Window.partitionBy("key", "class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt(keys).groupBy(*chunk).agg(F.count("*").alias("n")).select(*chunk, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*chunk).orderBy(F.desc("size"), F.col("doc_id").asc_nulls_first())
    placed = dealt(rows).withColumn("rank", F.row_number().over(inside)).join(starts, chunk)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    source = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30))
    offset = (draw(F.lit(f"{seed}:offset"), source) + F.lit(0.5)) / F.lit(4294967296.0)
    upto = lambda k: F.floor(offset + rate * k)
    place = F.col("larger") + F.col("start") + F.col("rank")
    return placed.withColumn("copies", F.least(upto(place) - upto(place - 1), F.ceil(rate))).drop("class", "chunks", "larger", "chunk", "start", "rank")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), *more)


def mix_sizes(docs: DataFrame, **choices) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each document.  Texts are read once and not shuffled."""
    keys = staged(keyed(docs), "mix-sizes")
    out = sampled(keys, keys, **choices)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **choices) -> DataFrame:
    """The mix itself: rows of docs, as they are, each as often as it is taken."""
    keys = staged(keyed(docs), "mix-sizes")
    taken = sampled(keyed(docs, F.struct("*").alias("row")), keys, **choices)
    return taken.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))))).select("row.*")

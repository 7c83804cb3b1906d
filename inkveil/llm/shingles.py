"""Near-duplicates by exact Jaccard similarity of word shingles (the pipeline's near-dedup stage).

Text is split into words as for operator 8; a document's set holds the hashes (XXH64, seed 42)
of its shingles of five words (fewer words: one shingle of all of them; none: empty).  Two
documents are linked if their sets' Jaccard similarity is 0.8 or more.

Candidates come from SimHash: a set's fingerprint has a bit where over half of its hashes
have one.  The 64 bits are split into five blocks, and each choice of two of them is a band:
fingerprints at most three bits apart share one for sure, others up to ``WIDE`` bits apart
often do and are candidates too.  Pairs at 0.8 differ by up to 11 bits, which no affordable
choice of blocks covers, so sixteen bands of four minimum hashes stand beside them: a pair at
exactly 0.8 meets there with probability 1 - (1 - 0.8^4)^16 = 0.9998, and closer ones more
surely.  Every candidate's similarity is worked out from the whole sets.

Equal sets are one node.  Where more than ``light`` nodes meet in a band, all are compared with
the least of them first, then only nodes that this left in different components with each
other; a group of near copies of one text costs one pair for each member.  Of these later pairs
the join gives each once, and only if sizes, bitmaps and counts of parts of the sets, which
bound what two sets can have in common, allow the similarity: no similar pair is lost by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batch, keyed_texts, pieces_of, staged
from .simhash import SEED, components, first_of_groups, majority, masks

WORDS, BANDS, ROWS = 5, 16, 4
#: Fingerprints so many bits apart share a choice of blocks for sure; those of candidates are WIDE bits apart at most.
NEAR, WIDE = 3, 11
#: The similarity from which documents are near-duplicates, as a fraction.
ALIKE = (4, 5)

_rng = np.random.default_rng(SEED)
_FLIPS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)

_PICKS = np.array(masks(distance=NEAR), np.int64)

SKETCHES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("key", pa.int64()), ("hashes", pa.binary())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Parts of a set whose sizes bound what two sets can have in common, and bits that say which parts of so many are not empty.
PARTS, BITS = 128, 512
COUNTS = pa.schema([("key", pa.int64()), ("parts", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))])


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    found = text.lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(ends) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist())], "<u8"))


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _fingerprint(hashes: np.ndarray) -> int:
    """The set's SimHash as a signed long."""
    return int(np.uint64(majority((hashes[at : at + (1 << 14)] for at in range(0, len(hashes), 1 << 14)), len(hashes))).view(np.int64))


def _bands(hashes: np.ndarray, fp: int) -> list[int]:
    """The minimum hashes' bands, then the fingerprint's choices of blocks."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        mixed = (hashes[at : at + (1 << 12), None] ^ _FLIPS) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
        least = np.minimum(least, mixed.min(axis=0))
    return [xxhash.xxh3_64_intdigest(row.tobytes()) - (1 << 63) for row in least.reshape(BANDS, ROWS)] + (_PICKS & fp).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the whole set), n (its size), fp (its SimHash), bands."""

    def run(batches):
        for b in pieces_of(batches, rows=4096, size=4 << 20):
            rows = {"doc_id": b.column("doc_id"), "key": [], "n": [], "fp": [], "bands": []}
            for text in b.column("text").to_pylist():
                own = shingle_set(text.encode())
                rows["key"].append(_key(own))
                rows["n"].append(len(own))
                rows["fp"].append(_fingerprint(own))
                rows["bands"].append(_bands(own, rows["fp"][-1]))
            yield batch(rows, SKETCHES)

    return keyed_texts(docs).mapInArrow(run, "doc_id long, key long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, hashes of the wanted nodes (key, least): read again from the text of their least document."""

    def run(batches):
        for b in pieces_of(batches, rows=4096, size=4 << 20):
            own = [shingle_set(text.encode()) for text in b.column("text").to_pylist()]
            yield batch({"key": list(map(_key, own)), "hashes": [x.tobytes() for x in own]}, SETS)

    ids = wanted.select("least").distinct()
    texts = keyed_texts(docs)
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["least"]), "left_semi")
    # A doc_id may repeat with other texts, whose sets are not asked for.
    found = texts.mapInArrow(run, "key long, hashes binary")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    part, whole = ALIKE

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(whole * common >= part * (len(p) + len(q) - common))
            kept = pa.array(keep, pa.bool_())
            yield batch({"a": b.column("a").filter(kept), "b": b.column("b").filter(kept)}, EDGES)

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _parts(sets: DataFrame) -> DataFrame:
    """key, parts (how many of a set's hashes fall into each of PARTS parts), bits."""

    def run(batches):
        for b in batches:
            own = [np.frombuffer(x, "<u8") for x in b.column("hashes").to_pylist()]
            counts = [np.bincount((x % PARTS).astype(np.int64), minlength=PARTS) for x in own]
            marks = []
            for x in own:
                flags = np.zeros(BITS, np.uint8)
                flags[(x >> np.uint64(32)) % BITS] = 1
                marks.append(np.packbits(flags).view("<i8"))
            yield batch({"key": b.column("key"), "parts": counts, "bits": marks}, COUNTS)

    return sets.select("key", "hashes").mapInArrow(run, "key long, parts array<int>, bits array<long>")


def _may_be_alike():
    """What two sets have in common is bounded by their sizes less the parts that only one of them has, and by the
    smaller of the two numbers, part by part.  Sets that cannot have enough in common are not similar enough."""
    part, whole = ALIKE
    n, m = F.col("n"), F.col("n_")
    lone = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(1, BITS // 64)), F.bit_count(F.col(x)[0].bitwiseAND(F.bitwise_not(F.col(y)[0]))))
    enough = lambda common: common * (whole + part) >= (n + m) * part
    least = F.aggregate(F.zip_with("parts", "parts_", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    return enough(n - lone("bits", "bits_")) & enough(m - lone("bits_", "bits")) & enough(least)


def _near_sizes(n, m):
    """Sets whose sizes are further apart cannot be similar enough."""
    part, whole = ALIKE
    return F.least(n, m) * whole >= F.greatest(n, m) * part


def _near_prints(fp, other):
    """Candidates of a choice of blocks are at most WIDE bits apart; minimum hashes ask for no such thing."""
    return (F.col("band") < BANDS) | (F.bit_count(F.col(fp).bitwiseXOR(F.col(other))) <= WIDE)


def links(docs: DataFrame, nodes: DataFrame, light: int = 64) -> DataFrame:
    """a < b: pairs of nodes (key, least, n, fp, bands) that connect all similar candidates."""
    keys = nodes.select("key", "n", "fp", F.posexplode("bands").alias("band", "value"))
    met = keys.groupBy("band", "value").agg(F.count("*").alias("many"), F.min_by("n", "key").alias("pivot_n"), F.min_by("fp", "key").alias("pivot_fp"), F.min("key").alias("pivot")).where("many > 1")
    met = staged(keys.join(met, ["band", "value"]), "met")
    small = met.where(F.col("many") <= light)
    one, two = (small.select("band", "value", F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("fp").alias(f"fp_{k}")) for k in "ab")
    pairs = one.join(two, ["band", "value"]).where("a < b").where(_near_sizes(F.col("n_a"), F.col("n_b")) & _near_prints("fp_a", "fp_b")).select("a", "b")
    crowd = met.where(F.col("many") > light)
    to_pivot = crowd.where("key > pivot").where(_near_sizes(F.col("n"), F.col("pivot_n")) & _near_prints("fp", "pivot_fp")).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    pairs = staged(pairs.unionByName(to_pivot).distinct(), "pairs")
    wanted = met.select("key").distinct().join(nodes.select("key", "least"), "key")
    used = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(crowd.select("key")).distinct()
    sets = staged(_sets(docs, wanted.join(used, "key")), "sets")
    found = staged(_alike(pairs, sets), "alike")
    if crowd.limit(1).count() == 0:
        return found
    # What the pivots left apart: each such node with all nodes of its crowds in other components,
    # in the first band that both share, and only if their sizes and parts allow it.
    of = components(found)
    crowd = crowd.join(of, crowd["key"] == of["node"], "left").withColumn("root", F.coalesce("root", "key"))
    homes = crowd.where("key = pivot").select("band", "value", F.col("root").alias("home"))
    more = crowd.join(homes, ["band", "value"]).select("band", "value", "key", "n", "fp", "root", "home")
    left = more.where("root <> home")
    # Crowds that the pivot put together whole are done with.
    open_ = more.join(left.select("band", "value").distinct(), ["band", "value"], "left_semi")
    known = nodes.select("key", "bands").join(_parts(sets), "key")
    crowd = staged(open_.join(known, "key"), "crowd")
    left = crowd.where("root <> home").select("band", "value", *(F.col(c).alias(f"{c}_") for c in ("key", "n", "fp", "root", "bands", "parts", "bits")))
    first = F.coalesce(*(F.when(F.col("bands")[i] == F.col("bands_")[i], i) for i in range(BANDS + len(_PICKS)))) == F.col("band")
    once = (F.col("root") == F.col("home")) | (F.col("key") < F.col("key_"))
    alike = _near_sizes(F.col("n"), F.col("n_")) & _near_prints("fp", "fp_") & once & first & _may_be_alike()
    more = crowd.join(left, ["band", "value"]).where(F.col("root") != F.col("root_")).where(alike)
    more = staged(more.select(F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b")).distinct(), "pairs")
    return found.unionByName(_alike(more, sets))


def groups(docs: DataFrame, light: int = 64) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links, itself included)."""
    rows = staged(sketches(docs), "sketches")
    nodes = staged(rows.groupBy("key").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "bands"))), "nodes")
    found = components(links(docs, nodes, light))
    of = nodes.join(found, nodes["key"] == found["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "key").join(of.join(roots, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id of each group of near-duplicates, as ``simhash.keep_first`` does."""
    return first_of_groups(docs, groups(docs))

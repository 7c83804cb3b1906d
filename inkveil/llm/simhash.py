"""SimHash near-duplicates by pigeonhole blocks (operator 8).

Fingerprint: lower-case A-Z, words of bytes other than 20 and 09-0D, shingles of three
words with repeats (fewer words: one shingle of all of them; none: fingerprint zero), each
hashed by XXH64 with seed 42; a bit is set if it is set in over half of the hashes.

Links: fingerprints at most two bits apart.  The 64 bits are split into five blocks; two
such fingerprints agree on three of them at least.  So each distinct fingerprint goes to the
ten choices of three blocks (38 bits or so together), those that meet there are compared,
and links are kept after the Hamming distance has been verified.  Where more than ``light``
distinct fingerprints meet, comparing all of them would grow with the square of the group;
these instead look each other up by their single-bit neighbours: two fingerprints are at
most two bits apart iff they have a neighbour (or themselves) in common, and no neighbour
belongs to more than 65 fingerprints.  Either way is exact.

Components are found on distinct fingerprints by alternating large-star and small-star
rounds, each written to the shared folder.

Null texts count as empty.  Repeated rows stay, each with the same fingerprint; an empty
table gives an empty result; further columns of the table are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch, keyed_texts, pieces_of, staged

SEED, WORDS, DISTANCE = 42, 3, 2
BLOCKS = (13, 13, 13, 13, 12)
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def majority(hashes, n: int) -> int:
    """The bits that over half of n hashes have, which come in arrays."""
    ones = np.zeros(64, np.int64)
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    found = text.lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(ends) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    parts = (zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)]) for at in range(0, n, 1 << 14))
    return majority((np.array([digest(joined[a:b], seed) for a, b in part], "<u8") for part in parts), n)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in pieces_of(batches, rows=4096, size=4 << 20):
            fps = [fingerprint(t.encode(), words, seed) for t in b.column("text").to_pylist()]
            yield batch({"doc_id": b.column("doc_id"), "fp": np.array(fps, np.uint64).view(np.int64)}, FINGERPRINTS)

    return keyed_texts(docs).mapInArrow(run, "doc_id long, fp long")


def masks(blocks: tuple[int, ...] = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bits of each choice of blocks that a close pair can agree on, as signed longs."""
    at, parts = 0, []
    for n in blocks:
        parts.append(((1 << n) - 1) << at)
        at += n
    picks = [sum(p) for p in combinations(parts, len(blocks) - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in picks]


def _bits(x: Column) -> Column:
    return F.bit_count(x)


def links(nodes: DataFrame, distance: int = DISTANCE, light: int = 64) -> DataFrame:
    """a < b (as signed longs) of distinct fingerprints: links that connect all that are close."""
    if distance != 2:
        raise ValueError("the lookup by shared neighbours is for a distance of two")
    keys = nodes.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(distance=distance)])).alias("pick", "key")
    )
    met = keys.groupBy("pick", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(met, ["pick", "key"])
    small = met.where(F.col("n") <= light).groupBy("pick", "key").agg(F.collect_list("fp").alias("fps"))
    edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for b in batches:
            out = []
            for fps in b.column("fps").to_pylist():
                x = np.sort(np.array(fps, np.int64))
                apart = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64))
                i, j = np.nonzero(np.triu(apart <= distance, 1))
                out.append(np.stack([x[i], x[j]]))
            got = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            yield batch({"a": got[0], "b": got[1]}, edges)

    close = small.select("fps").mapInArrow(compare, "a long, b long")
    crowd = met.where(F.col("n") > light).select("fp").distinct()
    near = crowd.select(
        "fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])).alias("mid")
    )
    near = near.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    near = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return close.unionByName(near).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) of every node that has an edge."""
    now = staged(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select("v", F.col("m").alias("u")).distinct()
        lowest = star.groupBy("v").agg(F.min("u").alias("m"))
        joined = star.join(lowest, "v")
        star = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v")
        star = star.unionByName(lowest.select("v", F.col("m").alias("u"))).distinct()
        now = staged(star, "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).collect()[0]
    return tuple(row)


def _groups(fps: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of staged fingerprints."""
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(nodes.select("fp")))
    of = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(of.join(roots, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links, itself included)."""
    found = _groups(staged(fingerprints(docs), "fingerprints"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id of each component (doc_id, component_id).

    Where rows repeat that doc_id, one of them stays.  Rows without a doc_id have no place
    in that order: they stay if no row of their component has one, and then all of them.
    """
    found = staged(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"), "kept")
    kept = docs.join(found.distinct(), docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
    if found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count():
        known = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
        kept = known.unionByName(kept.where(F.col("doc_id").isNull()))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_first(docs: DataFrame) -> DataFrame:
    """The first row of docs of each component of close fingerprints."""
    return first_of_groups(docs, _groups(staged(fingerprints(docs), "fingerprints")))

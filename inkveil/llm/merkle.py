"""Merkle manifest of a dataset (operator 12).

Each row is a leaf: SHA-256 over its fields, lengths before values.  A source's leaves ascend by
doc_id (equal ones by digest) and every three consecutive nodes of a level have one parent (the
last run: what is left, even one).  The tops of the sources, null first and then bytewise, are
the leaves of one more such tree; its top is the dataset's root.

**Forests.**  Leaves are sorted into ranges, one task each.  What a task knows of a tree is a
sparse forest: nodes by level and index.  As the tree's number of leaves is known, so is the
arity of every run, and whenever all of a run is there its parent takes its place.  Forests of
the same tree merge by union and the same rule, in any order and grouping: an associative,
commutative monoid whose neutral element is the empty forest.  After the local fold at most four
nodes a level are left of a range; merging is done eight ranges at a time, in as many rounds as
the logarithm of their number, each a shuffle of these few nodes and each written to the shared
folder.  No task ever holds a whole tree.

**Proofs.**  A range asks the nodes by name for the runs at its two borders, at most six a
level; with them and its own leaves it has every sibling on every leaf's way up, and folds
leaves (also changed ones) to the root.

Null fields are `-` and no length; a null source is a tree of its own; null doc_ids come first;
repeated rows are leaves of their own, next to each other; an empty table gives an empty one;
further columns are not read, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import staged

ARITY, FAN = 3, 8
#: Leaves in a range, which one task holds (some 200 bytes each, and 2 KB for a third of them).
ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, total long, level int, idx long, digest string, block long, live boolean, new boolean"
NODE = pa.schema([("tree", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("block", pa.int64()), ("live", pa.bool_()), ("new", pa.bool_())])
SIDE = "part long, tree string, level int, idx long, total long, digest string"
ASKED = pa.schema([("part", pa.int64()), ("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64())])


def parent(digests) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def width(total: int, level: int) -> int:
    """Nodes of a level of a tree of so many leaves."""
    for _ in range(level):
        total = -(-total // ARITY)
    return total


def top(total: int) -> int:
    level = 0
    while total > 1:
        total, level = -(-total // ARITY), level + 1
    return level


def merge(nodes: dict[tuple[int, int], str], total: int) -> tuple[dict[tuple[int, int], str], dict[tuple[int, int], str]]:
    """(what is left, what was made) once complete runs of siblings have become their parents."""
    left, made = dict(nodes), {}
    level = 0
    while (wide := width(total, level)) > 1:
        runs: dict[int, list[int]] = {}
        for at, idx in left:
            if at == level:
                runs.setdefault(idx // ARITY, []).append(idx)
        for run, found in runs.items():
            if len(found) == min(ARITY, wide - run * ARITY):
                made[level + 1, run] = left[level + 1, run] = parent(left.pop((level, i)) for i in sorted(found))
        level += 1
    return left, made


def folded(digests: list[str], start: int, total: int):
    """Of leaves start, start + 1, ...: the nodes that lack siblings, and by level the first index and all digests."""
    left, levels, level = {}, [], 0
    while True:
        stop, wide = start + len(digests), width(total, level)
        levels.append((start, digests))
        first = -(-start // ARITY)
        last = stop // ARITY if stop < wide else -(-wide // ARITY)
        if wide == 1 or first >= last:
            left |= {(level, start + i): d for i, d in enumerate(digests)}
            return left, levels
        left |= {(level, i): digests[i - start] for i in (*range(start, first * ARITY), *range(last * ARITY, stop))}
        digests = [parent(digests[max(0, g * ARITY - start) : g * ARITY + ARITY - start]) for g in range(first, last)]
        start, level = first, level + 1


def border(start: int, n: int, total: int):
    """(level, index) of the runs at the borders of leaves start to start + n: what they may not know themselves."""
    first, last, level = start, start + n - 1, 0
    while (wide := width(total, level)) > 1:
        for run in {first // ARITY, last // ARITY}:
            yield from ((level, i) for i in range(run * ARITY, min(run * ARITY + ARITY, wide)))
        first, last, level = first // ARITY, last // ARITY, level + 1


class Forest(NamedTuple):
    leaves: DataFrame  #: tree, digest and what else the leaves have, dealt into ranges (part)
    spans: DataFrame  #: part, tree, start, n, total
    nodes: DataFrame  #: tree, level, idx, digest of all that some range does not know by itself
    tops: DataFrame  #: tree, total, digest
    order: list[str]


def _sorted(table: pa.Table, order: list[str]) -> pa.Table:
    keys = [("tree", "ascending"), *((c, "ascending") for c in order)]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))


def _by_tree(table: pa.Table):
    """(tree, its rows) of a sorted table."""
    names = table.column("tree").to_pylist()
    start = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[start]:
            yield names[start], table.slice(start, i - start)
            start = i


def forest(leaves: DataFrame, order: list[str], rows: int = ROWS) -> Forest:
    """Trees over leaves (tree, digest, the columns of order, and others)."""
    leaves = staged(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    parts = 1 + leaves.count() // rows
    dealt = leaves.repartitionByRange(parts, "tree", *(F.col(c).asc_nulls_first() for c in order), "row")
    dealt = staged(dealt.withColumn("part", F.spark_partition_id().cast("long")), "merkle-parts")
    of_tree = Window.partitionBy("tree")
    spans = dealt.groupBy("part", "tree").agg(F.count("*").alias("n")).select(
        "part", "tree", "n",
        F.coalesce(F.sum("n").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("n").over(of_tree).alias("total"),
    )
    spans = staged(spans, "merkle-spans")

    def fold(mine: pa.Table, places: pa.Table) -> pa.Table:
        at = {p["tree"]: p for p in places.to_pylist()}
        out = []
        for tree, own in _by_tree(_sorted(mine, order)):
            total, part = at[tree]["total"], at[tree]["part"]
            left, _ = folded(own.column("digest").to_pylist(), at[tree]["start"], total)
            out += [(tree, total, level, i, d, part, width(total, level) > 1, True) for (level, i), d in left.items()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), NODE.types)] if out else [pa.array([], t) for t in NODE.types], schema=NODE)

    def join(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        total = found.column("total")[0].as_py()
        nodes = {(n["level"], n["idx"]): n["digest"] for n in found.to_pylist()}
        left, made = merge(nodes, total)
        out = [(tree, total, level, i, d, block, (level, i) in left and width(total, level) > 1, (level, i) in made) for (level, i), d in (left | made).items()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), NODE.types)], schema=NODE)

    leaves = dealt.select("part", "tree", "digest", *(c for c in order if c != "digest"))
    live = staged(leaves.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(fold, NODES), "merkle-fold")
    known = live
    while not live.where("live").isEmpty():
        merged = live.where("live").groupBy("tree", F.expr(f"block div {FAN}").alias("eight")).applyInArrow(join, NODES)
        live = staged(merged, "merkle-merge")
        known = known.unionByName(live.where("new"))
    tops = known.where(F.col("new") & (F.col("idx") == 0) & ~F.col("live")).groupBy("tree", "total").agg(F.max_by("digest", "level").alias("digest"))
    return Forest(dealt, spans, known.select("tree", "level", "idx", "digest"), staged(tops, "merkle-tops"), order)


def asked(f: Forest) -> DataFrame:
    """part, tree, level, idx, digest: what ranges that hold only some of a tree do not know themselves."""

    def run(batches):
        for b in batches:
            out = [(s["part"], s["tree"], level, i) for s in b.to_pylist() for level, i in border(s["start"], s["n"], s["total"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ASKED.types)], schema=ASKED)

    some = f.spans.where("n < total").mapInArrow(run, "part long, tree string, level int, idx long")
    return some.join(f.nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", F.lit(0).cast("long").alias("total"), "digest")


def ways(digests: list[str], start: int, total: int, known: dict[tuple[int, int], str]):
    """For each leaf its siblings up to the tree's top: [(those to the left, those to the right), ...] from below."""
    _, levels = folded(digests, start, total)
    at = lambda level, i: known.get((level, i)) or levels[level][1][i - levels[level][0]]
    height = top(total)
    above: dict[int, tuple] = {0: ()}
    spans = [(start // ARITY**k, (start + len(digests) - 1) // ARITY**k) for k in range(height + 1)]
    for level in range(height - 1, -1, -1):
        wide, below = width(total, level), {}
        for i in range(spans[level][0], spans[level][1] + 1):
            run = i // ARITY * ARITY
            sides = ("".join(at(level, j) for j in range(run, i)), "".join(at(level, j) for j in range(i + 1, min(run + ARITY, wide))))
            below[i] = (sides, above[i // ARITY])  # shared with all below, so a level is one pair a node
        above = below
    for i in range(start, start + len(digests)):
        way, out = above[i], []
        while way:
            out.append(way[0])
            way = way[1]
        yield out


def climb(digest: str, way) -> str:
    for left, right in way:
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def climbed(f: Forest, more: DataFrame, each, schema: str, keep: list[str]) -> DataFrame:
    """each(tree, its rows in the range, its ways, what more says of the tree) -> rows; more: tree, digest."""
    extra = f.spans.join(more, "tree", "left").select("part", "tree", F.lit(-1).alias("level"), F.col("start").alias("idx"), "total", "digest")
    side = extra.unionByName(asked(f))
    order = f.order

    def run(mine: pa.Table, side: pa.Table) -> pa.Table:
        known: dict[str, dict] = {}
        span: dict[str, dict] = {}
        for s in side.to_pylist():
            if s["level"] < 0:
                span[s["tree"]] = s
            else:
                known.setdefault(s["tree"], {})[s["level"], s["idx"]] = s["digest"]
        out = []
        for tree, own in _by_tree(_sorted(mine, order)):
            s = span[tree]
            digests = own.column("digest").to_pylist()
            out += each(tree, own, ways(digests, s["idx"], s["total"], known.get(tree, {})), s["digest"])
        kinds = result.types
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], schema=result)

    result = to_arrow_schema(StructType.fromDDL(schema))
    leaves = f.leaves.select("part", "tree", "digest", *(c for c in dict.fromkeys([*f.order, *keep]) if c != "digest"))
    return leaves.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(run, schema)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """SHA-256 (lowercase hex) over fields with their lengths."""
    return F.sha2(F.concat(*map(field, values)), 256)


def manifest(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    docs may have a column ``claimed``, the leaf of the row as it is found now; by default
    rows are as they were.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    own = leaf(*map(F.col, FIELDS))
    claimed = F.col("claimed") if "claimed" in docs.columns else own
    leaves = docs.select(source.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"), claimed.alias("claimed"))
    of_docs = forest(leaves, ["doc_id", "digest", "claimed"], rows)
    tops = of_docs.tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    of_sources = forest(tops, ["source"], rows)

    def upper(tree, own, found, root):
        for source, digest, way in zip(own.column("source").to_pylist(), own.column("digest").to_pylist(), found):
            yield source, "/".join([digest, root, *(f"{left}:{right}" for left, right in way)])

    ends = climbed(of_sources, of_sources.tops.select("tree", "digest"), upper, "tree string, digest string", ["source"])

    def judged(tree, own, found, rest):
        subroot, root, *last = rest.split("/")
        last = [tuple(x.split(":")) for x in last]
        for doc_id, digest, claim, way in zip(*(own.column(c).to_pylist() for c in ("doc_id", "digest", "claimed")), found):
            way = way + last
            proof = sha256("".join(left + right for left, right in way).encode()).hexdigest()
            got = climb(claim, way)
            yield doc_id, digest, subroot, root, proof, got, got == root

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return climbed(of_docs, ends, judged, schema, ["claimed"])


def without_newlines(docs: DataFrame) -> DataFrame:
    """docs with ``claimed``, the leaf after tampering: rows with an even CRC-32 of doc_id lose the newlines of their text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))
    return docs.select(*FIELDS).withColumn("claimed", leaf(*(F.col(c) for c in FIELDS[:-1]), text))


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest of docs, with proofs folded from what tampering leaves."""
    return manifest(without_newlines(docs))

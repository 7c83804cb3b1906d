"""Approximate nearest neighbours by a hierarchical k-means tree (operator 2).

Grow: all vectors of one length begin in one leaf.  A leaf of more than ``CAP`` vectors is
split by a subtree: spherical k-means, level by level, on at most about ``SAMPLE`` of its
vectors, fitted in one task.  All its vectors descend, and the leaves that are still too large
are split again, so leaves keep their size and their number grows with the corpus.  A leaf
that k-means can't split (copies of few directions) stays as it is.  The subtrees are a table.

Of equal vectors the k + 1 smallest vec_ids are indexed, each k times at most: ties go to
smaller ids, so no further ones can be among anyone's k nearest.  A vector that a third of all
rows share is a handful of entries.

Search: a query takes leaves best bin first.  In each subtree a priority queue over its nodes,
by cosine to their centres, gives them in order; over all subtrees the best ones stay, level by
level.  How many leaves are visited is calibrated: for at most ``CALIBRATE`` of the queries the
true neighbours are found by a scan of all vectors, and visits are widened until ``RECALL``
of these lie in visited leaves, if need be up to all leaves.  A query goes on beyond that while
the leaves that it visits hold no more than k vectors.  Leaves, a large one in blocks, lie on
shelves of some ``BLOCK`` vectors; a shelf and parts of its askers meet, both of bounded size
whatever leaf is popular.  There a query's vectors are those of its own leaves; each meeting
gives its best k by exact cosines in double precision on the original vectors (scaled by a
power of two, which changes no digit), and the best k of these are the answer.

Vectors that are null, zero, or have null or non-finite components take no part.  Vectors of
different lengths are never compared.  Rows that repeat a vec_id are candidates of their own,
but no row finds one of its own vec_id; equal rows ask once.  Ties go to the smaller vec_id.
An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import batch, staged

CAP, SAMPLE, LEAF, FANOUT, RECALL, BLOCK, PART, DEAL, CALIBRATE = 1024, 8192, 32, 16, 0.96, 4096, 2048, 50_000, 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floats as they are, else array<double>) of the rows that take part."""
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(ok & F.exists("v", lambda x: x != 0))


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that k + 1 smaller ids with the same vector, or k equal rows, come before."""
    equal = Window.partitionBy("v", "vec_id").orderBy("vec_id")
    alike = Window.partitionBy("v").orderBy("vec_id")
    rows = rows.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= k)
    return rows.withColumn("_n", F.dense_rank().over(alike)).where(F.col("_n") <= k + 1).drop("_n")


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that products neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Nodes in arrays: centre, and children; leaves are numbered."""

    def __init__(self, x: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, children, self.leaf_of, self.leaves = [np.zeros(x.shape[1])], [[]], {}, 0
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = self._parts(x, rows, fanout, rng) if len(rows) > leaf else []
            if len(parts) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for centre, part in parts:
                children[node].append(len(centres))
                todo.append((len(centres), part))
                centres.append(centre)
                children.append([])
        self.centres = np.array(centres)
        self.children = [np.array(c, np.int64) for c in children]

    @staticmethod
    def _parts(x, rows, fanout, rng):
        own = x[rows]
        k = min(fanout, len(rows))
        centres = own[rng.choice(len(rows), k, replace=False)]
        for _ in range(8):
            near = np.argmax(own @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, own)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        near = np.argmax(own @ centres.T, axis=1)
        return [(centres[j], rows[near == j]) for j in range(k) if (near == j).any()]

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the best child at every level."""
        at = np.zeros(len(x), np.int64)
        out = np.full(len(x), -1, np.int64)
        while len(active := np.flatnonzero(out < 0)):
            for node in np.unique(at[active]):
                rows = active[at[active] == node]
                kids = self.children[node]
                if len(kids):
                    at[rows] = kids[np.argmax(x[rows] @ self.centres[kids].T, axis=1)]
                else:
                    out[rows] = self.leaf_of[node]
        return out

    def visits(self, q: np.ndarray):
        """(leaf, cosine to its centre), best bin first."""
        queue = [(-2.0, 0)]
        while queue:
            score, node = heapq.heappop(queue)
            kids = self.children[node]
            if len(kids):
                for s, kid in zip((self.centres[kids] @ q).tolist(), kids.tolist()):
                    heapq.heappush(queue, (-s, kid))
            else:
                yield self.leaf_of[node], -score


def _child(leaf: int, n: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{leaf}/{n}".encode()) - (1 << 63)


def _matrix(col) -> np.ndarray:
    """The vectors of a column, all of one length."""
    flat = np.asarray((col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(col), -1)


def _shares(n: str, most: int) -> Column:
    """In how many parts n rows go, of ``most`` or so each."""
    return F.ceil(F.col(n) / most).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _dealt(rows: DataFrame, sizes: DataFrame, by: str, most: int) -> DataFrame:
    """rows with ``part``: those of a leaf go to as many parts as its n asks for, by a hash of ``by``."""
    return rows.join(sizes.select("leaf", "n"), "leaf").withColumn("part", F.pmod(F.xxhash64(by), _shares("n", most)).cast("int")).drop("n")


class Index:
    """Vectors (row, vec_id, v, leaf), and the subtrees (leaf, tree) of each level."""

    def __init__(self, rows: DataFrame, cap: int = CAP, sample: int = SAMPLE):
        self.kind = dict(rows.dtypes)["v"]
        self.numbers = pa.list_(pa.float32() if self.kind == "array<float>" else pa.float64())
        vectors = staged(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
        self.vectors = vectors.withColumn("leaf", F.size("v").cast("long")).withColumn("open", F.lit(True))
        self.levels: list[DataFrame] = []
        while True:
            large = staged(self.vectors.where("open").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > cap), "large")
            if not large.limit(1).count():
                break
            self._split(large, sample)
        self.sizes = staged(self.vectors.groupBy("leaf").agg(F.count("*").alias("n")), "sizes")

    def _split(self, large: DataFrame, sample: int) -> None:
        trees_schema = pa.schema([("leaf", pa.int64()), ("tree", pa.binary())])
        numbers = self.numbers
        out = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", numbers), ("leaf", pa.int64()), ("open", pa.bool_())])

        def fit(key, group):
            group = group.sort_by("row")
            tree = Tree(unit(_matrix(group.column("v"))))
            return pa.table({"leaf": [key[0].as_py()], "tree": [pickle.dumps(tree)]}, schema=trees_schema)

        def descend(key, group, trees):
            if not group.num_rows:
                return out.empty_table()
            leaf, to, again = key[0].as_py(), np.full(group.num_rows, key[0].as_py()), False
            tree = pickle.loads(trees.column("tree")[0].as_py()) if trees.num_rows else None
            if tree is not None and tree.leaves > 1:
                ids = np.array([_child(leaf, n) for n in range(tree.leaves)], np.int64)
                to, again = ids[tree.descend(unit(_matrix(group.column("v"))))], True
            return pa.table([*(group.column(c) for c in ("row", "vec_id", "v")), pa.array(to), pa.array(np.full(len(to), again))], schema=out)

        known = self.vectors.join(large, "leaf")
        chosen = known.where(F.pmod(F.xxhash64("row", F.lit(1)), _shares("n", sample)) == 0).select("leaf", "row", "v")
        trees = staged(chosen.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"), "trees")
        self.levels.append(trees)
        rows = _dealt(self.vectors, large, "row", DEAL).select("leaf", "part", "row", "vec_id", "v")
        # A leaf without a subtree (its sample came out empty) stays whole, as one that can't be split.
        repeated = trees.join(large, "leaf").select("leaf", "tree", _each(_shares("n", DEAL)).alias("part"))
        moved = rows.groupBy("leaf", "part").cogroup(repeated.groupBy("leaf", "part")).applyInArrow(descend, f"row long, vec_id long, v {self.kind}, leaf long, open boolean")
        stay = self.vectors.join(large.select("leaf"), "leaf", "left_anti").select("row", "vec_id", "v", "leaf", "open")
        self.vectors = staged(moved.unionByName(stay), "leaves")

    def bins(self, asked: DataFrame, most: int) -> DataFrame:
        """ask, leaf, place: leaves for each row of asked (ask, q), nearest centre first.

        From each subtree come the ``most`` leaves that a priority queue over its nodes gives first.
        """
        front = asked.select("ask", F.size("q").cast("long").alias("leaf"), F.lit(0.0).alias("score"))
        out = pa.schema([("ask", pa.int64()), ("leaf", pa.int64()), ("score", pa.float64())])

        def expand(key, group, trees):
            if not group.num_rows or not trees.num_rows:
                return out.empty_table()
            tree, leaf = pickle.loads(trees.column("tree")[0].as_py()), key[0].as_py()
            ids = np.array([_child(leaf, n) for n in range(tree.leaves)], np.int64) if tree.leaves > 1 else np.array([leaf])
            asks, leaves, scores = [], [], []
            for ask, q in zip(group.column("ask").to_pylist(), unit(_matrix(group.column("q")))):
                for (n, score), _ in zip(tree.visits(q), range(most)):
                    asks.append(ask)
                    leaves.append(ids[n])
                    scores.append(score)
            return pa.table([pa.array(asks, pa.int64()), pa.array(leaves, pa.int64()), pa.array(scores, pa.float64())], schema=out)

        best = Window.partitionBy("ask").orderBy(F.desc("score"), "leaf")
        for trees in self.levels:
            front = staged(front, "front")
            inner = front.join(trees.select("leaf"), "leaf")
            many = staged(inner.groupBy("leaf").agg(F.count("*").alias("n")), "many")
            repeated = trees.join(many, "leaf").select("leaf", "tree", _each(_shares("n", PART)).alias("part"))
            dealt = _dealt(inner, many, "ask", PART).join(asked.select("ask", "q"), "ask").select("leaf", "part", "ask", "q")
            grown = dealt.groupBy("leaf", "part").cogroup(repeated.groupBy("leaf", "part")).applyInArrow(expand, "ask long, leaf long, score double")
            front = front.join(trees.select("leaf"), "leaf", "left_anti").select("ask", "leaf", "score").unionByName(grown)
            front = front.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).drop("place")
        # Leaves that no vector came to, and roots that have none, hold no answer.
        return front.join(self.sizes.select("leaf"), "leaf").select("ask", "leaf", F.row_number().over(best).alias("place"))

    def scan(self, asked: list, k: int) -> DataFrame:
        """ask, leaf: where the true k nearest of a few rows of asked (ask, query_id, q) are, by a scan of all vectors."""
        schema = pa.schema([("ask", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64()), ("leaf", pa.int64())])
        by_length: dict[int, tuple] = {}
        for n in {len(r["q"]) for r in asked}:
            own = [r for r in asked if len(r["q"]) == n]
            by_length[n] = ([r["ask"] for r in own], np.array([r["query_id"] for r in own]), unit(np.array([r["q"] for r in own], np.float64)))

        def run(batches):
            best: dict[int, list] = {}
            for b in batches:
                lengths = np.diff(b.column("v").offsets.to_numpy())
                for n in np.unique(lengths).tolist():
                    if n not in by_length:
                        continue
                    part = b.filter(pa.array(lengths == n))
                    asks, own, q = by_length[n]
                    ids, leaves = part.column("vec_id").to_numpy(), part.column("leaf").to_numpy()
                    score = q @ unit(_matrix(part.column("v"))).T
                    score[own[:, None] == ids] = -3
                    for i, ask in enumerate(asks):
                        top = np.argpartition(-score[i], min(k, len(ids)) - 1)[:k]
                        rows = best.get(ask, []) + [(s, v, f) for s, v, f in zip(score[i][top].tolist(), ids[top].tolist(), leaves[top].tolist()) if s > -3]
                        best[ask] = sorted(rows, key=lambda r: (-r[0], r[1]))[:k]
            rows = [(ask, *r) for ask, found in best.items() for r in found]
            yield batch({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)

        found = self.vectors.select("vec_id", "v", "leaf").mapInArrow(run, "ask long, score double, vec_id long, leaf long")
        order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("ask", "leaf")

    def calibrate(self, asked: DataFrame, k: int, recall: float, queries: int = CALIBRATE) -> tuple[int, int]:
        """(leaves to visit, leaves to take from each queue) so that this share of the true neighbours is met."""
        most = max(64, k + 2)
        if not self.levels:
            return 1, most
        chosen = asked.orderBy(F.xxhash64("ask"), "ask").limit(queries)
        rows = chosen.collect()  # a fixed number
        true = staged(self.scan(rows, k), "true")
        leaves = self.sizes.count()
        few = asked.sparkSession.createDataFrame(rows, chosen.schema)
        while True:
            met = true.join(self.bins(few, most).select("ask", "leaf", "place"), ["ask", "leaf"], "left").select("place").collect()
            places = sorted(math.inf if r["place"] is None else r["place"] for r in met)
            needed = places[max(0, math.ceil(recall * len(places)) - 1)] if places else 1
            if needed < math.inf or most >= leaves:
                return int(min(needed, leaves)), most
            most += most // 2


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL, cap: int = CAP, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest other vectors.

    Both tables have vec_id and embedding.
    """
    index = Index(distinct_enough(usable(vectors), k), cap, sample)
    numbers = index.numbers
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), F.col("v").cast(index.kind).alias("q")).distinct()
    asked = staged(asked.select(F.monotonically_increasing_id().alias("ask"), "query_id", "q"), "asked")
    wide, most = index.calibrate(asked, k, recall)
    # Each leaf holds a vector at least, so k + 2 leaves hold k others, if there are so many.
    bins = index.bins(asked.select("ask", "q"), most).join(index.sizes, "leaf")
    before = Window.partitionBy("ask").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    routed = bins.withColumn("met", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("place") <= wide) | (F.col("met") <= k))
    routed = staged(routed.select("ask", "leaf", _each(_shares("n", BLOCK)).alias("block")), "routed")
    # Blocks of leaves share shelves of about BLOCK vectors, so that a query gets k answers a shelf, not a leaf.
    total = index.sizes.agg(F.sum("n")).first()[0] or 1
    shelf = F.pmod(F.xxhash64("leaf", "block"), F.lit(-(-total // BLOCK)))
    asks = routed.groupBy("ask", shelf.alias("shelf")).agg(F.collect_list("leaf").alias("leaves"))
    asks = staged(asks, "asks")
    parts = _shares("m", PART)
    many = staged(asks.groupBy("shelf").agg(F.count("*").alias("m")), "askers")
    held = index.vectors.join(index.sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("row"), _shares("n", BLOCK)).cast("int"))
    held = held.select("leaf", shelf.alias("shelf"), "vec_id", "v").join(many, "shelf").select("shelf", _each(parts).alias("part"), "leaf", "vec_id", "v")
    asks = asks.join(many, "shelf").select("shelf", F.pmod(F.xxhash64("ask"), parts).cast("int").alias("part"), "ask", "leaves")
    asks = asks.join(asked, "ask").select("shelf", "part", "ask", "query_id", "q", "leaves")
    out = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(key, rows, own):
        if not rows.num_rows or not own.num_rows:
            return out.empty_table()
        rows = rows.sort_by("leaf")
        leaf = rows.column("leaf").to_numpy()
        begin = np.flatnonzero(np.diff(leaf, prepend=~leaf[:1]))
        ranges = {n: (b, e) for n, b, e in zip(leaf[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(leaf)])}
        # A shelf may hold vectors of several lengths; those of a leaf have one.
        sizes = np.diff(rows.column("v").combine_chunks().offsets.to_numpy())
        ids, spaces, place = rows.column("vec_id").to_numpy(), {}, np.zeros(len(leaf), np.int64)
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            v = scaled(_matrix(rows.column("v").take(pa.array(at))))
            size = np.sqrt((v * v).sum(axis=1))
            spaces[n], place[at] = (v, size, v / size[:, None]), np.arange(len(at))
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for ask, qid, q, leaves in zip(*(own.column(c).to_pylist() for c in ("ask", "query_id", "q", "leaves"))):
            near = np.concatenate([np.arange(*ranges.get(n, (0, 0))) for n in leaves])
            near = near[ids[near] != qid]
            if not len(near):
                continue
            v, size, plain = spaces[len(q)]
            one = scaled(np.array([q], np.float64))[0]
            length = math.sqrt((one * one).sum())
            rough = plain[place[near]] @ (one / length)
            if len(near) > k:
                near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
            at = place[near]
            score = (v[at] * one).sum(axis=1) / (size[at] * length)
            best = np.lexsort((ids[near], -score))[:k]
            got.append((np.full(len(best), ask), np.full(len(best), qid), ids[near][best], score[best]))
        return pa.table([np.concatenate(x) for x in zip(*got)], schema=out)

    met = held.groupBy("shelf", "part").cogroup(asks.groupBy("shelf", "part"))
    found = met.applyInArrow(meet, "ask long, query_id long, vec_id long, score double")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by 50, against all rows."""
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k)

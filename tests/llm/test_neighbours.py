import numpy as np
import pytest

from inkveil.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, leaf int")


def brute(rows, k):
    ok = [(i, np.float32(v).astype(float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for q, a in ok:
        if q % 50 == 0:
            near = sorted((-(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for i, b in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 8))
    x[100:400] = x[100]  # a third are copies: ties
    odd = [(5000, None), (5050, [0.0] * 8), (5100, [1.0] * 7 + [None]), (5150, [float("nan")] + [1.0] * 7), (5200, [float("inf")] + [1.0] * 7), (5250, [1.0, 2.0])]
    return list(enumerate(x.tolist())) + odd


def test_recall_and_scores(spark, rows):
    got = neighbours.every_fiftieth(table(spark, rows)).orderBy("query_id", "rank").collect()
    want = brute(rows, 5)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(want)
    hits = sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    # Among copies the smallest vec_ids come first.
    assert [i for i, _ in by[150]] == [100, 101, 102, 103, 104]
    for q in want:
        exact = dict(want[q])
        assert all(abs(exact[i] - s) < 1e-9 for i, s in by[q] if i in exact)
        assert by[q] == sorted(by[q], key=lambda x: (-x[1], x[0]))


def test_fewer_than_k_and_none(spark):
    few = table(spark, [(0, [1, 0]), (7, [1, 1]), (50, [0, 1])])
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.every_fiftieth(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert neighbours.every_fiftieth(few.where("false")).count() == 0
    assert neighbours.every_fiftieth(table(spark, [(0, [1, 0])])).count() == 0


def test_tree_visits_every_leaf_once():
    x = neighbours.unit(np.random.default_rng(0).normal(size=(600, 5)))
    tree = neighbours.Tree(x)
    order = list(tree.visits(x[0]))
    assert sorted(n for n, _ in order) == list(range(tree.leaves))
    assert neighbours.Tree(np.tile(x[:1], (300, 1))).leaves == 1


def answers(df):
    by = {}
    for r in df.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return by


def test_leaves_are_split_again(spark, rows):
    own = table(spark, rows)
    index = neighbours.Index(neighbours.distinct_enough(neighbours.usable(own), 5), cap=100, sample=400)
    assert len(index.levels) >= 2
    counts = {r["leaf"]: r["n"] for r in index.sizes.collect()}
    assert sum(counts.values()) == 1206 + 1 and max(counts.values()) <= 100  # 300 copies are six entries
    got, want = answers(neighbours.search(own, own.where("vec_id % 50 = 0"), cap=100, sample=400)), brute(rows, 5)
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_half_of_all_in_one_leaf(spark):
    rng = np.random.default_rng(4)
    close = np.r_[np.ones(8)] + 1e-7 * rng.normal(size=(900, 8))
    rows = list(enumerate(np.concatenate([close, rng.normal(size=(900, 8))]).tolist()))
    got, want = answers(neighbours.search(table(spark, rows), table(spark, rows).where("vec_id % 50 = 0"), cap=200, sample=300)), brute(rows, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    # Half of them are as near to each other as rounding tells apart, so what counts is the score.
    assert sum(s >= want[q][4][1] - 1e-9 for q in want for _, s in got[q]) >= 0.9 * 5 * len(want)


def test_large_and_small_numbers(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1e-200, 1e-200]), (50, [0.0, 5e-320]), (3, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.5])], "vec_id long, embedding array<double>")
    got = answers(neighbours.every_fiftieth(df))
    assert [i for i, _ in got[0]] == [1, 2, 50] and [i for i, _ in got[50]] == [2, 1, 0]
    assert np.allclose([s for _, s in got[0]], [1 / np.hypot(1, 0.1), 1 / np.sqrt(2), 0])
    assert [i for i, _ in got[100]] == [3]  # lengths never meet


def test_repeated_rows(spark):
    df = table(spark, [(0, [1, 0])] * 9 + [(7, [1, 0])] * 9 + [(8, [1, 0]), (50, [0, 1])])
    got = answers(neighbours.every_fiftieth(df))
    assert [i for i, _ in got[0]] == [7] * 5 and [i for i, _ in got[50]] == [0] * 5

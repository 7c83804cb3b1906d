import random
import re
from collections import Counter

import pytest
from inkveil.llm import mixing

SCHEMA = "doc_id long, source string, text string, size long, key string, class int, copies long, row string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 3, "k", 4, 5, "r") for r in rows], SCHEMA)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Reshares what is over until nothing is, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                target[s], open_ = 2.0 * sizes[s], open_ - {s}
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(900):
        source = rng.choice(["hot", "hot", "hot", "a", "b", "é", "z", None, ""]) if i else "lonely"
        out.append((i, source, " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(1.1) * 8) % 4000))))
    return [*out, *[(5000 + i, "hot", "one two three") for i in range(300)], *[(7, "a", "x y")] * 9, (8001, "a", None), (8002, "b", " \n\t"), (None, "b", "no id"), (8003, "big", "w " * 9000)]


def check(rows, got):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += size(text)
    want, source_of, taken = brute_targets(sizes), {}, Counter()
    for doc_id, source, text in rows:
        source_of[doc_id, size(text)] = source
    assert sorted((str(g.doc_id), g.size) for g in got) == sorted((str(i), size(t)) for i, _, t in rows)
    largest = Counter()
    for g in got:
        s = source_of[g.doc_id, g.size]
        assert g.source_size == sizes[s] and abs(g.target - want[s]) <= 1e-6 * (1 + want[s])
        assert g.taken <= 2 * g.size and (g.size == 0 or g.taken % g.size == 0)
        taken[s] += g.taken
        largest[s] = max(largest[s], g.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.2 * largest[s] + 1e-6, s


def test_targets_and_what_is_taken(spark, rows):
    got = mixing.mix_sizes(docs(spark, rows)).collect()
    check(rows, got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sizes(docs(spark, rows).repartition(5)).collect()))


def test_without_broadcast_it_is_the_same(spark, rows):
    some = sorted(map(repr, mixing.mix_sizes(docs(spark, rows)).collect()))
    assert sorted(map(repr, mixing.mix_sizes(docs(spark, rows), most=0).collect())) == some


def test_many_ranges_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 10)
    rows = [(i, f"s{i % 57}" if i % 57 else None, "w " * (i % 23)) for i in range(400)]
    check(rows, mixing.mix_sizes(docs(spark, rows)).collect())


def test_the_mix_holds_whole_rows(spark, rows):
    got = Counter(tuple(r) for r in mixing.mix(docs(spark, rows)).collect())
    taken = Counter()
    for r in mixing.mix_sizes(docs(spark, rows)).where("size > 0").collect():
        taken[r.doc_id] += r.taken
    words = Counter()
    for r, n in got.items():
        words[r[0]] += n * size(r[2])
    assert +words == +taken
    assert set(got) <= {(*r, 3, "k", 4, 5, "r") for r in rows}


def test_other_choices(spark, rows):
    got = mixing.mix_sizes(docs(spark, rows), weights=(1,), share=0.5, cap=1.0).collect()
    assert all(g.taken <= g.size for g in got)
    assert abs(sum({g.source_size: g.target for g in got}.values()) - 0.5 * sum(g.size for g in got)) < 1


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "s", "")], [(2, "s", "a b c")]])
def test_small_tables(spark, rows):
    got = mixing.mix_sizes(docs(spark, rows)).collect()
    assert [(g.doc_id, g.size) for g in got] == [(i, size(t)) for i, _, t in rows]
    check(rows, got)


def test_no_python_in_the_plan(spark, rows, capsys):
    mixing.mix_sizes(docs(spark, rows)).explain()
    assert not re.search("Python|Arrow|Pandas|MapIn|ExternalRDD", capsys.readouterr().out)

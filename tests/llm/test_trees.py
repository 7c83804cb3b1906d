"""The suffix trees of operator 4 against their definition."""

import random

from inkveil.llm import trees
from pyspark.sql import functions as F


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def brute_nodes(leaves):
    """Every distinct prefix that two leaves have and at which they part (or one ends): the inner nodes below the root."""
    prefixes = {tuple(a[: shared(a, b)]) for i, a in enumerate(leaves) for b in leaves[i + 1 :]} - {()}
    out = set()
    for p in prefixes:
        below = [i for i, x in enumerate(leaves) if tuple(x[: len(p)]) == p]
        above = max((len(q) for q in prefixes if len(q) < len(p) and p[: len(q)] == q), default=0)
        out.add((len(p), below[0], below[-1], above))
        assert below == list(range(below[0], below[-1] + 1))
    return out


def test_nodes():
    rng = random.Random(3)
    for _ in range(200):
        words = ["a", "b", "ab", "a\x01", "é"][: rng.randrange(1, 6)]
        leaves = [b"".join(rng.choice(words).encode() + b" " for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 14))]
        leaves.sort()
        lists = [x.split(b" ")[:-1] for x in leaves]
        common = [trees.words_in_common(a, b) for a, b in zip(leaves, leaves[1:])]
        assert common == [shared(a, b) for a, b in zip(lists, lists[1:])]
        assert sorted(trees.nodes(common)) == sorted(brute_nodes(lists))


def test_subtree_finds_what_windows_say():
    rng = random.Random(4)
    for width in (1, 2, 3, 13):
        for _ in range(60):
            rows, at = [], 0
            for chunk in range(rng.randrange(1, 9)):
                text = b" ".join(rng.choice([b"x", b"y", b"xy"]) for _ in range(rng.randrange(width, width + 6)))
                rows.append((text, rng.randrange(4), chunk, at))
                at += 7
            least, want = {}, set()
            windows = [(tuple(t.split()[i : i + width]), d, c, a + i) for t, d, c, a in rows for i in range(len(t.split()) - width + 1)]
            for w, d, _, _ in windows:
                least[w] = min(d, least.get(w, d))
            want = sorted((c, a) for w, d, c, a in windows if d > least[w])
            assert sorted(trees.subtree(rows, width)) == want


def test_crowded_anchors_give_the_same(spark, make, texts, monkeypatch):
    from inkveil.llm import substrings

    docs = make(texts * 2, ids=range(2 * len(texts)))
    some = sorted(map(tuple, substrings.dedup_words(docs).collect()))
    monkeypatch.setattr(trees, "HELD", 1)
    assert sorted(map(tuple, substrings.dedup_words(docs).collect())) == some


def test_counted(spark):
    rows = [(b"one", 5, 1, 0), (b"one", 5, 2, 3), (b"one", 4, 1, 9), (b"two", 1, 1, 2), *[(b"hot", i, i % 3, i) for i in range(500)]]
    leaves = spark.createDataFrame(rows, "suffix binary, doc long, chunk long, at int")
    got = {}
    for r in trees.counted(leaves).collect():
        places = [int.from_bytes(r["found"][i : i + 4], "little") for i in range(0, len(r["found"]), 4)]
        got.setdefault(r["chunk"], []).extend(places)
    want = {}
    for suffix, doc, chunk, at in rows:
        if doc > min(d for s, d, *_ in rows if s == suffix):
            want.setdefault(chunk, []).append(at)
    assert {c: sorted(p) for c, p in got.items()} == {c: sorted(p) for c, p in want.items()}
    assert trees.counted(leaves.where(F.lit(False))).count() == 0


def test_neighbourhoods_that_meet_none_are_passed_over():
    import pyarrow as pa

    for anchors, want in (("", ""), ("a", "a"), ("ab", "ab"), ("abc", "ac"), ("aabc", "aac"), ("abbc", "abbc"), ("abcdde", "adde"), ("aaaa", "aaaa")):
        b = pa.RecordBatch.from_pydict({"anchor": [x.encode() for x in anchors]}, schema=pa.schema([("anchor", pa.binary())]))
        assert b"".join(trees.met(b).column("anchor").to_pylist()).decode() == want


def test_words_are_coded_many_at_a_time():
    import cProfile
    import pstats

    import pyarrow as pa

    from inkveil.llm import repeats, substrings

    docs = [" ".join(f"w{i}-{j}" for j in range(500)) for i in range(40)]
    data = repeats.pack_rows(pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": docs}))
    profile = cProfile.Profile()
    profile.enable()
    repeats.Chunk(data, substrings.WORD_UNIT, True)
    profile.disable()
    assert pstats.Stats(profile).total_calls < 2000  # of 20,000 words


def test_word_codes(monkeypatch):
    from inkveil.llm import substrings

    monkeypatch.setattr(substrings, "BLOCK", 50)
    rng = random.Random(6)
    long = ["q" * 51, "q" * 60, "q" * 101, "r" * 400, "é" * 49]
    words = ["a", "aa", "b", "ab", "ba", "é", "東京", "x\x00", "\x1c", "\x85", "\xa0", *long]
    texts = ["", " ", "\n\t", *[rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice(" \t\n\v\f\r") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))) for _ in range(150)]]
    texts = [t.encode() for t in texts]
    known = {}
    for text, codes in zip(texts, substrings.codes_of_words(texts), strict=True):
        assert codes.tolist() == substrings.word_codes(text).tolist()
        for word, code in zip(text.split(), codes.tolist(), strict=True):
            assert known.setdefault(word, code) == code
    assert set(known) == {w.encode() for w in words} and len(set(known.values())) == len(known)


def test_anchors_are_those_of_suffixes(texts, monkeypatch):
    import numpy as np

    from inkveil.llm import repeats, substrings, suffixes

    monkeypatch.setattr(repeats, "SEGMENT", 500)
    unit, rng = substrings.WORD_UNIT, np.random.default_rng(7)
    found = 0
    for seg in repeats.segments(substrings.codes_of_words([(t or "").encode() for t in texts]), unit.width):
        at = np.flatnonzero(repeats._inside(seg, unit.width, len(seg.codes)))
        at = at[rng.random(len(at)) < 0.9]
        piece, first, n, before = trees.anchored(seg, at, unit)
        assert list(zip(first.tolist(), (first + n - 1).tolist(), (first + before).tolist())) == [x[:3] for x in suffixes.anchored(seg, at, unit)]
        assert (seg.start[piece] <= first).all() and (first + n - 1 < seg.start[piece] + seg.windows[piece]).all()
        found += len(first)
    assert found > 100

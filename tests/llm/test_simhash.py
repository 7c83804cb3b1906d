import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from inkveil.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_fingerprints(spark, make, texts):
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(make(texts)).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    # Spark's own xxhash64 has the same seed.
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1)
    assert h == xxhash.xxh64_intdigest(b"a b c", 42)


def fingerprints_with_a_crowd():
    rng = random.Random(4)
    base = rng.getrandbits(64)
    crowd = {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}  # one dense group
    chain = [rng.getrandbits(64)]
    for _ in range(40):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    apart = {rng.getrandbits(64) for _ in range(200)}
    three = {base ^ 0b111 << 40}
    return crowd | set(chain) | apart | three | {0, 1, 7, 2**63}


def test_links_are_whole(spark):
    fps = fingerprints_with_a_crowd()
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for light in (64, 8, 10_000):
        rows = simhash.components(simhash.links(df, light=light)).collect()
        got = {f: signed(f) for f in fps} | {r["node"] & (2**64 - 1): r["root"] for r in rows}
        want = brute_components(fps)
        parts = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
        assert parts(got) == parts(want)


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}
    assert simhash.components(chain.where("false")).count() == 0


def test_query(make, texts):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(make(texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    comp = brute_components(set(fps.values()))
    for i in fps:
        assert rows[i]["fingerprint"] == format(fps[i], "016x")
        assert rows[i]["component_id"] == min(j for j in fps if comp[fps[j]] == comp[fps[i]])
    assert simhash.near_duplicates(make(["x"]).where("false")).count() == 0


def test_keep_first(make, texts):
    docs = make([*texts, "one more text", "one more text", "one more text", None], [*range(len(texts)), 900, 900, None, None])
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 900 in ids and 0 in ids and None not in ids
    assert not {20, 21, 27} & set(ids)


def test_masks():
    ms = simhash.masks()
    assert len(ms) == 10 and all(36 <= (m & (2**64 - 1)).bit_count() <= 39 for m in ms)
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))
        assert any(a & m == b & m for m in ms)

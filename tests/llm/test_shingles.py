import random

import corpus_pipeline as C
from pyspark.sql import functions as F

from inkveil.llm import common, shingles, simhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_firsts(texts):
    """The ids that stay: the least of each component of pairs with Jaccard similarity >= 0.8."""
    sets = {i: brute_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(texts)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in texts}


def near_copies():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    out = []
    for _ in range(40):
        words = prose(rng.randrange(40, 300))
        out.append(words)
        for changes in (1, 2, 3, 6):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(copy)
    base = prose(200)
    out += [base[:k] + [f"own{k}"] + base[k + 1 :] for k in range(0, 180, 2)]  # a crowd
    star = prose(60)
    out.append(star)  # like every one of the following, which are not like each other
    for k in range(80):
        copy = list(star)
        for i in rng.sample(range(60), 2 if k % 3 else 3):
            copy[i] = f"star{rng.randrange(10**6)}"
        out.append(copy)
    out += [star[: 60 - k] for k in range(1, 25)] + [star[k:] for k in range(1, 25)]  # cut short
    return [" ".join(w) for w in out]


def test_stage_keeps_what_brute_force_keeps(spark, make, texts):
    own = dict(enumerate([*texts, *near_copies()]))
    docs = make(list(own.values()))
    stage = dict(C.STAGES)["SimHash near-dedup"]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(brute_firsts(own))
    # Crowds link as small buckets do.
    for light in (2, 16):
        rows = shingles.groups(docs, light).collect()
        assert {r["doc_id"] for r in rows if r["doc_id"] == r["component_id"]} == brute_firsts(own)


def test_recall_on_documents(spark, small):
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    own = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in shingles.keep_first(docs).collect()} == brute_firsts(own)


def test_ids_that_repeat_or_lack(make):
    docs = make(["one more text", "one more text", "other", None, ""], [900, 900, None, 4, 3])
    assert sorted(((r["doc_id"], r["text"]) for r in shingles.keep_first(docs).collect()), key=repr) == [(3, ""), (900, "one more text"), (None, "other")]
    assert shingles.keep_first(docs.where("false")).count() == 0


def test_fingerprints_alone_find_near_pairs(spark, make, texts):
    """Without minimum hashes, all similar pairs of fingerprints at most three bits apart are still linked."""
    own = [*texts, *near_copies()]
    docs = make(own)
    rows = [r for r in shingles.sketches(docs).collect() if r["n"] > 0]
    for light in (64, 4):
        alone = shingles.sketches(docs).groupBy("key").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "bands")))
        lone = F.transform(F.sequence(F.lit(0), F.lit(shingles.BANDS - 1)), lambda i: F.xxhash64("key", i))
        alone = alone.withColumn("bands", F.when(F.size("bands") > 0, F.concat(lone, F.slice("bands", shingles.BANDS + 1, 99))).otherwise(F.col("bands")))
        root = {r["node"]: r["root"] for r in simhash.components(shingles.links(docs, common.staged(alone, "alone"), light)).collect()}
        near = 0
        for i, a in enumerate(rows):
            for b in rows[:i]:
                if a["key"] != b["key"] and ((a["fp"] ^ b["fp"]) % (1 << 64)).bit_count() <= shingles.NEAR:
                    x, y = brute_set(own[a["doc_id"]]), brute_set(own[b["doc_id"]])
                    if 5 * len(x & y) >= 4 * len(x | y):
                        near += 1
                        assert root.get(a["key"], a["key"]) == root.get(b["key"], b["key"])
        assert near > 20

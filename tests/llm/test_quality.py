import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import quality as Q


@pytest.fixture(scope="module")
def labelled(spark, make):
    rng = random.Random(3)
    words = ["thing", "of", "the", "and", "reader", "water", "under", "small"]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 80))) + "."
    bad = lambda: " ".join((w := rng.choice(words)) + rng.choice(["***", "&&&", "!!"]) for _ in range(rng.randrange(5, 80)))
    texts = [good() if i % 3 else bad() for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(900) if i % 7] + [(3, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    return make(texts + [None, "", "thing " * 20_000], [*range(900), 1000, 1001, 1002]), labels


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).collect()}
    assert len(rows) == 903 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    held = [r for i, r in rows.items() if r["held_out"] and i < 900]
    assert len(held) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held]) > 0.97


def test_keeps_clean_documents(labelled):
    docs, labels = labelled
    out = Q.keep_good(docs, labels)
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert len([i for i in range(900) if i % 3 and i not in ids]) < 10 and len([i for i in ids if i < 900 and i % 3 == 0]) < 10


def test_columns_agree_with_the_model(spark, labelled):
    docs, labels = labelled
    model = Q.fit(docs, labels)
    rows = Q.with_statistics(Q.keyed_texts(docs)).withColumn("z", model.column()).collect()
    x = np.array([r[2:-1] for r in rows])
    assert np.allclose(model.predict(x), [r["z"] for r in rows]) and 0 < len(model.rules) < 200


def test_held_out_labels_are_never_used(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.fit(docs, labels) == Q.fit(docs, flipped)


def test_few_or_no_labels(labelled):
    docs, labels = labelled
    none = Q.quality_scores(docs, labels.where("false"))
    assert {r["score"] for r in none.select("score").distinct().collect()} == {0.5}
    assert Q.quality_scores(docs.where("false"), labels).count() == 0
    assert Q.keep_good(docs, labels.where("quality = 1")).count() == docs.count()


def test_repeated_rows(labelled):
    docs, labels = labelled
    twice = Q.quality_scores(docs.unionByName(docs.where("doc_id < 10")), labels.unionByName(labels.where("doc_id < 10")))
    assert twice.count() == 913

"""The pipeline against its stages' brute-force versions, on whole small tables."""

from pyspark.sql import functions as F

import corpus_pipeline as C
from inkveil.llm import common, quality, substrings
from inkveil.llm.queries import QUERIES
from brute import brute_firsts, brute_words, check_packing, ids_of


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    rows = {}
    df = docs
    for name, stage in C.STAGES[:3]:
        out = stage(spark, df, small)
        assert out.columns == docs.columns
        rows[name] = {r["doc_id"]: r for r in out.collect()}
        df = spark.createDataFrame(list(rows[name].values()), docs.schema)
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    good = rows["quality classifier"]
    assert set(good) == {i for i, p in scores.items() if p}
    unlike = rows["SimHash near-dedup"]
    assert set(unlike) == brute_firsts({i: r["text"] for i, r in good.items()})
    order = sorted(unlike)
    want = brute_words([unlike[i]["text"] for i in order], order, substrings.WORDS)
    for i, (n, removed, _) in zip(order, want):
        assert (i not in rows["substring dedup"]) == (removed == n > 0)
    left = {i: r["text"] for i, r in rows["substring dedup"].items()}
    assert all(left[i] == unlike[i]["text"] for i, (n, removed, _) in zip(order, want) if not removed)
    final = C.run(spark, small).collect()
    assert {r["doc_id"] for r in final} == set(left)
    check_packing(final, {i: ids_of(t) for i, t in left.items()})


def odd_documents(spark, small):
    """Nulls, empty and long texts, repeated rows, and columns whose names the stages use themselves or that need quoting."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, " \n ", "en", "s", 3), (1003, "word " * 30_000, "en", "s", 150_000), (None, "no id at all here", "en", "s", 17)]
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(spark.createDataFrame(odd, shape))
    docs = docs.unionByName(docs.where("doc_id in (3, 7)"))
    more = {"_stat_upper": F.lit(1.0), "__stat_x": F.lit(2), "score": F.lit(3.0), "chunk": F.lit(4), "key": F.lit(5), "component_id": F.lit(6), "a b": F.struct(F.lit(7).alias("c d")), "e.f": F.lit(8)}
    return docs.withColumns(more)


def test_odd_rows_and_columns(spark, small):
    docs = odd_documents(spark, small)
    df = docs
    for name, stage in C.STAGES[:3]:
        out = stage(spark, df, small)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= df.count()
        assert all(r["score"] == 3.0 and r["a b"]["c d"] == 7 and r["e.f"] == 8 for r in rows), name
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        if name == "SimHash near-dedup":
            assert len(ids) == len(set(ids))
        df = spark.createDataFrame(rows, docs.schema)
    packed = C.STAGES[3][1](spark, df, small).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in df.collect()}


def test_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_scratch_leaves_only_what_lasts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    with common.scratch(spark):
        with common.scratch(spark):
            kept = common.staged(common.staged(spark.range(5), "inner"), "outer", lasting=1)
        assert kept.count() == 5 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["outer"]
    assert not list(tmp_path.iterdir())


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]

"""Numeric runs of plain texts: only lines with digits leave the scan, and pages of several texts go by windows."""

import duckdb

from inkveil.operators import layout as L
from inkveil.queries import ORACLES, QUERIES

TEXTS = [
    "no digits at all\n\nRef 12 345\nmore words", "1 2 x 3", "\n \n7 O1 l 8\n\n9", "", None, "a  12   l2 . 5-6\n" + "7 " * 300, "x\n" * 50 + "4 4", "٣ １ 1–2\t3", "1\r\n2",
]


def compared(spark, path, rows):
    """numeric_runs and its SQL on these documents."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = QUERIES["numeric_runs"](spark, str(path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES['numeric_runs']})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_runs_of_odd_texts(spark, tmp_path):
    got, want = compared(spark, tmp_path, list(enumerate(TEXTS)))
    assert got == want and len(got) > 5


def test_runs_of_texts_that_share_a_page(spark, tmp_path):
    """Copies under one id and other texts in other rows lie over each other, as in the SQL; so do texts without an id."""
    more = [(0, TEXTS[0]), (1, TEXTS[1]), (4, "a 5"), (20, "1 2\n3"), (20, "\n\n\n4 5"), (None, "6 a 6"), (None, "6 a 6"), (21, "a b\n\nc 1"), (21, "")]
    got, want = compared(spark, tmp_path, list(enumerate(TEXTS)) + more)
    assert got == want and {r[:3] for r in got} >= {(1, 0, 0), (20, 2, 0), (None, 0, 0)}


def test_only_lines_with_digits_are_shuffled(spark, tmp_path):
    """A page's other words are neither shuffled nor sorted: 1 GB of documents ran out of an executor's memory with them."""
    text = "\n".join(["words without any number " * 40] * 20 + ["Ref 12 345"])
    spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = QUERIES["numeric_runs"](spark, str(tmp_path))
    assert runs.count() == 50
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "lag(" not in plan and plan.count("Window [") == 1
    assert L.lines_from_text(spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "0 AS page_no", "text"), L.with_digits).count() == 50 * 3


def test_long_pages_are_dealt_to_more_tasks(spark):
    texts = spark.createDataFrame([(i, 0, "x" * 1000) for i in range(100)] + [(100, 0, None)], "doc_id long, page_no int, text string")
    few = L.tasks_by_chars(texts)
    assert L.tasks_by_chars(texts, chars=100) == 1000 > few == L.tasks_by_chars(texts.limit(0), chars=100)
    assert L.words_from_text(texts, tasks=77).rdd.getNumPartitions() == 77

import hashlib
from collections import Counter

import pytest

from inkveil.llm import repeats, substrings, suffixes, trees


def brute_bytes(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + width] for r in raw for p in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for p in range(len(r) - width + 1):
            if seen[r[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def brute_words(texts, ids, width=13):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in zip(ids, words):
        own = float("inf") if i is None else i
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, own), own)
    out = []
    for i, w in zip(ids, words):
        own, gone = float("inf") if i is None else i, [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < own:
                gone[p : p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width", [400, 25])
def test_bytes(make, texts, width):
    rows = substrings.dedup_bytes(make(texts), width).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_bytes(texts, width)


def test_bytes_spans(make):
    shared = "".join(chr(97 + i * i % 26) for i in range(450))
    rows = substrings.dedup_bytes(make(["A" + shared + "B", "C" + shared]), with_text=True).orderBy("doc_id").collect()
    assert [(bytes(r["kept"]), r["spans"]) for r in rows] == [(b"AB", [[1, 451]]), (b"C", [[1, 451]])]


def test_words(make, texts):
    rows = substrings.dedup_words(make(texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_words(texts, range(len(texts)))


def test_words_with_repeated_and_missing_ids(make, texts):
    some = texts[:12] + texts[:4] + texts[2:6]
    ids = [*range(12), 0, 1, None, None, None, 3, 4, 90]
    rows = substrings.dedup_words(make(some, ids)).collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, rows)) == sorted((i if i is not None else -1, *x) for i, x in zip(ids, brute_words(some, ids)))


def test_pieces_of_a_long_document(make, texts, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    units = [substrings.word_codes(b"a b c " * 900), substrings.word_codes(b"d"), substrings.word_codes(b"q w e r t y " * 20)]
    pieces = list(repeats.segments(units, 13))
    assert sum(int(s.windows.sum()) for s in pieces) == sum(max(0, len(u) - 12) for u in units)
    assert max(len(s.codes) for s in pieces) <= 2 * 1000 + 12


@pytest.mark.parametrize("held", [1, 500, 16 << 20])
def test_many_chunks(spark, make, texts, monkeypatch, held):
    # Tiny chunks: passages meet across chunks, not within them.  Little held: crowded anchors.
    monkeypatch.setattr(trees, "HELD", held)
    def count(rows, _, marks):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array([len(m) for m in marks], pa.int64())], names=["doc_id", "hits"])

    docs = make(texts)
    unit = substrings.WORD_UNIT
    got = trees.repeats(docs.select("doc_id", "text"), unit, count, "doc_id long, hits long", chunk=300)
    first = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = {i: sum(first[tuple(w[p : p + 13])] < i for p in range(len(w) - 12)) for i, w in enumerate((t or "").split() for t in texts)}
    assert {r["doc_id"]: r["hits"] for r in got.collect()} == want


def test_keep_first_passages(make, texts):
    docs = make(texts)
    out = substrings.keep_first_passages(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    for i, (n, removed, digest) in enumerate(brute_words(texts, range(len(texts)))):
        if removed == 0:
            assert kept[i]["text"] == texts[i]
        elif removed == n:
            assert i not in kept
        else:
            assert hashlib.sha256(kept[i]["text"].encode()).hexdigest() == digest and kept[i]["n_chars"] == len(kept[i]["text"])


def test_empty(make):
    none = make(["x"]).where("false")
    assert substrings.dedup_bytes(none).count() == 0 and substrings.dedup_words(none).count() == 0 and substrings.keep_first_passages(none).count() == 0


def test_words_against_sql(spark, small):
    import duckdb

    from inkveil.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute(ORACLES["op4_substring_dedup"]).fetchall()
    assert sorted(map(tuple, QUERIES["op4_substring_dedup"](spark, small).collect())) == sorted(want)


def test_groups_by_prefixes():
    some = [b"a b c", b"a b d", b"a b d", b"b", b"ba", b"c x y", b"c x z"]
    found = trees.prefixes(some, 4)
    assert found == sorted(set(found)) and all(any(s.startswith(p) for s in some) for p in found)
    assert trees.prefixes([], 4) == [] and trees.prefixes([b"a"] * 9, 4) == []


def test_equal_word_codes_are_told_apart(make, texts, monkeypatch):
    # Codes of two values: the cover passes nearly every window, and only the text can decide.
    rough = repeats.Unit(lambda t: substrings.word_codes(t) % 2, substrings.WORDS, 6, 13)
    monkeypatch.setattr(substrings, "WORD_UNIT", rough)
    rows = substrings.dedup_words(make(texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_words(texts, range(len(texts)))


def test_columns_of_any_name(spark, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("my col", F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c`d")))
    out = substrings.keep_first_passages(rows)
    assert out.columns == rows.columns and {r["my col"][0] for r in out.collect()} == {1}


def _around_one_passage(n=24):
    """One 500-byte passage in every text, with other text around it; some of that twice."""
    import random

    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ijklm nop") for _ in range(500))
    sides = ["".join(rng.choice("qrstuvwxyz 0123456789") for _ in range(300)) for _ in range(n)]
    return [sides[i] + line + sides[i // 2] for i in range(n)]


@pytest.mark.parametrize("held", [1, 2000, 16 << 20])
def test_one_passage_in_every_chunk(make, monkeypatch, held):
    monkeypatch.setattr(suffixes, "HELD", held)
    some = _around_one_passage()
    unit = substrings.BYTE_UNIT

    def starts(rows, _, marks):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array([m.tolist() for m in marks], pa.list_(pa.int64()))], names=["doc_id", "at"])

    got = suffixes.repeats(make(some).select("doc_id", "text"), unit, starts, "doc_id long, at array<long>", chunk=1000)
    seen = Counter(t[p : p + 400] for t in some for p in range(len(t) - 399))
    want = {i: [p for p in range(len(t) - 399) if seen[t[p : p + 400]] > 1] for i, t in enumerate(some)}
    assert {r["doc_id"]: r["at"] for r in got.collect()} == want


def test_bytes_with_crowded_anchors(make, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "HELD", 1)
    rows = substrings.dedup_bytes(make(texts), 25).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_bytes(texts, 25)


def test_sizes_of_another_type_pass_through(spark):
    from inkveil.llm import substrings

    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage + " one", "many", 1.5), (2, "two " + passage, None, 2.5), (3, passage, "x", 3.5)]
    for kind in ("string", "double"):
        table = spark.createDataFrame([(i, t, n if kind == "string" else d) for i, t, n, d in rows], f"doc_id long, text string, n_chars {kind}")
        got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substrings.keep_first_passages(table).collect()}
        assert got == {1: (passage + " one", rows[0][2] if kind == "string" else 1.5), 2: ("two", None if kind == "string" else 2.5)}

import pytest
from pyspark.sql import functions as F

from inkveil.operators import detect as D, layout as L

W, H = 1000, 500


def words(lines, unit=18, x0=50, height=40):
    """[(y, text)] set from the left, or ready-made (text, x, y, w, h) words."""
    out = []
    for line in lines:
        if len(line) == 5:
            out.append(line)
            continue
        y, text = line
        x = x0
        for w in text.split():
            out.append((w, float(x), float(y), float(len(w) * unit), float(height)))
            x += len(w) * unit + 15
    return out


def lined(spark, pages, width=W, height=H):
    rows = [(d, 0, i, *w) for d, lines in enumerate(pages) for i, w in enumerate(words(lines))]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, word_idx long, text string, x double, y double, w double, h double")
    sizes = spark.createDataFrame([(d, 0, width, height) for d in range(len(pages))], "doc_id long, page_no int, width int, height int")
    return D.on_pages(df, sizes)


def found(spark, detector, pages, **more):
    rows = detector(lined(spark, pages, **more)).orderBy("doc_id", "priority", "seq").collect()
    return [[r for r in rows if r["doc_id"] == d] for d in range(len(pages))]


def one(text, y=100):
    return [(y, text)]


def test_id_numbers(spark):
    pages = [one(t) for t in (
        "2345 6789 0124", "2345 6789 0123", "0123 4567 8901", "1234 5678 9012", "23-45 6789 OI24", "234567 PIN 890124", "SOBI OSIS BOSI", "D345 6789 0124", "0345 6789 0124",
        "2345 GTA9 b12U", "9123 4567 8901 2345",
    )] + [[(100, "2345 6789 0124"), (300, "3456 7890 1238")], [(100, "2345 6789 0124"), (200, "9123 4567 8901 2345")]]
    got = found(spark, D.id_numbers, pages)
    kinds = [[(r["label"], r["source"]) for r in rows] for rows in got]
    a, s = ("Aadhaar number", "auto"), ("Aadhaar number", "suggested")
    assert kinds[:10] == [[a], [s], [], [], [a], [], [], [s], [], [kinds[9][0]]] and kinds[9][0][0] == "Aadhaar number"
    assert [k[0] for k in kinds[10]] == ["VID"] and got[10][0]["w"] > 4 * 4 * 18
    assert kinds[11] == [a, a] and [k[0] for k in kinds[12]] == ["Aadhaar number", "VID"]
    assert got[0][0]["x"] < 50 and got[0][0]["w"] > 12 * 18


def test_boxes_stay_on_the_page(spark):
    (rows,) = found(spark, D.id_numbers, [[(0, "2345 6789 0124")]], width=400, height=60)
    r = rows[0]
    assert r["x"] >= 0 and r["y"] >= 0 and r["x"] + r["w"] <= 400 and r["y"] + r["h"] <= 60


def test_pans(spark):
    assert [len(r) for r in found(spark, D.pans, [one("ABCPE1234F"), one("ABCXE1234F"), one("8008412345")])] == [1, 0, 1]
    assert D.pans(lined(spark, [one("8008412345")]), strict=True).count() == 0


def test_dates(spark):
    texts = ["DOB: 01/01/1990", "31-12-1985", "9.8.2001", "32/01/1990", "01/13/1990", "1990", "Year of Birth: 1990", "Registration Year 2019"]
    assert [len(r) for r in found(spark, D.dates, [one(t) for t in texts])] == [1, 1, 1, 0, 0, 0, 1, 1]


CARD = [(40, "Government of India"), (100, "Address: H.No 12, Shivaji Nagar"), (160, "Near Bus Stand"), (220, "Pune 411038"), (280, "Help 1947")]


def test_addresses(spark):
    detector = lambda x: D.addresses(D.rows(x))
    card, so, none = found(spark, detector, [CARD, [(100, "S/O Ramesh Kumar"), (160, "Pune 411038")], one("Pune 411038")])
    assert len(card) == 1 and card[0]["y"] < 100 and 220 < card[0]["y"] + card[0]["h"] < 280
    assert len(so) == 1 and not none


def test_labelled_numbers(spark):
    detector = lambda x: D.labelled_numbers(D.rows(x))
    under, aside = ([("Roll", 60.0, 100.0, 60.0, 24.0), ("2019CS4471", x, 140.0, 150.0, 24.0)] for x in (62.0, 600.0))
    texts = ["Roll No. 2019CS4471", "Roll of honour", *[f"{w} No. 456789" for w in ("Seat", "Enrolment", "PRN", "Index", "Registration")], "Registration Year 2019"]
    got = found(spark, detector, [one(t) for t in texts] + [under, aside, one("constructor 12345678")])
    assert [len(r) for r in got] == [1, 0, 1, 1, 1, 1, 1, 0, 1, 0, 0]
    assert got[0][0]["source"] == "suggested" and got[8][0]["label"] == "Roll number" and got[8][0]["y"] > 120


def test_names(spark):
    detector = lambda x: D.names(D.rows(x))
    texts = ["Name of Candidate RAHUL SHARMA", "Name of School ST XAVIERS", "Father's Name ANIL SHARMA", "Name : 123456", "Name RAHUL K SHARMA"]
    got = found(spark, detector, [one(t) for t in texts])
    assert [len(r) for r in got] == [1, 0, 1, 0, 1]
    assert got[4][0]["w"] < 18 * 5 + 40


def test_all_fields_and_suppression(spark):
    (rows,) = found(spark, lambda x: D.suppress(D.detect(x)), [[*CARD[:4], (280, "Mobile 9876543210")]])
    assert {r["label"] for r in rows} == {"Address", "Phone number"}


def boxes(spark, rects, labels=None):
    rows = [(0, 0, 1, i, *map(float, r), (labels or ["Other"] * len(rects))[i], "auto") for i, r in enumerate(rects)]
    return spark.createDataFrame(rows, "doc_id long, page_no int, priority int, seq long, x double, y double, w double, h double, label string, source string")


def test_suppression_is_greedy(spark):
    # A covers most of B, B most of C, A not of C: B goes, C stays.
    chain = [(0, 0, 100, 10), (30, 0, 100, 10), (60, 0, 100, 10)]
    kept = D.suppress(boxes(spark, chain))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2]
    again = D.suppress(kept.select(*boxes(spark, chain).columns))
    assert sorted(r["seq"] for r in again.collect()) == [0, 2]
    safe = boxes(spark, [(0, 0, 100, 100), (10, 10, 20, 20)], ["Address", "QR code"])
    assert D.suppress(safe).count() == 1 and D.suppress(safe, safe=True).count() == 2


def test_lines_follow_a_tilt(spark):
    tilted = [("a", 0.0, 100.0, 20.0, 20.0), ("b", 30.0, 106.0, 20.0, 20.0), ("c", 60.0, 112.0, 20.0, 20.0), ("d", 0.0, 140.0, 20.0, 20.0)]
    rows = lined(spark, [tilted]).orderBy("line_no", "pos").collect()
    assert [(r["text"], r["line_no"], r["pos"]) for r in rows] == [("a", 0, 0), ("b", 0, 1), ("c", 0, 2), ("d", 1, 0)]


def test_words_from_text_and_empty_pages(spark):
    df = spark.createDataFrame([(1, 0, "ab  c\n\nd"), (2, 0, "")], "doc_id long, page_no int, text string")
    got = {(r["doc_id"], r["text"]): (r["x"], r["y"]) for r in L.words_from_text(df).collect()}
    assert got == {(1, "ab"): (50, 40), (1, "c"): (50 + 36 + 15, 40), (1, "d"): (50, 160)}
    empty = lined(spark, [one("x")]).where(F.lit(False))
    assert D.suppress(D.detect(empty)).count() == 0


def test_recognised_words(spark):
    df = spark.sql(
        "SELECT 1L AS doc_id, 0 AS page_no, 2.0D AS scale, array(named_struct('paragraphs', array(named_struct('lines', array(named_struct('words', array("
        "named_struct('text', 'hi', 'confidence', 90.0D, 'x0', 10.0D, 'y0', 20.0D, 'x1', 30.0D, 'y1', 40.0D), named_struct('text', ' ', 'confidence', 1.0D, 'x0', 0.0D, 'y0', 0.0D, 'x1', 1.0D, 'y1', 1.0D)))))))) AS blocks"
    )
    (r,) = L.read_words(df).collect()
    assert (r["text"], r["x"], r["y"], r["w"], r["h"]) == ("hi", 5.0, 10.0, 10.0, 10.0)


@pytest.mark.parametrize("text", ["2345 6789 0124 9999", "1 2 3 4 5 6 7 8 9 0 1 2 3"])
def test_long_runs(spark, text):
    assert D.id_numbers(lined(spark, [one(text)])).count() <= 1


def test_lines_from_text_finds_what_lines_finds(spark):
    """Pages of plain text, of which only telling lines are read, against all their words by windows."""
    texts = [
        "nothing here\n\nName: Asha\nRao 12\nof no use\nAddress: 4 Lane\nb\nc\nd\ne\nf\ng 411001\nlast", "Na-me\n \nAsha Rao", "blank\n\nABCPQ5678K\nABCPEOOOOK x",
        "Ｓ/o s/o\n1\n2\n3\n4\n5\n6\n411001", "2345 6789 0124 " * 40 + "\nyear 1999 dob 1999", "", "\u212A\nmar\u212As NAME\nAsha Rao", "D.\u0130.O\nC\u0130D/o s\u0130 2\nS/O x\ny", "ABC.PE-OO:OO'K", "mob\n98765 43210\nroll\n\n\n77777", None,
    ]
    df = spark.createDataFrame([(i, 0, t, 900, 900) for i, t in enumerate(texts)], "doc_id long, page_no int, text string, width int, height int")
    by_words = D.detect(D.on_pages(L.words_from_text(df), df))
    by_lines = D.detect(D.on_texts(df))
    assert sorted(by_lines.collect()) == sorted(by_words.collect())
    assert {r["label"] for r in by_lines.collect()} >= {"Aadhaar number", "PAN", "Name", "Address", "Phone number", "Roll number", "Date of birth"}


def test_suppression_in_heaps(spark):
    """Boxes in one heap, in others and touching, against one fold over the whole page."""
    import random

    rng = random.Random(5)
    rows = [(0, 0, rng.randint(1, 6), i, rng.randint(0, 60) * 5.0, rng.randint(0, 60) * 5.0, rng.randint(2, 12) * 5.0, rng.randint(2, 8) * 5.0, "Name", "auto") for i in range(400)]
    got = {(r["priority"], r["seq"]) for r in D.suppress(spark.createDataFrame(rows, "doc_id long, page_no int, priority int, seq long, x double, y double, w double, h double, label string, source string")).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: r[2:]):
        x, y, w, h = r[4:8]
        over = [max(0, min(k[4] + k[6], x + w) - max(k[4], x)) * max(0, min(k[5] + k[7], y + h) - max(k[5], y)) / (w * h) for k in kept]
        if not any(o > 0.6 for o in over):
            kept.append(r)
    assert got == {(r[2], r[3]) for r in kept}


def test_pages_of_one_number_are_shuffled_once(spark, small):
    """A constant page_no does not make detectors shuffle the words again, and they all share one exchange."""
    import re

    from inkveil.operators import detect
    from inkveil.plans import cards

    lined = detect.on_texts(cards.card_texts(spark, small))
    rows = detect.rows(lined)
    for found in (detect.id_numbers(lined), detect.pans(lined), detect.dates(lined), detect.names(rows), detect.addresses(rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"[ -]Exchange hashpartitioning\(doc_id", plan)) == 1 and "Join [doc_id" not in plan


def test_check_digits(spark):
    from pyspark.sql import functions as F

    from inkveil.functions import text

    d = spark.range(200).select((F.col("id") * 7919 + 20_000_000_000).cast("string").alias("n"))
    got = d.select(text.verhoeff(F.concat("n", text.check_digit(F.col("n")).cast("string"))).alias("ok"))
    assert got.where("ok").count() == 200

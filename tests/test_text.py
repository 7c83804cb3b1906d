import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from inkveil import sqlapi
from inkveil.functions import text as T


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_and_anchor(spark):
    assert values(spark, T.clean, ["2345-", "a–b—c", "x y﻿", "O'Neil:\"q\"", ""]) == ["2345", "abc", "xy", "ONeilq", ""]
    assert values(spark, T.anchor, ["S/O:", "Father's", "जन्मतिथि:", "No.12"]) == ["s/o", "fathers", "जन्मतिथि", "no"]


def test_digits(spark):
    assert values(spark, T.digits_of, ["23-45", "OI24", "SOBI", "No.1234x", "b12U", None]) == ["2345", "0124", None, None, "6120", None]
    assert values(spark, T.as_digit, [T.CONFUSED]) == [T.AS_DIGITS]


VALID = ["234567890124", "999999999999"]
INVALID = ["234567890123", "234567890125", "234567809124", "", "2345 6789 0124", "23456789012x", None, "234567890124\n"]


def test_verhoeff(spark):
    assert values(spark, T.verhoeff, VALID + INVALID) == [True] * 2 + [False] * 8
    assert values(spark, T.looks_like_aadhaar, ["234567890124", "034567890124", "134567890124", "23456789012"]) == [True, False, False, False]


def verhoeff(digits: str) -> bool:
    check = 0
    for i, c in enumerate(reversed(digits)):
        check = T.DIHEDRAL[10 * check + T.PERMUTED[10 * (i % 8) + int(c)]]
    return check == 0


@settings(max_examples=200)
@given(st.text("0123456789", min_size=1, max_size=15), st.data())
def test_verhoeff_tables_catch_every_wrong_digit(stem, data):
    number = next(stem + str(d) for d in range(10) if verhoeff(stem + str(d)))
    at = data.draw(st.integers(0, len(number) - 1))
    other = data.draw(st.sampled_from([c for c in "0123456789" if c != number[at]]))
    assert not verhoeff(number[:at] + other + number[at + 1 :])


PANS = {"ABCPE1234F": "ABCPE1234F", "ABCPE1O34F": "ABCPE1034F", "ABCPEI234F": "ABCPE1234F", "ABCXE1234F": None, "ABCPE123F": None, "ABCPE12345F": None,
        "234567890124": None, "BOOKSHELF12": None, "8008412345": "BOOBA1234S"}


def test_pan(spark):
    assert values(spark, T.read_pan, PANS) == list(PANS.values())
    assert values(spark, lambda c: T.read_pan(c, strict=True), ["8008412345", "abcpsolsox", "ABCPE1234F"]) == [None, None, "ABCPE1234F"]


def test_kinds_of_words(spark):
    assert values(spark, T.is_date, ["01/01/1990", "31-12-1985", "9.8.2001", "32/01/1990", "01/13/1990", "1990", "01/01/1990\n"]) == [True] * 3 + [False] * 3 + [True]
    assert values(spark, T.looks_like_reference, ["2019CS4471", "2019", "123", "12-34"]) == [True, False, False, True]
    assert values(spark, T.looks_like_name_part, ["SHARMA", "K", "R2D2", "O'Neil,"]) == [True, False, False, True]


def test_phrases(spark):
    assert values(spark, T.spoken, ["QR code", "PAN"]) == ["qr code", "PAN"]
    day = F.to_date(F.lit("2026-08-14"))
    said = values(spark, lambda c: T.stamp_text(c, day), ["Bank KYC", "For HDFC KYC only", "  ", "fortune"])
    assert said == ["For Bank KYC only · 14 Aug 2026", "For HDFC KYC only · 14 Aug 2026", "Copy issued 14 Aug 2026", "For fortune only · 14 Aug 2026"]
    names = values(spark, lambda c: T.redacted_name(c, F.lit("jpg")), ["Card Front.jpg", "scan..final.v2.jpeg", ".jpg"])
    assert names == ["card-front-redacted.jpg", "scan-final-v2-redacted.jpg", "document-redacted.jpg"]
    listed = spark.range(1).select(T.listed(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), T.listed(F.array(F.lit("a")))).first()
    assert tuple(listed) == ("a, b and c", "a")


def test_scrub(spark):
    text = ["x https://a.b.cdn.jsdelivr.net/n 'http://unpkg.com/x' https://unpkg.com", "https://example.com"]
    assert values(spark, T.scrub, text) == ["x /blocked-content-network/n '/blocked-content-network/x' /blocked-content-network", "https://example.com"]
    assert values(spark, T.cdn_urls, text) == [["https://a.b.cdn.jsdelivr.net", "http://unpkg.com", "https://unpkg.com"], []]


@pytest.mark.parametrize("name, column", [("veil_clean", T.clean), ("veil_anchor", T.anchor), ("veil_digits", T.digits_of), ("veil_verhoeff", T.verhoeff),
                                          ("veil_pan", T.read_pan), ("veil_is_date", T.is_date), ("veil_spoken", T.spoken)])
def test_sql_functions_agree(spark, name, column):
    sqlapi.register(spark)
    inputs = [*VALID, *INVALID, *PANS, "S/O:", "OI24", "9.8.2001", "QR code", "O'Neil:\"q\"", "a–b"]
    df = spark.createDataFrame([(x,) for x in inputs], "x string")
    assert df.selectExpr(f"{name}(x) AS y").collect() == df.select(column(F.col("x")).alias("y")).collect()


def test_face_windows_table_function(spark):
    sqlapi.register(spark)
    rows = spark.sql("SELECT fraction, count(*) AS n FROM veil_face_windows(1000D, 600D) GROUP BY fraction ORDER BY fraction DESC").collect()
    assert [r["n"] for r in rows] == [1, 9, 49]

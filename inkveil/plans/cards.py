"""Identity cards made from customers: pages with every kind of field, for queries and benches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.layout import lines_of_texts, tasks_by_chars, words_from_text
from ..shared import dealt

WIDTH, HEIGHT = 1000, 600


def letters(k: Column, n: int) -> Column:
    """n letters of k in base 26, the least significant first."""
    return F.concat(*[F.chr((F.floor(k / 26**i) % 26 + 65).cast("int")) for i in range(n)])


def card_texts(spark: SparkSession, sf_dir: str, phone_base: int = 9_000_000_000) -> DataFrame:
    """doc_id, page_no, text, width, height: one card a customer.

    Customers are dealt to all tasks first, as their file is small for the work that a card is.
    """
    c = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    k = F.col("c_custkey").cast("long")
    stem = F.concat((k % 8 + 2).cast("string"), F.lpad((k * 7919 % 10_000_000_000).cast("string"), 10, "0"))
    check = T.check_digit(stem)
    number = F.col("number")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    rows = [
        F.concat(F.lit("Name: "), F.translate(F.expr("substr(c_name, 10)"), "0123456789", "ABCDEFGHIJ")),
        F.concat(F.lit("DOB: "), two(k % 28 + 1), F.lit("/"), two(k % 12 + 1), F.lit("/"), (k % 50 + 1950).cast("string")),
        F.concat_ws(" ", F.substring(number, 1, 4), F.substring(number, 5, 4), F.substring(number, 9, 4)),
        F.concat(F.lit("Mobile "), (k * 104_729 % 1_000_000_000 + phone_base).cast("string")),
        F.concat(F.lit("Address: H.No "), k.cast("string"), F.lit(", "), F.col("n_name")),
        F.concat(F.lit("Pune "), (k % 99_999 + 400_000).cast("string")),
        F.concat(letters(k, 3), F.lit("P"), letters(k, 1), F.lpad((k % 10_000).cast("string"), 4, "0"), letters(k, 1)),
    ]
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).withColumn("check", check)
    joined = joined.withColumn("number", F.concat(stem, F.when(k % 3 == 0, (F.col("check") + 1) % 10).otherwise(F.col("check")).cast("string")))
    return joined.select(k.alias("doc_id"), F.lit(0).alias("page_no"), F.concat_ws("\n", *rows).alias("text"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def card_words(spark: SparkSession, sf_dir: str, phone_base: int = 9_000_000_000) -> tuple[DataFrame, DataFrame]:
    """The cards' words and their pages."""
    texts = card_texts(spark, sf_dir, phone_base)
    return words_from_text(texts), texts.select("doc_id", "page_no", "width", "height")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, text, width, height: all documents as pages, wide and high enough for their texts."""
    size = F.lit(100_000_000)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.lit(0).alias("page_no"), F.coalesce("text", F.lit("")).alias("text"), size.alias("width"), size.alias("height")
    )


def document_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents' words and their pages."""
    texts = document_texts(spark, sf_dir)
    return words_from_text(texts, tasks=tasks_by_chars(texts)), texts.select("doc_id", "page_no", "width", "height")


def document_lines(spark: SparkSession, sf_dir: str, keep) -> DataFrame:
    """The words of those of the documents' lines that keep wants, with line_no and pos."""
    texts = document_texts(spark, sf_dir)
    return lines_of_texts(texts, keep, tasks_by_chars(texts))

"""Text functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import schema

# White space as browsers see it, which Java's \s does not cover.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
SEPARATORS = f"[{SPACE}\\-\\u2013\\u2014.,:'\"]"
# Characters read for digits, and digits read for letters.
CONFUSED, AS_DIGITS = "OoQDUIl|ZASsGbTBgq", "000001112455667899"
MISREAD, AS_LETTERS = "01245678", "OIZASGTB"
DATE = "^(0?[1-9]|[12][0-9]|3[01])[/\\-.](0?[1-9]|1[0-2])[/\\-.](19|20)[0-9]{2}\\z"
YEAR = "^(19|20)[0-9]{2}\\z"
PIN = "^[0-9]{6}\\z"
# The dihedral group's table and the permutation's rows (Verhoeff, 1969).
DIHEDRAL = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 0, 6, 7, 8, 9, 5, 2, 3, 4, 0, 1, 7, 8, 9, 5, 6, 3, 4, 0, 1, 2, 8, 9, 5, 6, 7,
    4, 0, 1, 2, 3, 9, 5, 6, 7, 8, 5, 9, 8, 7, 6, 0, 4, 3, 2, 1, 6, 5, 9, 8, 7, 1, 0, 4, 3, 2, 7, 6, 5, 9, 8, 2, 1, 0, 4, 3,
    8, 7, 6, 5, 9, 3, 2, 1, 0, 4, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
)
PERMUTED = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 5, 7, 6, 2, 8, 3, 0, 9, 4, 5, 8, 0, 3, 7, 9, 6, 1, 4, 2, 8, 9, 1, 6, 0, 4, 3, 5, 2, 7,
    9, 4, 5, 3, 1, 2, 6, 8, 7, 0, 4, 2, 8, 6, 5, 7, 3, 9, 0, 1, 2, 7, 9, 3, 8, 0, 6, 4, 1, 5, 7, 0, 4, 6, 9, 1, 3, 2, 5, 8,
)


def clean(c: Column) -> Column:
    """Without separators and surrounding punctuation."""
    return F.regexp_replace(c, SEPARATORS, "")


def anchor(c: Column) -> Column:
    """Lower-case Latin and Devanagari letters and slashes only, to match labels by."""
    return F.regexp_replace(F.lower(c), "[^a-z\\u0900-\\u097F/]", "")


def as_digit(c: Column) -> Column:
    return F.translate(c, CONFUSED, AS_DIGITS)


def as_letter(c: Column) -> Column:
    return F.upper(F.translate(c, MISREAD, AS_LETTERS))


def digits_of(c: Column) -> Column:
    """The digits of a wholly numeric word with one real digit at least, else null."""
    mapped = as_digit(clean(c))
    return F.when(c.rlike("[0-9]") & mapped.rlike("^[0-9]+\\z"), mapped)


def _checksum(c: Column, behind: int = 0) -> Column:
    """Verhoeff's product of a string of digits with so many digits still to follow; null for other strings."""
    d, p = F.array(*map(F.lit, DIHEDRAL)), F.array(*map(F.lit, PERMUTED))
    safe = F.when(c.rlike("^[0-9]+\\z"), c)
    backwards = F.split(F.reverse(safe), "(?!^)(?!\\z)")
    terms = F.transform(backwards, lambda x, i: F.get(p, ((i + behind) % 8) * 10 + x.try_cast("int")))
    return F.aggregate(terms, F.lit(0), lambda acc, x: F.get(d, acc * 10 + x))


def verhoeff(c: Column) -> Column:
    """Does the string of digits end in a valid check digit?"""
    return F.coalesce(_checksum(c) == 0, F.lit(False))


def check_digit(c: Column) -> Column:
    """The digit that makes the string of digits valid when it is put behind: the inverse of their product."""
    return F.get(F.array(*map(F.lit, (0, 4, 3, 2, 1, 5, 6, 7, 8, 9))), _checksum(c, 1))


def looks_like_aadhaar(c: Column) -> Column:
    return c.rlike("^[2-9][0-9]{11}\\z")


def read_pan(c: Column, strict: bool = False) -> Column:
    """The word coerced to five letters, four digits, a letter, else null.

    strict: at least one real digit among the four, which an all-letter word lacks, and one
    real letter, which a phone number lacks.
    """
    raw = clean(c)
    read = F.concat(as_letter(F.substring(raw, 1, 5)), as_digit(F.substring(raw, 6, 4)), as_letter(F.substring(raw, 10, 1)))
    ok = (F.length(c) >= 10) & (F.length(raw) == 10) & read.rlike("^[A-Z]{5}[0-9]{4}[A-Z]\\z") & F.substring(read, 4, 1).isin(*schema.HOLDER_TYPES)
    if strict:
        ok = ok & F.substring(raw, 6, 4).rlike("[0-9]") & F.substring(raw, 1, 5).rlike("[A-Za-z]")
    return F.when(ok, read)


def looks_like_reference(c: Column) -> Column:
    """Four digits or more, and no bare year."""
    cleaned = clean(c)
    return c.rlike("[0-9]") & (F.length(F.regexp_replace(cleaned, "[^0-9]", "")) >= 4) & ~cleaned.rlike(YEAR)


def looks_like_name_part(c: Column) -> Column:
    cleaned = clean(c)
    letters = F.regexp_replace(cleaned, "[^A-Za-z]", "")
    return (F.length(letters) >= 2) & (F.length(letters) == F.length(F.regexp_replace(cleaned, "[.:,]", "")))


def is_date(c: Column) -> Column:
    return c.rlike("[0-9]") & F.regexp_replace(c, f"[{SPACE}]", "").rlike(DATE)


def is_year(c: Column) -> Column:
    return c.rlike("[0-9]") & clean(c).rlike(YEAR)


def is_pin(c: Column) -> Column:
    return F.coalesce(digits_of(c).rlike(PIN), F.lit(False))


def number_label(anchored: Column) -> Column:
    """The label that an anchor word announces a number for, else null."""
    pairs = schema.NUMBER_LABELS.items()
    return reduce(lambda out, x: out.when(anchored.isin(*x[1]), x[0]), list(pairs)[1:], F.when(anchored.isin(*schema.NUMBER_LABELS["Roll number"]), "Roll number"))


def spoken(c: Column) -> Column:
    """A label inside a sentence: lower case, but for acronyms."""
    return F.when(c == F.upper(c), c).otherwise(F.lower(c))


def listed(a: Column) -> Column:
    """'a, b and c'."""
    n = F.size(a)
    return F.when(n > 1, F.concat(F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(a, -1))).otherwise(F.array_join(a, ""))


def stamp_date(d: Column) -> Column:
    return F.date_format(d, "dd MMM yyyy")


def stamp_text(purpose: Column, d: Column) -> Column:
    said = F.regexp_replace(F.regexp_replace(purpose, f"^[{SPACE}]+", ""), f"[{SPACE}]+\\z", "")
    phrase = F.when(said.rlike("(?i)^for\\b"), said).otherwise(F.concat(F.lit("For "), said, F.lit(" only")))
    return F.when(F.coalesce(said, F.lit("")) == "", F.concat(F.lit("Copy issued "), stamp_date(d))).otherwise(F.concat(phrase, F.lit(" · "), stamp_date(d)))


def redacted_name(name: Column, extension: Column, suffix: str = "-redacted") -> Column:
    stem = F.regexp_replace(F.regexp_replace(name, "\\.[^.]+\\z", ""), "[^a-zA-Z0-9]+", "-")
    stem = F.lower(F.regexp_replace(stem, "^-+|-+\\z", ""))
    return F.concat(F.when(stem == "", "document").otherwise(stem), F.lit(suffix + "."), extension)


CDN_URL = "https?://(?:[a-zA-Z0-9-]+\\.)*(?:" + "|".join(h.replace(".", "\\.") for h in schema.CDN_HOSTS) + ")"


def scrub(c: Column, to: str = "/blocked-content-network") -> Column:
    return F.regexp_replace(c, CDN_URL, to)


def cdn_urls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({CDN_URL})"), F.lit(1)))

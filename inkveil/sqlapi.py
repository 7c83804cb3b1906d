"""The engine's text functions for SQL, and its detectors as views and a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from . import schema
from .functions import text as T
from .operators import detect as D, raster

_SEPARATORS = T.SEPARATORS.replace("'", "\\u0027").replace('"', "\\u0022")
_CLEAN = f"regexp_replace(x, r'{_SEPARATORS}', '')"
_DIGIT = "translate({}, '" + T.CONFUSED + "', '" + T.AS_DIGITS + "')"
_LETTER = "upper(translate({}, '" + T.MISREAD + "', '" + T.AS_LETTERS + "'))"
_HOLDERS = ", ".join(f"'{h}'" for h in schema.HOLDER_TYPES)
_READ = f"{_LETTER.format('substr(veil_clean(x), 1, 5)')} || {_DIGIT.format('substr(veil_clean(x), 6, 4)')} || {_LETTER.format('substr(veil_clean(x), 10, 1)')}"
_D, _P = (", ".join(map(str, t)) for t in (T.DIHEDRAL, T.PERMUTED))

#: name -> (result, body in terms of x)
FUNCTIONS = {
    "veil_clean": ("STRING", _CLEAN),
    "veil_anchor": ("STRING", r"regexp_replace(lower(x), r'[^a-zऀ-ॿ/]', '')"),
    "veil_digits": ("STRING", f"CASE WHEN veil_clean(x) RLIKE '[0-9]' AND {_DIGIT.format('veil_clean(x)')} RLIKE r'^[0-9]+\\z' THEN {_DIGIT.format('veil_clean(x)')} END"),
    "veil_verhoeff": (
        "BOOLEAN",
        "coalesce(aggregate(transform(split(reverse(CASE WHEN x RLIKE r'^[0-9]+\\z' THEN x END), r'(?!^)(?!\\z)'), "
        f"(c, i) -> get(array({_P}), (i % 8) * 10 + CAST(c AS INT))), 0, (a, b) -> get(array({_D}), a * 10 + b)) = 0, false)",
    ),
    "veil_pan": ("STRING", f"CASE WHEN length(veil_clean(x)) = 10 AND {_READ} RLIKE r'^[A-Z]{{5}}[0-9]{{4}}[A-Z]\\z' AND substr({_READ}, 4, 1) IN ({_HOLDERS}) THEN {_READ} END"),
    "veil_is_date": ("BOOLEAN", f"regexp_replace(x, r'[{T.SPACE}]', '') RLIKE r'{T.DATE}'"),
    "veil_spoken": ("STRING", "CASE WHEN x = upper(x) THEN x ELSE lower(x) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the text functions as temporary SQL functions: expressions that Catalyst inlines, no UDFs."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("veil_face_windows", FaceWindows)
    return [*FUNCTIONS, "veil_face_windows"]


@udtf(returnType="fraction double, x double, y double, w double, h double")
class FaceWindows:
    """veil_face_windows(width, height): the frames that a face model is run on."""

    def eval(self, width: float, height: float):
        for fraction in (1.0, 0.5, 0.25):
            w, h = width * fraction, height * fraction
            steps = round(1 / fraction) * 2 - 1
            for row in range(steps):
                for col in range(steps):
                    yield fraction, col * w / 2, row * h / 2, w, h


def register_views(spark: SparkSession, words: DataFrame, pages: DataFrame) -> None:
    """Temporary views veil_lines, veil_findings and veil_boxes over a table of words."""
    lined = D.on_pages(words, pages)
    found = D.detect(lined)
    lined.createOrReplaceTempView("veil_lines")
    found.createOrReplaceTempView("veil_findings")
    D.suppress(found).createOrReplaceTempView("veil_boxes")


locate_codes = raster.locate_codes

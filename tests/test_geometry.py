from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from inkveil.functions import geometry as G


def lit(*r):
    return tuple(F.lit(float(v)) for v in r)


def values(spark, r):
    return tuple(spark.range(1).select(*[c.alias(n) for c, n in zip(r, "xywh")]).first())


def test_rects(spark):
    assert values(spark, G.normalise_rect(lit(50, 50, -20, -10))) == (30, 40, 20, 10)
    assert values(spark, G.clamp_rect(lit(-10, -10, 20, 20), 100, 100)) == (0, 0, 20, 20)
    x, y, w, h = values(spark, G.clamp_rect(lit(90, 90, 50, 50), 100, 100))
    assert x + w <= 100 and y + h <= 100
    assert values(spark, G.move_rect(lit(80, 10, 30, 10), 50, 0, 100, 100))[::2] == (70, 30)
    assert values(spark, G.resize_rect(lit(20, 20, 40, 40), F.lit("nw"), 10, 10, 100, 100)) == (30, 30, 30, 30)
    x, _, w, _ = values(spark, G.resize_rect(lit(20, 20, 40, 40), F.lit("e"), -60, 0, 100, 100))
    assert w >= 8 and x >= 0
    assert values(spark, G.to_full(lit(10, 20, 30, 40), 2.5)) == (25, 50, 75, 100)
    assert values(spark, G.to_full(lit(-2.5, 0.5, 1.5, 2.5), 1)) == (-2, 1, 2, 3)


def test_photographs_and_codes(spark):
    assert values(spark, G.expand_face(lit(200, 200, 100, 120), 1000, 1000)) == (160, 152, 180, 216)
    assert values(spark, G.expand_face(lit(10, 10, 380, 380), 400, 400)) == (0, 0, 400, 400)
    x, y, w, h = values(spark, G.pad_code(lit(100, 100, 100, 200), 1000, 1000))
    assert abs((w - 100) - (h - 200)) < 1e-9 and x < 100 and y < 100


def test_shares(spark):
    a, b = lit(0, 0, 10, 10), lit(5, 0, 10, 5)
    row = spark.range(1).select(G.covers(a, b), G.covers(b, a), G.overlap(a, b), G.covers(a, lit(1, 1, 0, 5)), G.overlaps_vertically(a, lit(20, 4, 5, 10))).first()
    assert tuple(row) == (0.5, 0.25, 0.5, 0.0, True)


def test_scales(spark):
    edges = spark.createDataFrame([(600,), (1200,), (2000,), (0,), (500,)], "e int").select(G.ocr_scale(F.col("e")), G.code_scales(F.col("e"))).collect()
    scales = [r[0] for r in edges]
    assert scales[0] > 2 and 1 < scales[1] < 2 and scales[2] == 1 and scales[3] == 1
    assert [r[1] for r in edges[1:]] == [[1, 2], [1], [1], [1, 2, 3]]
    a, b = (spark.range(1).select(*G.stamp_layout(F.lit(w), F.lit(h))).first() for w, h in ((1000, 600), (3000, 1800)))
    assert abs(b["font_size"] / a["font_size"] - 3) < 0.1 and abs(b["line_gap"] / b["font_size"] - 4.2) < 1e-9
    assert spark.range(1).select(*G.stamp_layout(F.lit(120), F.lit(80))).first()["font_size"] == 11


def test_finder_ratio(spark):
    runs = [(5, 5, 15, 5, 5), (4, 5, 16, 5, 5), (5, 5, 5, 5, 5), (5, 5, 30, 5, 5), (1, 1, 3, 1, 1)]
    df = spark.createDataFrame([(list(map(float, r)),) for r in runs], "r array<double>")
    assert [r[0] for r in df.select(G.is_finder_ratio(F.col("r"))).collect()] == [True, True, False, False, False]


def clamp(x, y, w, h, W, H):
    cx, cy = min(max(x, 0), max(W - 8, 0)), min(max(y, 0), max(H - 8, 0))
    return cx, cy, min(max(w, 8), W - cx), min(max(h, 8), H - cy)


@settings(max_examples=200)
@given(*[st.integers(-500, 500)] * 4, st.integers(8, 300), st.integers(8, 300))
def test_clamp_stays_inside(x, y, w, h, W, H):
    cx, cy, cw, ch = clamp(x, y, w, h, W, H)
    assert 0 <= cx and cx + cw <= W and 0 <= cy and cy + ch <= H and cw >= 8 and ch >= 8


def test_clamp_column_follows_the_rule(spark):
    rows = [(float(x), float(y), float(w), float(h)) for x in (-30, 5, 95) for y in (-9, 50) for w in (1, 40, 300) for h in (2, 90)]
    df = spark.createDataFrame(rows, "x double, y double, w double, h double")
    got = [tuple(r) for r in df.select(*G.named(G.clamp_rect(G.rect(), 100, 100))).collect()]
    assert got == [clamp(*r, 100, 100) for r in rows]

import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import media


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("rgb", [(255, 0, 0), (10, 200, 30), (0, 0, 0), (128, 128, 128), (12, 34, 250), (250, 10, 245)])
def test_hue(spark, rgb):
    h, s = media.hue_saturation(*[F.lit(v) for v in rgb])
    want = colorsys.rgb_to_hsv(*[v / 255 for v in rgb])
    assert abs(one(spark, h) - want[0]) < 1e-9 and abs(one(spark, s) - want[1]) < 1e-9


def test_hex(spark):
    for h, li, s in ((210.0, 50.0, 40.0), (0.0, 30.0, 90.0), (300.0, 80.0, 10.0)):
        r, g, b = colorsys.hls_to_rgb(h / 360, li / 100, s / 100)
        assert one(spark, media.hls_hex(F.lit(h), F.lit(li), F.lit(s))) == "#%02x%02x%02x" % (int(r * 255), int(g * 255), int(b * 255))
    assert one(spark, media.hls_hex(F.lit(10.0), F.lit(50.0), F.lit(1.9))) is None


def test_harmony(spark):
    p = [[], [(255, 0, 0)], [(255, 0, 0), (255, 90, 0)], [(255, 0, 0), (0, 255, 255)], [(255, 0, 0), (0, 255, 0)], [(255, 0, 0), (128, 255, 0)], [(9, 9, 9), (255, 0, 0)]]
    df = spark.createDataFrame([(i, [(list(c), 0.5) for c in x]) for i, x in enumerate(p)] + [(99, None)], "i int, p array<struct<rgb: array<int>, weight: double>>")
    got = [r.h for r in df.orderBy("i").select(media.harmony(F.col("p")).alias("h")).collect()]
    assert got == ["monochromatic", "monochromatic", "analogous", "complementary", "triadic", "mixed", "monochromatic", None]


def test_xmp(spark):
    text = '<x crs:Exposure2012="+0.50" crs:Flag="1.0"> <crs:Contrast2012>7</crs:Contrast2012><crs:Flag>0</crs:Flag>'
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(media.xmp_entries(F.col("t")).alias("m"))
    got = [r.m for r in df.collect()]
    assert got == [{"Exposure2012": "+0.50", "Flag": "1", "Contrast2012": "7"}, {}, None]


def test_intensity(spark):
    df = spark.createDataFrame([({"a": "-5", "b": "2.5", "c": "x"},), ({},), ({"b": "1"},)], "m map<string, string>")
    assert [r.x for r in df.select(media.intensity(F.col("m"), ["a", "b", "c"]).alias("x")).collect()] == [7.5, 0.0, 1.0]
    assert [r.x for r in df.select(media.intensity(F.col("m"), ["a", "b", "c"], {"b": 1.0}).alias("x")).collect()] == [6.5, None, 0.0]


def test_labels(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.48, "c": 0.1},), ({"a": -0.2, "b": -0.5},)], "m map<string, double>")
    assert [r.x for r in df.select(media.labels_above(F.col("m")).alias("x")).collect()] == [["a", "b"], ["a"]]


def test_quality(spark):
    standard = [16, 11, 10, 16, 24, 40, 51, 61]
    for q in (30, 50, 75, 90):
        scale = 5000 / q if q < 50 else 200 - 2 * q
        table = [int((s * scale + 50) // 100) for s in standard]
        got = one(spark, media.quality_factor(F.array(*[F.lit(t) for t in table]), standard))
        assert abs(got - q) <= 2
    assert one(spark, media.quality_factor(F.array(F.lit(1)), standard)) is None


def test_pose(spark):
    def ys(ankle):
        y = [0.5] * 17
        y[5] = y[6] = 0.2
        y[11] = y[12] = 0.4
        y[15] = y[16] = ankle
        return y

    df = spark.createDataFrame([(0, ys(0.7)), (1, ys(0.55)), (2, ys(0.45)), (3, ys(0.4)), (4, [0.1]), (5, None)], "i int, y array<double>")
    assert [r.p for r in df.orderBy("i").select(media.pose(F.col("y")).alias("p")).collect()] == ["standing", "sitting", "crouching", "lying", None, None]


def test_palettes_and_places(spark):
    rows = [("g", "h1", 0, 10, 10, 10, 0.5), ("g", "h1", 1, 20, 20, 20, 0.25), ("g", "h2", 0, 200, 0, 0, 0.6), ("g", "h2", 1, 10, 10, 10, 0.1)]
    df = spark.createDataFrame(rows, "g string, hash string, pos int, r int, g2 int, b int, weight double").withColumnRenamed("g", "grp").withColumnRenamed("g2", "g")
    assert [(r.hex, r.weight) for r in media.merged_palettes(df, "grp").orderBy("place").collect()] == [("#0a0a0a", 0.85), ("#c80000", 0.6)]
    assert one(spark, media.signed_degrees(F.array(F.lit(10.0), F.lit(30.0), F.lit(0.0)), F.lit("S"))) == -10.5
    assert media.farthest_first(np.array([[1.0, 0], [0.9, 0.1], [0, 1], [-1, 0]])) == [0, 3, 2]


def test_inference_retries_row_by_row(spark):
    df = spark.createDataFrame([("a", 1), ("b", -1), ("c", 3)], "hash string, v int").coalesce(1)

    def load():
        def model(values):
            if any(v < 0 for v in values):
                raise ValueError
            return [(v * 2,) for v in values]

        return model

    assert {r.hash: r.y for r in media.infer(df, "v", load, "hash string, y int").collect()} == {"a": 2, "b": None, "c": 6}

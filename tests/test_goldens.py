"""Every arm of the record model's rules, by hand: the value on either side of each limit."""

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import assets, media
from shutterlake.functions import portable as p

CASES = {
    "time_of_day": (p.time_of_day, {None: None, 0: "night", 4: "night", 5: "golden_hour", 7: "golden_hour", 8: "morning_evening", 9: "morning_evening", 10: "midday", 15: "midday", 16: "morning_evening", 17: "golden_hour", 19: "golden_hour", 20: "night", 23: "night"}),
    "caption_time": (p.caption_time, {None: "afternoon", 4: "night", 5: "morning", 9: "morning", 10: "afternoon", 15: "afternoon", 16: "evening", 19: "evening", 20: "night"}),
    "season": (p.season, {None: "summer", 1: "winter", 2: "winter", 3: "spring", 5: "spring", 6: "summer", 8: "summer", 9: "autumn", 11: "autumn", 12: "winter"}),
    "focal": (p.focal_category, {None: None, 34.9: "wide", 35.0: "normal", 70.0: "normal", 70.1: "telephoto"}),
    "depth": (p.depth_category, {None: None, 2.79: "shallow", 2.8: "mid", 7.99: "mid", 8.0: "deep"}),
    "light": (p.light_category, {None: None, 400: "bright", 401: "indoor", 1600: "indoor", 1601: "low_light"}),
    "shutter": (p.shutter_category, {None: None, 1 / 500: "freeze", 0.0021: "hand", 1 / 60: "hand", 0.0167: "slow", 1 / 15: "slow", 0.0667: "bulb"}),
    "score": (p.score_bucket, {None: None, 0.0: "low", 32.9: "low", 33.0: "mid", 66.0: "mid", 66.1: "high", 100.0: "high"}),
    "horizon": (p.horizon_bucket, {None: "none", 0.329: "high", 0.33: "mid", 0.66: "mid", 0.661: "low"}),
    "framing": (p.framing_tier, {None: None, 0.249: "tight", 0.25: "medium", 0.55: "medium", 0.551: "wide"}),
    "hue": (p.hue_band, {None: None, 0.0: "red", 19.9: "red", 20.0: "orange", 44.9: "orange", 45.0: "yellow", 70.0: "green", 149.9: "green", 150.0: "cyan/teal", 200.0: "blue", 259.9: "blue", 260.0: "purple", 289.9: "purple", 290.0: "magenta", 339.9: "magenta", 340.0: "red", 380.0: "orange", -20.0: "red"}),
    "zoom": (p.is_zoom, {"24-70mm": True, "24–70 mm": True, "50mm f/1.8": False, "Vario-Lens": False, None: None}),
    "ramp": (lambda x: p.ramp(x, 0.35, 0.65), {None: 0.0, 0.35: 0.0, 0.5: 0.5, 0.65: 1.0, 0.9: 1.0}),
}


@pytest.mark.parametrize("name", CASES)
def test_arms(spark, name):
    rule, cases = CASES[name]
    kind = "string" if name == "zoom" else "double"
    rows = spark.createDataFrame([(i, x if x is None or kind == "string" else float(x)) for i, x in enumerate(cases)], f"i int, x {kind}")
    got = {r.i: r.y for r in rows.selectExpr("i", f"{rule('x')} AS y").collect()}
    assert [got[i] if not isinstance(got[i], type(None)) and name == "ramp" and float(got[i]) == got[i] else got[i] for i in range(len(cases))] == list(cases.values())


def test_devices(spark):
    cases = [("Apple", "x", "phone"), ("NIKON CORPORATION", "D850", "mirrorless"), ("Canon", "EOS 90D", "dslr"), ("Canon", "EOS R5", "mirrorless"), ("RICOH", "K-1", "dslr"), ("Velora", None, "other"), (None, "Kite", "unknown"), (None, None, "unknown"), ("", "", "unknown")]
    rows = spark.createDataFrame([(i, m, o) for i, (m, o, _) in enumerate(cases)], "i int, make string, model string")
    assert [r.y for r in rows.selectExpr("i", f"{p.device_class('make', 'model')} AS y").orderBy("i").collect()] == [c[2] for c in cases]


def test_poses(spark):
    def ys(shoulder, hip, ankle):
        out = [1.0] * 17
        for at, y in ((5, shoulder), (6, shoulder), (11, hip), (12, hip), (15, ankle), (16, ankle)):
            out[at] = float(y)
        return out

    cases = [(ys(10, 20, 33), "standing"), (ys(10, 20, 32), "sitting"), (ys(10, 20, 25), "crouching"), (ys(10, 20, 21), "lying"), (ys(20, 10, 23), "standing"), (ys(10, 20, 5), "standing"), (ys(0, 20, 30), None), (ys(10, 0, 30), None), ([1.0] * 16, None), (None, None)]
    rows = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(cases)], "i int, ys array<double>")
    assert [r.y for r in rows.select("i", media.pose(F.col("ys")).alias("y")).orderBy("i").collect()] == [c[1] for c in cases]


def test_harmonies_and_merges(spark):
    hue = {0: [255, 0, 0], 30: [255, 128, 0], 100: [85, 255, 0], 120: [0, 255, 0], 180: [0, 255, 255], "grey": [90, 90, 90]}
    cases = [([0, 30], "analogous"), ([0, 180], "complementary"), ([0, 120], "triadic"), ([0, 100], "mixed"), ([0, "grey"], "monochromatic"), ([], "monochromatic"), ([0, 30, "grey", "grey", 180], "analogous")]
    rows = spark.createDataFrame([(i, [(hue[h], 0.2) for h in hs]) for i, (hs, _) in enumerate(cases)], "i int, p array<struct<rgb: array<int>, weight: double>>")
    assert [r.y for r in rows.select("i", media.harmony(F.col("p")).alias("y")).orderBy("i").collect()] == [c[1] for c in cases]
    # a colour joins the nearest one within reach, not the first: 28 is nearer to 40 than to 0; a distance of 30 is out of reach
    swatches = spark.createDataFrame([("g", "a", i, x, 0, 0, w) for i, (x, w) in enumerate([(0, 1.0), (40, 1.0), (28, 5.0), (70, 2.0)])], "album string, hash string, pos int, r int, g int, b int, weight double")
    got = {r.hex: r.weight for r in media.merged_palettes(swatches, "album").collect()}
    assert got == {"#000000": 1.0, "#280000": 6.0, "#460000": 2.0}


def test_rationals_and_stamps(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["[28, 10]", "2.8", "[1, 0]", "x", None, "[1]", "50"])], "i int, t string")
    assert [r.y for r in rows.select("i", assets.rational(F.col("t")).alias("y")).orderBy("i").collect()] == [2.8, 2.8, None, None, None, None, 50.0]
    stamps = spark.createDataFrame([(i, t) for i, t in enumerate(["2024:05:17 14:03:22", "2024:13:17 14:03:22", "2024-05-17 14:03:22", None])], "i int, t string")
    assert [r.y and r.y.hour for r in stamps.select("i", assets.exif_stamp(F.col("t")).alias("y")).orderBy("i").collect()] == [14, None, None, None]


def test_settings_resolve_in_order(spark):
    a, e = '<x crs:Exposure2012="+0.50" crs:Name="Flat"/>', "<crs:Exposure2012>1.0</crs:Exposure2012><crs:Texture>7</crs:Texture>"
    assets_ = [("{}", None), ('{"payload": {"develop": {"xmpCameraRaw": "' + e.replace('"', '\\"') + '"}}}', a), ('{"payload": {"develop": {"xmpCameraRaw": "<crs:Texture>7</crs:Texture>"}}}', "no settings"), ("not json", a + e)]
    rows = spark.createDataFrame([(i, j, f) for i, (j, f) in enumerate(assets_)], "i int, asset string, fetched string")
    got = [r.d for r in assets.parsed(rows).select("i", assets.develop(F.col("fetched")).alias("d")).orderBy("i").collect()]
    assert got == [{}, {"Exposure2012": "+0.50", "Name": "Flat"}, {"Texture": "7"}, {"Exposure2012": "+0.50", "Name": "Flat", "Texture": "7"}]

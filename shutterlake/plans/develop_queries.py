"""Queries over develop settings, with SQL of their own.

The tables hold no develop settings. ``SETTINGS`` makes them up from the records' measurements, in the shape a parsed asset has:
a map of names to texts in which some settings are missing, empty for a tenth of the remote records and null for local ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import develop as dev
from shutterlake.operators import records as rec
from shutterlake.operators.aggregates import grouped, histogram, summary, top_per
from shutterlake.plans.library_queries import ORACLES, QUERIES, R, over  # noqa: F401
from shutterlake.sources.tables import table

CHANNELS = ["Red", "Orange", "Yellow", "Green", "Aqua", "Blue", "Purple", "Magenta"]
SETTINGS = {
    "Exposure2012": "floor(bright * 400 - 200) / 100", "Highlights2012": "0 - floor(highlights * 1000)", "Shadows2012": "floor(shadows * 800)", "Whites2012": "focal % 41 - 20", "Blacks2012": "0 - iso % 37",
    "Contrast2012": "floor(contrast * 100) - 20", "Clarity2012": "floor(clutter * 60)", "Texture": "floor(symmetry * 40) - 10", "Dehaze": "floor(space * 20) - 5", "Vibrance": "floor(warm * 60)", "Saturation": "floor(sat * 60) - 20",
    "Temperature": "4000 + floor(warm * 3000)", "Exposure": "floor(bright * 400 - 200) / 100", "Contrast": "floor(contrast * 100) - 20", "Highlights": "0 - floor(highlights * 1000)", "Shadows": "floor(shadows * 800)", "Whites": "focal % 41 - 20",
    "Sharpness": "iso % 90", "LuminanceSmoothing": "iso % 25", "ColorNoiseReduction": "CASE WHEN iso > 0 THEN 25 END", "GrainAmount": "focal % 60", "PostCropVignetteAmount": "0 - focal % 50",
    "SplitToningShadowHue": "focal * 7 % 360", "SplitToningShadowSaturation": "iso % 11", "SplitToningHighlightHue": "iso % 360", "SplitToningHighlightSaturation": "focal % 13", "SplitToningBalance": "focal % 30 - 15",
    "ColorGradeMidtoneHue": "iso * 3 % 360", "ColorGradeMidtoneSat": "focal % 20", "ColorGradeShadowLum": "focal % 9 - 4", "ColorGradeMidtoneLum": "iso % 9 - 4", "ColorGradeHighlightLum": "iso % 7 - 3",
    "HasCrop": "CASE WHEN abs(tilt) > 1 THEN 'true' END", "ToneCurveName2012": "CASE WHEN contrast > 0.2 THEN 'Custom' ELSE 'Linear' END", "LensProfileEnable": "CASE WHEN lens IS NOT NULL THEN '1' ELSE '0' END",
    "WhiteBalance": "CASE WHEN warm > cool THEN 'Auto' ELSE 'As Shot' END", "PerspectiveUpright": "CASE focal % 3 WHEN 0 THEN '0' WHEN 1 THEN 'Off' WHEN 2 THEN '4' END", "AutoLateralCA": "CASE WHEN iso % 2 = 0 THEN '1' ELSE '0' END",
    "CameraProfile": "CASE focal % 4 WHEN 0 THEN 'Adobe Color' WHEN 1 THEN 'Camera Portrait' WHEN 2 THEN ' Film 400 ' END",
} | {f"HueAdjustment{c}": f"focal % {7 + i} - 3" for i, c in enumerate(CHANNELS[:6])} | {f"SaturationAdjustment{c}": f"iso % {11 + i} - 5" for i, c in enumerate(CHANNELS)} | {f"LuminanceAdjustment{c}": f"floor(bright * 10) - {i}" for i, c in enumerate(CHANNELS)}
#: What an asset also has: pick flag, colour label and keywords.
PICK = "CASE WHEN rating >= 4 THEN 1 WHEN rating <= 1 THEN -1 WHEN rating IS NOT NULL THEN 0 END"
SHARP = "floor(isolation * 100) / 10"


def settings(photos: DataFrame) -> DataFrame:
    """The records with ``develop``, ``pick``, ``sharp``, ``color_label`` and ``keywords``."""
    pairs = ", ".join(f"'{k}', CAST({e} AS string)" for k, e in SETTINGS.items())
    made = f"CASE WHEN lr IS NOT NULL THEN map_filter(map({pairs}), (k, v) -> v IS NOT NULL AND rid % 10 <> 0) END AS develop"
    words = "filter(array(make, setting, CASE WHEN person = 'yes' THEN 'People' END, ''), x -> x <> '') AS keywords"
    return rec.records(photos).selectExpr("*", made, f"{PICK} AS pick", f"{SHARP} AS sharp", "CASE rating WHEN 5 THEN 'red' WHEN 4 THEN 'green' ELSE '' END AS color_label", words)


X = R + ", e AS (SELECT *, " + f"{PICK} AS pick, {SHARP} AS sharp FROM r), x AS (SELECT *, " + ", ".join(f'{e} AS "{k}"' for k, e in SETTINGS.items()) + " FROM e WHERE lr IS NOT NULL AND rid % 10 <> 0)"
_CORE = ["Exposure2012", "Highlights2012", "Shadows2012", "Whites2012", "Blacks2012", "Contrast2012", "Clarity2012", "Texture", "Saturation", "Vibrance"]
_I10 = " + ".join(f'abs(coalesce("{k}", 0))' for k in _CORE)
_I11 = _I10 + ' + abs(coalesce("Dehaze", 0))'
_AUTO = "CAST(\"WhiteBalance\" = 'Auto' AS int), CAST(coalesce(\"PerspectiveUpright\", '0') = '4' AS int), CAST(\"LensProfileEnable\" = '1' AS int), CAST(\"AutoLateralCA\" = '1' AS int)".split("), ")
_AUTO = [a if a.endswith(")") else a + ")" for a in _AUTO]


def asked(sql: str | None):
    """Register a query over ``settings``; its SQL follows the made-up settings as columns of x (all records: e)."""

    def register(f):
        over("", X + sql if sql else None, f.__name__)(lambda spark, folder: f(settings(table(spark, folder, "photos"))))
        return f

    return register


def _long(keys: list[str], extra: str = "") -> str:
    # some names are those of measurements but for their case; their values are those of the suffixed settings
    column = lambda k: f"{k}2012" if k in ("Contrast", "Highlights", "Shadows") else k
    return " UNION ALL ".join(f"SELECT {extra}'{k}' AS slider, CAST(\"{column(k)}\" AS double) AS value FROM x" for k in keys)


_PLAIN = ["Exposure", "Contrast", "Highlights", "Shadows", "Whites", "Vibrance", "Saturation", "Sharpness", "LuminanceSmoothing", "ColorNoiseReduction"]


@asked(f", u AS ({_long(_PLAIN)}) SELECT slider, round(avg(value) + 1e-9, 4) AS mean, count(value) AS n FROM u GROUP BY 1 HAVING count(value) > 0")
def develop_means(rows):
    return dev.slider_means(rows)


@asked(f", u AS ({_long(_PLAIN, 'unnest(labels) AS label, ')}) SELECT label, slider, round(avg(value) + 1e-9, 4) AS mean, count(value) AS n FROM u GROUP BY 1, 2 HAVING count(value) > 0")
def develop_means_by_label(rows):
    return dev.slider_means(rec.exploded(rows), ["label"])


def _hex(h: str, light: float, s: str) -> str:
    """DuckDB: '#rrggbb' of hue, lightness 0-1 and saturation in per cent."""
    m2 = f"({light} * (1 + {s} / 100))" if light <= 0.5 else f"({light} + {s} / 100 - {light} * {s} / 100)"
    m1 = f"(2 * {light} - {m2})"

    def part(shift: str) -> str:
        t = f"(({h} / 360 + {shift}) - floor({h} / 360 + {shift}))"
        return f"CAST(floor(255 * CASE WHEN {t} < 1.0/6 THEN {m1} + ({m2} - {m1}) * {t} * 6 WHEN {t} < 0.5 THEN {m2} WHEN {t} < 2.0/3 THEN {m1} + ({m2} - {m1}) * (2.0/3 - {t}) * 6 ELSE {m1} END) AS int)"

    return f"CASE WHEN {s} >= 2 THEN printf('#%02x%02x%02x', {part('1.0/3')}, {part('0.0')}, {part('-1.0/3')}) END"


_HUE = lambda h: f"CASE WHEN {h} % 360 < 20 OR {h} % 360 >= 340 THEN 'red' WHEN {h} % 360 < 45 THEN 'orange' WHEN {h} % 360 < 70 THEN 'yellow' WHEN {h} % 360 < 150 THEN 'green' WHEN {h} % 360 < 200 THEN 'cyan/teal' WHEN {h} % 360 < 260 THEN 'blue' WHEN {h} % 360 < 290 THEN 'purple' ELSE 'magenta' END"
_TONES = ", ".join(f'round(avg("{k}"), 4) AS {n}' for n, k in (("sh", "SplitToningShadowHue"), ("ss", "SplitToningShadowSaturation"), ("hh", "SplitToningHighlightHue"), ("hs", "SplitToningHighlightSaturation"), ("mh", "ColorGradeMidtoneHue"), ("ms", "ColorGradeMidtoneSat"), ("b", "SplitToningBalance"), ("sl", "ColorGradeShadowLum"), ("ml", "ColorGradeMidtoneLum"), ("hl", "ColorGradeHighlightLum")))


@asked(f""", m AS (SELECT {_TONES} FROM x), n AS (SELECT *, CASE WHEN ss > 3 THEN {_HUE('sh')} END AS s, CASE WHEN hs > 3 THEN {_HUE('hh')} END AS h FROM m)
    SELECT {_hex('sh', 0.22, 'ss')} AS shadow_color, {_hex('mh', 0.5, 'ms')} AS midtone_color, {_hex('hh', 0.78, 'hs')} AS highlight_color,
    CASE WHEN s IS NOT NULL AND h IS NOT NULL THEN upper(h[1]) || h[2:] || ' highlights · ' || s || ' shadows' WHEN s IS NOT NULL THEN upper(s[1]) || s[2:] || ' shadows' WHEN h IS NOT NULL THEN upper(h[1]) || h[2:] || ' highlights' ELSE 'Neutral (no toning)' END AS style,
    round(coalesce(b, 0) + 1e-9, 1) AS balance, round(coalesce(sl, 0) + 1e-9, 1) AS shadow_shift, round(coalesce(ml, 0) + 1e-9, 1) AS midtone_shift, round(coalesce(hl, 0) + 1e-9, 1) AS highlight_shift FROM n""")
def split_toning(rows):
    return dev.split_toning(rows)


_SIG = ", u AS (" + _long(["Exposure2012", "Highlights2012", "Shadows2012", "Whites2012", "Blacks2012", "Contrast2012", "Texture", "Clarity2012", "Dehaze", "Vibrance", "Saturation", "Temperature"]) + "), m AS (SELECT slider, quantile_cont(value, 0.5) AS m, stddev_pop(value) AS s FROM u WHERE value IS NOT NULL GROUP BY 1)"


@asked(_SIG + """ SELECT slider, CASE WHEN slider IN ('Texture', 'Clarity2012', 'Dehaze') THEN 'presence' WHEN slider IN ('Vibrance', 'Saturation', 'Temperature') THEN 'color' ELSE 'tone' END AS kind, CASE WHEN slider = 'Temperature' THEN round(m, 0) ELSE round(m, 1) END AS median,
    CASE WHEN slider = 'Temperature' THEN round(s, 0) ELSE round(s, 1) END AS std, round(CASE slider WHEN 'Temperature' THEN (m - 5500) / 5500 WHEN 'Exposure2012' THEN m / 5 ELSE m / 100 END, 3) AS norm FROM m""")
def signature_edit(rows):
    return dev.signature(rows)


@asked(_SIG + """, v AS (SELECT coalesce(max(CASE WHEN slider = 'Highlights2012' THEN round(m, 1) END), 0) AS hl, coalesce(max(CASE WHEN slider = 'Shadows2012' THEN round(m, 1) END), 0) AS sh, coalesce(max(CASE WHEN slider = 'Vibrance' THEN round(m, 1) END), 0) AS vib,
    coalesce(max(CASE WHEN slider = 'Saturation' THEN round(m, 1) END), 0) AS sat, coalesce(max(CASE WHEN slider = 'Temperature' THEN round(m, 0) END), 5500) AS temp, coalesce(max(CASE WHEN slider = 'Exposure2012' THEN round(m, 1) END), 0) AS exp FROM m),
    w AS (SELECT concat_ws('. ', CASE WHEN hl < -40 AND sh > 30 THEN printf('Heavy tonal recovery — pulling highlights (%+.0f) while lifting shadows (%+.0f) for maximum dynamic range', hl, sh) WHEN hl < -20 THEN printf('Highlight recovery (%+.0f)', hl) WHEN sh > 20 THEN printf('Shadow lifting (%+.0f)', sh) END,
    CASE WHEN vib > 20 AND sat < 0 THEN printf('Rich selective colour — vibrance %+.0f over global saturation (%+.0f) keeps skin tones natural', vib, sat) WHEN vib > 15 THEN printf('Vivid colour (vibrance %+.0f)', vib) END,
    CASE WHEN temp > 6200 THEN printf('Warm white balance (%.0f k)', temp) WHEN temp < 4800 THEN printf('Cool white balance (%.0f k)', temp) END,
    CASE WHEN abs(exp) > 0.4 THEN printf('%s exposure by %.1f stop%s', CASE WHEN exp > 0 THEN 'Brightening' ELSE 'Darkening' END, abs(exp), CASE WHEN abs(exp) >= 2 THEN 's' ELSE '' END) END) AS t FROM v) SELECT CASE WHEN t = '' THEN '' ELSE t || '.' END AS narrative FROM w""")
def signature_narrative(rows):
    return dev.narrative(dev.signature(rows))


@asked(", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, " + (f'"HueAdjustment{c}"' if i < 6 else "NULL") + f' AS h, "SaturationAdjustment{c}" AS s, "LuminanceAdjustment{c}" AS l FROM x' for i, c in enumerate(CHANNELS)) + ") SELECT channel, coalesce(round(avg(h) + 1e-9, 2), 0) AS hue, coalesce(round(avg(s) + 1e-9, 2), 0) AS sat, coalesce(round(avg(l) + 1e-9, 2), 0) AS lum FROM u GROUP BY 1")
def hsl_fingerprint(rows):
    return dev.hsl_fingerprint(rows)


@asked(f" SELECT count(*) AS n, round(avg({_I10}) + 1e-9, 1) AS mean, round(stddev_pop({_I10}) + 1e-9, 1) AS std FROM x")
def edit_intensity(rows):
    return summary(dev.edited(rows), {"n": "count(*)", "mean": f"round(avg({dev.INTENSITY10}) + 1e-9, 1)", "std": f"round(stddev_pop({dev.INTENSITY10}) + 1e-9, 1)"})


@asked(f", i AS (SELECT CAST(least(9, floor(({_I10}) / 50)) AS bigint) AS b FROM x) SELECT t.b AS bucket, count(i.b) AS n FROM range(0, 10) t(b) LEFT JOIN i ON i.b = t.b GROUP BY 1")
def edit_intensity_histogram(rows):
    return histogram(dev.edited(rows).selectExpr(f"{dev.INTENSITY10} AS value"), "value", 50, 10)


@asked(f", u AS (SELECT unnest(labels) AS label, {_I10} AS i FROM x), m AS (SELECT label, avg(i) AS a, count(*) AS n FROM u GROUP BY 1) SELECT label, n, round(a + 1e-9, 1) AS mean, a = max(a) OVER () AS most_edited FROM m")
def edit_intensity_by_label(rows):
    m = grouped(rec.exploded(dev.edited(rows)), ["label"], {"n": "count(*)", "a": f"avg({dev.INTENSITY10})"})
    return m.selectExpr("label", "n", "round(a + 1e-9, 1) AS mean", "a = max(a) over () AS most_edited")


@asked(f""", i AS (SELECT {_I10} AS i, score FROM x WHERE score IS NOT NULL), l AS (SELECT min(i) AS lo, max(i) AS hi, count(*) AS n FROM i), b AS (SELECT CAST(least(4, floor((i - lo) / (hi - lo) * 5)) AS bigint) AS b, score FROM i, l WHERE hi > lo AND n >= 2)
    SELECT t.b AS bin, count(score) AS n, round(avg(score) + 1e-9, 2) AS mean FROM range(0, 5) t(b) LEFT JOIN b ON b.b = t.b WHERE (SELECT hi > lo AND n >= 2 FROM l) GROUP BY 1""")
def score_by_edit_intensity(rows):
    i = dev.edited(rows).selectExpr(f"{dev.INTENSITY10} AS i", "score").where("score IS NOT NULL")
    limits = i.agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n")).where("hi > lo AND n >= 2")
    binned = i.crossJoin(F.broadcast(limits)).groupBy(F.expr("CAST(least(4, floor((i - lo) / (hi - lo) * 5)) AS bigint)").alias("bin")).agg(F.count("*").alias("n"), F.expr("round(avg(score) + 1e-9, 2)").alias("mean"))
    return limits.selectExpr("explode(sequence(0L, 4L)) AS bin").join(binned, "bin", "left").na.fill(0, ["n"])


@asked(f" SELECT count(score) AS pairs, CASE WHEN count(score) >= 10 AND stddev_pop(CASE WHEN score IS NOT NULL THEN {_I11} END) > 0 AND stddev_pop(score) > 0 THEN round(corr({_I11}, score), 3) + 0.0 END AS r FROM x")
def edit_score_corr(rows):
    i = dev.edited(rows).selectExpr(f"{dev.INTENSITY} AS i", "score").where("score IS NOT NULL")
    return summary(i, {"pairs": "count(*)", "r": "CASE WHEN count(*) >= 10 AND stddev_pop(i) > 0 AND stddev_pop(score) > 0 THEN round(corr(i, score), 3) + 0.0D END"})


@asked(""", p AS (SELECT pick, count(score) AS a, count(sharp) AS s, CAST(coalesce(sum(len(labels)), 0) AS bigint) AS l, round(avg(score) + 1e-9, 2) AS mean_score, round(avg(sharp) + 1e-9, 2) AS mean_sharp FROM e WHERE pick IS NOT NULL GROUP BY 1),
    c AS (SELECT pick, label, row_number() OVER (PARTITION BY pick ORDER BY count(*) DESC, label) AS i FROM (SELECT pick, unnest(labels) AS label FROM e WHERE pick IS NOT NULL) GROUP BY 1, 2)
    SELECT CAST(p.pick AS bigint) AS pick, CASE WHEN a > 0 THEN a WHEN s > 0 THEN s ELSE l END AS n, mean_score, mean_sharp, coalesce((SELECT string_agg(label, ', ' ORDER BY i) FROM c WHERE c.pick = p.pick AND i <= 3), '') AS top_labels FROM p""")
def pick_summary(rows):
    per = grouped(rows, {"pick": "CAST(pick AS bigint)"}, {"a": "count(score)", "s": "count(sharp)", "l": "coalesce(sum(size(labels)), 0)", "mean_score": "round(avg(score) + 1e-9, 2)", "mean_sharp": "round(avg(sharp) + 1e-9, 2)"})
    top = top_per(grouped(rec.exploded(rows), {"pick": "CAST(pick AS bigint)", "label": "label"}, {"n": "count(*)"}), ["pick"], "n desc, label", 3)
    names = top.groupBy("pick").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x.label), ", ").alias("top_labels"))
    return per.join(names, "pick", "left").selectExpr("pick", "CASE WHEN a > 0 THEN a WHEN s > 0 THEN s ELSE l END AS n", "mean_score", "mean_sharp", "coalesce(top_labels, '') AS top_labels")


@asked(", u AS (SELECT unnest(labels) AS label, pick FROM e WHERE pick IS NOT NULL) SELECT label, count(*) AS n, round(100.0 * count(CASE WHEN pick = 1 THEN 1 END) / count(*), 1) AS pick_pct FROM u GROUP BY 1")
def pick_rate_by_label(rows):
    return grouped(rec.exploded(rows.where("pick IS NOT NULL")), ["label"], {"n": "count(*)", "pick_pct": "CAST(round(100.0 * count_if(pick = 1) / count(*), 1) AS double)"})


_WORDS = ", k AS (SELECT rid, labels, lower(unnest([x for x in [make, setting, CASE WHEN person = 'yes' THEN 'People' END] if x <> ''])) AS word FROM e)"


@asked(_WORDS + " SELECT word, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, word LIMIT 30")
def top_keywords(rows):
    return top_per(grouped(rows.selectExpr("explode(transform(keywords, k -> lower(k))) AS word"), ["word"], {"n": "count(*)"}), [], "n desc,word", 30)


@asked(_WORDS + ", c AS (SELECT label, word, count(*) AS n FROM (SELECT unnest(labels) AS label, word FROM k) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 5")
def keywords_by_label(rows):
    words = rec.exploded(rows).selectExpr("label", "explode(keywords) AS word").selectExpr("label", "lower(word) AS word")
    return top_per(grouped(words, ["label", "word"], {"n": "count(*)"}), ["label"], "n desc, word", 5)


@asked(" SELECT CASE rating WHEN 5 THEN 'red' WHEN 4 THEN 'green' END AS color_label, count(*) AS n FROM e WHERE rating IN (4, 5) GROUP BY 1")
def color_labels(rows):
    return grouped(rows.where("color_label <> ''"), ["color_label"], {"n": "count(*)"})


_J = ["Exposure2012", "Highlights2012", "Shadows2012", "Whites2012", "Blacks2012", "Contrast2012", "Clarity2012", "Texture", "Dehaze", "Saturation", "Vibrance", "GrainAmount", "PostCropVignetteAmount", "Sharpness", "LuminanceSmoothing", "ColorNoiseReduction"]
_PCT = lambda c: f"round(100.0 * count(CASE WHEN {c} THEN 1 END) / count(*) + 1e-9, 1)"
_HSL = " + ".join([f'abs(coalesce("HueAdjustment{c}", 0))' for c in CHANNELS[:6]] + [f'abs(coalesce("{a}Adjustment{c}", 0))' for c in CHANNELS for a in ("Saturation", "Luminance")])


@asked(" SELECT substr(ym, 1, 7) AS month, count(*) AS n, " + ", ".join(f'round(avg("{k}") + 1e-9, 3) AS {k.lower()}' for k in _J) + f""", round(avg({_HSL}) + 1e-9, 1) AS hsl_intensity, round(avg({_I11}) + 1e-9, 1) AS edit_intensity, {_PCT('"SplitToningShadowSaturation" > 3 OR "SplitToningHighlightSaturation" > 3')} AS toning_pct,
    {_PCT('"HasCrop" IS NOT NULL')} AS crop_pct, {_PCT('"ToneCurveName2012" = ' + "'Custom'")} AS curve_pct, {_PCT('"LensProfileEnable" = ' + "'1'")} AS lens_pct, {_PCT('"WhiteBalance" = ' + "'Auto'")} AS wb_pct,
    round((""" + " + ".join(f"{_PCT(a + ' = 1')} / 100" for a in _AUTO) + ") / 4 + 1e-9, 3) AS automation FROM x WHERE length(ym) >= 7 GROUP BY 1")
def edit_journey(rows):
    return dev.journey(rows)


@asked(f""", o AS (SELECT *, row_number() OVER (ORDER BY coalesce(ym, ''), rid) AS i, count(*) OVER () AS total FROM x) SELECT CASE WHEN i <= total // 2 THEN 'early' ELSE 'recent' END AS half, count(*) AS n, round(avg({_I11}) + 1e-9, 1) AS intensity, round(avg(score) + 1e-9, 2) AS score,
    round(avg(({' + '.join(_AUTO)}) / 4.0) + 1e-9, 3) AS automation FROM o WHERE total >= 4 GROUP BY 1""")
def edit_halves(rows):
    """Halves by capture month; a row's place is its month's offset plus its place within, so that no window spans all records."""
    own = dev.edited(rows).selectExpr("coalesce(ym, '') AS ym", "rid", "score", f"{dev.INTENSITY} AS i", f"{dev.AUTOMATION} AS a")
    months = own.groupBy("ym").agg(F.count("*").alias("m")).selectExpr("ym", "coalesce(sum(m) over (order by ym rows between unbounded preceding and 1 preceding), 0) AS before", "sum(m) over () AS total")
    placed = own.join(months, "ym").withColumn("at", F.expr("before + row_number() over (partition by ym order by rid)")).where("total >= 4")
    return grouped(placed, {"half": "CASE WHEN at <= total div 2 THEN 'early' ELSE 'recent' END"}, {"n": "count(*)", "intensity": "round(avg(i) + 1e-9, 1)", "score": "round(avg(score) + 1e-9, 2)", "automation": "round(avg(a) + 1e-9, 3)"})


@asked(""", p AS (SELECT trim("CameraProfile") AS profile FROM x WHERE trim("CameraProfile") <> '') SELECT profile, count(*) AS n, (SELECT round(100.0 * count(CASE WHEN profile = 'Film 400' THEN 1 END) / count(*), 1) FROM p) AS third_party_pct FROM p GROUP BY 1 ORDER BY n DESC, profile LIMIT 5""")
def camera_profiles(rows):
    return dev.profiles(rows)


@asked(f""", a AS (SELECT coalesce(avg("GrainAmount"), 0) AS g, coalesce(avg("Clarity2012"), 0) AS c, coalesce(avg("Saturation"), 0) AS s, coalesce(avg("Vibrance"), 0) AS v, coalesce(avg("PostCropVignetteAmount"), 0) AS p, 100.0 * count(CASE WHEN "ToneCurveName2012" = 'Custom' THEN 1 END) / count(*) AS t,
    coalesce(round(100.0 * count(CASE WHEN trim("CameraProfile") = 'Film 400' THEN 1 END) / nullif(count("CameraProfile"), 0), 1), 0) AS o, avg(({' + '.join(_AUTO)}) / 4.0) AS m, 100.0 * count(CASE WHEN "PerspectiveUpright" = '4' THEN 1 END) / count(*) AS u FROM x),
    l AS (SELECT unnest(['film_grain', 'high_clarity', 'muted_palette', 'vivid_palette', 'heavy_vignette', 'custom_curves', 'preset_heavy', 'automation_reliant', 'geometry_corrector']) AS signature, unnest([g > 20, c > 20, s < -10, s > 20 OR v > 30, p < -20, t > 40, o > 50, m > 0.7, u > 20]) AS fired FROM a) SELECT signature FROM l WHERE fired""")
def style_signatures(rows):
    return dev.style_signatures(rows)


_T = "round(avg(\"SplitToningShadowHue\"), 4) AS sh, round(avg(\"SplitToningShadowSaturation\"), 4) AS ss, round(avg(\"SplitToningHighlightHue\"), 4) AS hh, round(avg(\"SplitToningHighlightSaturation\"), 4) AS hs, round(avg(\"ColorGradeMidtoneHue\"), 4) AS mh, round(avg(\"ColorGradeMidtoneSat\"), 4) AS ms"


@asked(f", a AS (SELECT unnest(albums) AS album, * FROM x), m AS (SELECT album, count(*) AS n, round(avg({_I10}) + 1e-9, 1) AS intensity, {_T} FROM a GROUP BY 1) SELECT album, n, intensity, {_hex('sh', 0.25, 'ss')} AS shadow, {_hex('mh', 0.5, 'ms')} AS midtone, {_hex('hh', 0.75, 'hs')} AS highlight FROM m")
def album_tones(rows):
    own = rec.exploded(dev.edited(rows), "albums", "album")
    return grouped(own, ["album"], {"n": "count(*)", "intensity": f"round(avg({dev.INTENSITY10}) + 1e-9, 1)"}).join(dev.tonal_hex(own, "album"), "album")


@asked(", u AS (SELECT unnest(labels) AS label, coalesce(len(albums), 0) > 0 AS inside FROM e WHERE albums IS NOT NULL) SELECT label, count(*) AS n, round(100.0 * count(CASE WHEN inside THEN 1 END) / count(*), 1) AS curated_pct FROM u GROUP BY 1")
def curation_by_label(rows):
    return grouped(rec.exploded(rows.where("albums IS NOT NULL")), ["label"], {"n": "count(*)", "curated_pct": "CAST(round(100.0 * count_if(size(albums) > 0) / count(*), 1) AS double)"})


@over("", r"""WITH w AS (SELECT CASE WHEN regexp_matches(lightroom_capture_date, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.]\d{1,6})?(Z|[+-]\d{2}:\d{2})?$') THEN try_cast(replace(lightroom_capture_date[1:19], 'T', ' ') AS timestamp) END AS c,
    CASE WHEN regexp_matches(lightroom_updated, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.]\d{1,6})?(Z|[+-]\d{2}:\d{2})?$') THEN try_cast(replace(lightroom_updated[1:19], 'T', ' ') AS timestamp) END AS u FROM asset_feed), d AS (SELECT floor((epoch_us(u) - epoch_us(c)) / 86400000000.0) AS d FROM w WHERE c IS NOT NULL AND u IS NOT NULL)
    SELECT CASE WHEN d <= 0 THEN 'same_day' WHEN d <= 7 THEN 'within_week' WHEN d <= 30 THEN 'within_month' ELSE 'later' END AS bucket, count(*) AS n FROM d GROUP BY 1""")
def edit_recency(spark, folder):
    """Days from capture to the last update of deliveries whose stamps are both ISO."""
    feed = table(spark, folder, "asset_feed").select(dev.wall_time("lightroom_capture_date").alias("c"), dev.wall_time("lightroom_updated").alias("u")).where("c IS NOT NULL AND u IS NOT NULL")
    days = "floor((unix_micros(CAST(u AS timestamp)) - unix_micros(CAST(c AS timestamp))) / 86400000000D)"
    return grouped(feed.selectExpr(f"{days} AS d"), {"bucket": "CASE WHEN d <= 0 THEN 'same_day' WHEN d <= 7 THEN 'within_week' WHEN d <= 30 THEN 'within_month' ELSE 'later' END"}, {"n": "count(*)"})

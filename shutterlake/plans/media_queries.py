"""Queries over what extractors measure in the images, with SQL of their own.

The tables hold only part of such measurements. ``media`` makes up the rest - palettes, grids, quantisation tables, key points,
detections, score maps, flash and metering codes, positions - from what they hold, in the shape the extractors give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import media as m
from shutterlake.functions import portable as p
from shutterlake.operators import records as rec
from shutterlake.operators.aggregates import closed, grouped, histogram, share, summary, top_per
from shutterlake.plans.library_queries import R, over
from shutterlake.sources.tables import table

#: The luminance quantisation table of Annex K of the JPEG standard.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
#: Metering modes by code.
METERING = {1: "average", 2: "center_weighted", 3: "spot", 5: "multi_spot", 6: "multi_segment"}
#: Labels whose score opens the search for a subject.
SUBJECTS = ["people and portraits", "animals", "food", "interior"]

_B = {
    "flash_code": "iso % 32", "metering_code": "focal % 8", "mp": "floor(focal * iso / 10) / 100", "bias": "floor((bright - 0.5) * 1000) / 1000", "tonal_shadow": "floor(shadows * 3000) / 1000", "tonal_high": "floor(highlights * 3000) / 1000",
    "c1": "CAST(floor(warm * 255) AS int)", "c2": "CAST(floor(bright * 255) AS int)", "c3": "CAST(floor(cool * 255) AS int)", "c4": "CAST(floor(contrast * 255) AS int)", "c5": "CAST(floor(sat * 255) AS int)",
    "scale": "iso % 180 + 20", "odd": "CASE WHEN focal % 5 = 0 THEN 7 ELSE 0 END", "deg": "rid % 90", "minutes": "rid % 60", "seconds": "rid * 7 % 60", "hip": "10 + rid % 40", "ankle": "10 + rid % 40 + rid % 61", "sharp": "floor(isolation * 100) / 10",
}
_CS = "c1 IS NOT NULL AND c2 IS NOT NULL AND c3 IS NOT NULL AND c4 IS NOT NULL AND c5 IS NOT NULL"
SWATCHES = ["c1, c2, c3", "c2, c1, c5", "c3, c4, c1", "c5, c5, c5"]


def media(photos: DataFrame) -> DataFrame:
    rows = rec.records(photos).selectExpr("*", *[f"{e} AS {n}" for n, e in _B.items()])
    swatch = ", ".join(f"named_struct('rgb', array({c}), 'weight', {w}D)" for c, w in zip(SWATCHES, (0.4, 0.3, 0.2, 0.1)))
    table_ = f"CASE WHEN scale IS NOT NULL THEN transform(array({', '.join(map(str, LUMINANCE))}), k -> CAST(floor((k * scale + 50) / 100) + odd AS int)) END AS quant"
    return rows.selectExpr(
        "*", f"CASE WHEN {_CS} THEN array({swatch}) END AS palette", "CASE WHEN thirds IS NOT NULL THEN array(array(thirds, symmetry, space), array(clutter, isolation, 0D), array(0D, highlights, shadows)) END AS grid", table_,
        "map_from_arrays(array_distinct(labels), transform(array_distinct(labels), l -> (length(l) % 10 + rid % 5) / 20D)) AS scores",
        "transform(labels, l -> named_struct('label', l, 'confidence', (rid * 7 + length(l)) % 100 / 100D)) AS objects",
        "array(0D, 0D, 0D, 0D, 0D, 10D, 10D, 0D, 0D, 0D, 0D, CAST(hip AS double), CAST(hip AS double), 0D, 0D, CAST(ankle AS double), CAST(ankle AS double)) AS heights",
        "CASE WHEN lr IS NOT NULL AND rid % 3 = 0 THEN array(CAST(deg AS double), CAST(minutes AS double), CAST(seconds AS double)) END AS dms", "CASE rid % 2 WHEN 0 THEN 'N' ELSE 'S' END AS ref",
    )


B = R + ", b AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _B.items()) + " FROM r)"


def asked(sql: str | None):
    def register(f):
        over("", B + sql if sql else None, f.__name__)(lambda spark, folder: f(media(table(spark, folder, "photos"))))
        return f

    return register


PCT = lambda c, of="count(*)": f"CAST(round(100.0 * count_if({c}) / nullif({of}, 0), 1) AS double)"


@asked(" SELECT count(flash_code) AS n, round(100.0 * count(CASE WHEN flash_code % 2 = 1 THEN 1 END) / count(flash_code), 1) AS flash_pct FROM b")
def flash_usage(rows):
    return summary(rows, {"n": "count(flash_code)", "flash_pct": PCT("(flash_code & 1) = 1", "count(flash_code)")})


@asked(" SELECT label, count(*) AS n, round(100.0 * count(CASE WHEN flash_code % 2 = 1 THEN 1 END) / count(*), 1) AS flash_pct FROM (SELECT unnest(labels) AS label, flash_code FROM b WHERE flash_code IS NOT NULL) GROUP BY 1")
def flash_by_label(rows):
    return grouped(rec.exploded(rows.where("flash_code IS NOT NULL")), ["label"], {"n": "count(*)", "flash_pct": PCT("(flash_code & 1) = 1")})


@asked(" SELECT CASE metering_code WHEN 1 THEN 'average' WHEN 2 THEN 'center_weighted' WHEN 3 THEN 'spot' WHEN 5 THEN 'multi_spot' WHEN 6 THEN 'multi_segment' ELSE 'other' END AS metering, count(*) AS n FROM b WHERE metering_code IS NOT NULL GROUP BY 1")
def metering_distribution(rows):
    names = F.create_map(*[F.lit(x) for pair in METERING.items() for x in pair])
    named = F.when(F.col("metering_code").isNotNull(), F.coalesce(F.try_element_at(names, F.col("metering_code").cast("int")), F.lit("other")))
    return grouped(rows.withColumn("metering", named), ["metering"], {"n": "count(*)"})


_SHUTTER = "CASE WHEN shutter <= 0.002 THEN 'freeze' WHEN shutter <= 1.0/60 THEN 'hand' WHEN shutter <= 1.0/15 THEN 'slow' ELSE 'bulb' END"


@asked(f", c AS (SELECT {_SHUTTER} AS shutter_class, count(*) AS n FROM b WHERE shutter IS NOT NULL GROUP BY 1) SELECT *, CAST(round_even(100.0 * n / (SELECT sum(n) FROM c), 0) AS double) AS pct, row_number() OVER (ORDER BY n DESC, shutter_class) = 1 AS dominant FROM c")
def shutter_distribution(rows):
    c = grouped(rows, {"shutter_class": p.shutter_category("shutter")}, {"n": "count(*)"})
    return c.selectExpr("*", "CAST(bround(100.0D * n / sum(n) over (), 0) AS double) AS pct", "row_number() over (order by n desc, shutter_class) = 1 AS dominant")


@asked(f" SELECT label, {_SHUTTER} AS shutter_class, count(*) AS n FROM (SELECT unnest(labels) AS label, shutter FROM b WHERE shutter IS NOT NULL) GROUP BY 1, 2")
def shutter_by_label(rows):
    return grouped(rec.exploded(rows), {"label": "label", "shutter_class": p.shutter_category("shutter")}, {"n": "count(*)"})


@asked(""", g AS (SELECT round((deg + minutes / 60.0 + seconds / 3600.0) * CASE rid % 2 WHEN 0 THEN 1 ELSE -1 END, 5) AS lat FROM b WHERE lr IS NOT NULL AND rid % 3 = 0)
    SELECT count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 1) AS pct, min(lat) AS south, max(lat) AS north FROM g""")
def gps_bounds(rows):
    lat = rows.select(m.signed_degrees(F.col("dms"), F.col("ref")).alias("lat"))
    return summary(lat, {"n": "count(lat)", "pct": PCT("lat IS NOT NULL"), "south": "min(lat)", "north": "max(lat)"})


@asked(None)
def gps_sample(rows):
    """At most 500 positions, drawn by hash."""
    return rows.where("dms IS NOT NULL").select("rid", m.signed_degrees(F.col("dms"), F.col("ref")).alias("lat"), "score").orderBy(F.xxhash64("rid", F.lit(42)), "rid").limit(500)


_HSV = ", s AS (" + " UNION ALL ".join(f"SELECT rid, {i} AS pos, {', '.join(f'{c.strip()} AS {n}' for c, n in zip(cs.split(','), 'xyz'))} FROM b WHERE {_CS}" for i, cs in enumerate(SWATCHES)) + """), v AS (SELECT *, greatest(x, y, z) AS hi, greatest(x, y, z) - least(x, y, z) AS d FROM s),
    h AS (SELECT rid, pos, CASE WHEN d = 0 THEN 0.0 WHEN hi = x THEN ((y - z) / d::DOUBLE) / 6 - floor(((y - z) / d::DOUBLE) / 6) WHEN hi = y THEN ((z - x) / d::DOUBLE + 2) / 6 ELSE ((x - y) / d::DOUBLE + 4) / 6 END AS h, CASE WHEN hi = 0 THEN 0.0 ELSE d / hi::DOUBLE END AS s FROM v)"""


@asked(_HSV + ", c AS (SELECT CAST(floor(h * 12) AS bigint) % 12 AS b FROM h WHERE pos = 0 AND s > 0.15) SELECT t.b AS bucket, count(c.b) AS n FROM range(0, 12) t(b) LEFT JOIN c ON c.b = t.b GROUP BY 1")
def hue_histogram(rows):
    first = F.col("palette")[0]["rgb"]
    h, s = m.hue_saturation(first[0], first[1], first[2])
    own = rows.where("palette IS NOT NULL").select(h.alias("h"), s.alias("s")).where("s > 0.15").selectExpr("CAST(floor(h * 12) AS bigint) % 12 AS bucket")
    return closed(grouped(own, ["bucket"], {"n": "count(*)"}), "bucket", list(range(12)), ["n"])


@asked(_HSV + """, k AS (SELECT rid, h * 360 AS h, pos FROM h WHERE s > 0.15), q AS (SELECT a.rid, max(least(abs(a.h - b.h), 360 - abs(a.h - b.h))) AS d FROM k a JOIN k b ON a.rid = b.rid AND a.pos < b.pos GROUP BY 1),
    c AS (SELECT CASE WHEN d IS NULL THEN 'monochromatic' WHEN d < 40 THEN 'analogous' WHEN d > 150 AND d < 215 THEN 'complementary' WHEN d > 100 AND d <= 150 THEN 'triadic' ELSE 'mixed' END AS harmony FROM b LEFT JOIN q USING (rid))
    SELECT harmony, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 1) AS pct FROM c GROUP BY 1""")
def harmony_distribution(rows):
    named = rows.select(F.coalesce(m.harmony(F.col("palette")), F.lit("monochromatic")).alias("harmony"))
    return share(grouped(named, ["harmony"], {"n": "count(*)"}), "n").withColumn("pct", F.col("pct").cast("double"))


@asked(None)
def album_palettes(rows):
    """Six heaviest colours of each album after merging near ones; the merge depends on order."""
    each = rec.exploded(rows.where("palette IS NOT NULL"), "albums", "album").selectExpr("album", "CAST(rid AS string) AS hash", "posexplode(palette) AS (pos, s)")
    return m.merged_palettes(each.selectExpr("album", "hash", "pos", "s.rgb[0] AS r", "s.rgb[1] AS g", "s.rgb[2] AS b", "s.weight AS weight"), "album")


@asked(None)
def palette_swatches(rows):
    """The first forty swatches in order of record and place."""
    return rows.where("palette IS NOT NULL").orderBy("rid").limit(40).selectExpr("rid", "posexplode(palette) AS (pos, s)").selectExpr("rid", "pos", "s.rgb AS rgb").orderBy("rid", "pos").limit(40)


@asked(""", g AS (SELECT [thirds, symmetry, space, clutter, isolation, 0.0, 0.0, highlights, shadows] AS v FROM b WHERE thirds IS NOT NULL), u AS (SELECT generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM g)
    SELECT CAST(i // 3 AS bigint) AS y, CAST(i % 3 AS bigint) AS x, round(avg(u.x) + 1e-9, 4) AS mean FROM u GROUP BY 1, 2""")
def grid_heatmap(rows):
    cells = rows.where("size(grid) = 3 AND size(grid[0]) = 3").selectExpr("posexplode(grid) AS (y, line)").selectExpr("y", "posexplode(line) AS (x, v)")
    return grouped(cells, {"y": "CAST(y AS bigint)", "x": "CAST(x AS bigint)"}, {"mean": "round(avg(v) + 1e-9, 4)"})


@asked(" SELECT round(avg(sharp) + 1e-9, 4) AS sharp, round(stddev_pop(sharp), 4) AS std, round(avg(mp) + 1e-9, 2) AS mp, round(min(mp), 2) AS mp_min, round(max(mp), 2) AS mp_max, round(avg(bias) + 1e-9, 4) AS bias, round(avg(tonal_shadow) + 1e-9, 3) AS tonal_shadow, round(avg(tonal_high) + 1e-9, 3) AS tonal_high, round(100.0 * count(CASE WHEN highlights > 0.02 THEN 1 END) / count(highlights), 1) AS blown_pct FROM b")
def technical_stats(rows):
    return summary(rows, {"sharp": "round(avg(sharp) + 1e-9, 4)", "std": "round(stddev_pop(sharp), 4)", "mp": "round(avg(mp) + 1e-9, 2)", "mp_min": "round(min(mp), 2)", "mp_max": "round(max(mp), 2)", "bias": "round(avg(bias) + 1e-9, 4)", "tonal_shadow": "round(avg(tonal_shadow) + 1e-9, 3)", "tonal_high": "round(avg(tonal_high) + 1e-9, 3)", "blown_pct": PCT("highlights > 0.02", "count(highlights)")})


@asked(" SELECT label, round(avg(sharp) + 1e-9, 2) AS sharp, count(sharp) AS n FROM (SELECT unnest(labels) AS label, sharp FROM b) GROUP BY 1 HAVING count(sharp) > 0")
def sharpness_by_label(rows):
    return grouped(rec.exploded(rows), ["label"], {"sharp": "round(avg(sharp) + 1e-9, 2)", "n": "count(sharp)"}, "n > 0")


@asked(" SELECT label, round(avg((length(label) % 10 + rid % 5) / 20.0) + 1e-9, 4) AS confidence, count(*) AS n FROM (SELECT rid, unnest(labels) AS label FROM b) GROUP BY 1")
def label_confidence(rows):
    return grouped(rec.exploded(rows).withColumn("own", F.try_element_at("scores", "label")), ["label"], {"confidence": "round(avg(own) + 1e-9, 4)", "n": "count(own)"})


@asked(""", g AS (SELECT person = 'yes' OR len([l for l in labels if l IN ('people and portraits', 'animals', 'food', 'interior') AND (length(l) % 10 + rid % 5) / 20.0 >= 0.35]) > 0 AS s, person LIKE 'yes%' AS p FROM b) SELECT count(*) AS n, count(CASE WHEN s THEN 1 END) AS subject_n, count(CASE WHEN p THEN 1 END) AS pose_n, round(100.0 * (count(*) - count(CASE WHEN s THEN 1 END)) / count(*), 1) AS filtered_pct FROM g""")
def subject_gates(rows):
    wanted = ", ".join(f"'{s}'" for s in SUBJECTS)
    gate = f"coalesce(person = 'yes', false) OR coalesce(exists(array({wanted}), l -> try_element_at(scores, l) >= 0.35), false)"
    return summary(rows.selectExpr(f"{gate} AS s", "person LIKE 'yes%' AS p"), {"n": "count(*)", "subject_n": "count_if(s)", "pose_n": "count_if(p)", "filtered_pct": "CAST(round(100.0 * (count(*) - count_if(s)) / count(*), 1) AS double)"})


_K = "[" + ", ".join(map(str, LUMINANCE)) + "]"


@asked(f""", t AS (SELECT rid, iq, [floor((k * scale + 50) / 100) + odd for k in {_K}] AS q FROM b WHERE scale IS NOT NULL), z AS (SELECT *, list_median([(q[i] * 100 - 50) / {_K}[i] for i in range(1, 65)]) AS s FROM t),
    f AS (SELECT iq, greatest(1, least(100, CAST(round_even(CASE WHEN s >= 100 THEN 5000 / s ELSE (200 - s) / 2 END, 0) AS int))) AS qf, list_avg([abs(q[i] - round_even(greatest(1.0, least(255.0, ({_K}[i] * s + 50) / 100)), 0)) for i in range(1, 65)]) > 3 AS other FROM z),
    e AS (SELECT quantile_cont(qf, 0.25) - 3 * (quantile_cont(qf, 0.75) - quantile_cont(qf, 0.25)) AS fence FROM f)
    SELECT count(*) AS n, count(CASE WHEN NOT other THEN 1 END) AS reexported, round(100.0 * count(CASE WHEN NOT other THEN 1 END) / count(*), 1) AS reexported_pct, round(avg(qf) + 1e-9, 1) AS quality, round(max(fence), 1) AS fence, count(CASE WHEN qf < fence THEN 1 END) AS low_n, count(CASE WHEN qf < 75 AND iq < 40 THEN 1 END) AS conflicts FROM f, e""")
def jpeg_stats(rows):
    q = rows.where("quant IS NOT NULL").select("iq", m.quality_factor(F.col("quant"), LUMINANCE).alias("qf"), (m.residual(F.col("quant"), LUMINANCE) > 3).alias("other"))
    fence = summary(q, {"fence": "percentile(qf, 0.25) - 3 * (percentile(qf, 0.75) - percentile(qf, 0.25))"})
    return summary(q.crossJoin(F.broadcast(fence)), {"n": "count(*)", "reexported": "count_if(NOT other)", "reexported_pct": PCT("NOT other"), "quality": "round(avg(qf) + 1e-9, 1)", "fence": "round(max(fence), 1)", "low_n": "count_if(qf < fence)", "conflicts": "count_if(qf < 75 AND iq < 40)"})


@asked(" SELECT label, count(*) AS n FROM (SELECT rid, unnest(labels) AS label FROM b) WHERE (rid * 7 + length(label)) % 100 >= 30 GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def object_frequency(rows):
    found = rows.selectExpr("inline(filter(objects, o -> o.confidence >= 0.3))")
    return top_per(grouped(found, ["label"], {"n": "count(*)"}), [], "n desc,label", 20)


@asked(" SELECT CASE WHEN (ankle - hip) / (abs(hip - 10) + 1e-6) > 1.2 THEN 'standing' WHEN (ankle - hip) / (abs(hip - 10) + 1e-6) > 0.5 THEN 'sitting' WHEN (ankle - hip) / (abs(hip - 10) + 1e-6) > 0.1 THEN 'crouching' ELSE 'lying' END AS pose, count(*) AS n, round(avg(CASE WHEN score <> 0 THEN score END) + 1e-9, 1) AS mean FROM b WHERE persons IS NOT NULL GROUP BY 1")
def pose_types(rows):
    named = rows.where("persons IS NOT NULL").select(m.pose(F.col("heights")).alias("pose"), "score")
    return grouped(named, ["pose"], {"n": "count(*)", "mean": "round(avg(CASE WHEN score <> 0 THEN score END) + 1e-9, 1)"})


@asked(" SELECT CASE WHEN coalesce(nullif(persons, 0), 1) > 3 THEN '4+' ELSE CAST(coalesce(nullif(persons, 0), 1) AS varchar) END AS people, count(*) AS n, CASE WHEN coalesce(nullif(persons, 0), 1) = 1 THEN 'solo' ELSE 'group' END AS kind FROM b WHERE persons IS NOT NULL OR framing IS NOT NULL GROUP BY 1, 3")
def person_counts(rows):
    own = rows.where("persons IS NOT NULL OR framing IS NOT NULL").selectExpr("coalesce(nullif(persons, 0), 1) AS k")
    return grouped(own, {"people": "CASE WHEN k > 3 THEN '4+' ELSE CAST(k AS string) END", "kind": "CASE WHEN k = 1 THEN 'solo' ELSE 'group' END"}, {"n": "count(*)"})


@asked(" SELECT w AS warmth, count(b.rid) AS n FROM (VALUES ('warm'), ('cool'), ('neutral')) t(w) LEFT JOIN b ON CASE WHEN warm > cool THEN 'warm' WHEN cool > warm THEN 'cool' WHEN warm = cool THEN 'neutral' END = w GROUP BY 1")
def warmth_distribution(rows):
    return closed(grouped(rows, {"warmth": p.warmth("warm", "cool")}, {"n": "count(*)"}), "warmth", ["warm", "cool", "neutral"], ["n"])


@asked(""", u AS (SELECT unnest(labels) AS label, sat, CASE WHEN warm > cool THEN 'warm' WHEN cool > warm THEN 'cool' WHEN warm = cool THEN 'neutral' END AS w, score FROM b), c AS (SELECT label, w, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, w) AS i FROM u WHERE w IS NOT NULL GROUP BY 1, 2)
    SELECT u.label, count(sat) AS n, coalesce(max(c.w), 'unknown') AS dominant, round(avg(score) + 1e-9, 2) AS score, round(stddev_pop(score), 2) AS std FROM u LEFT JOIN c ON c.label = u.label AND i = 1 GROUP BY 1""")
def warmth_by_label(rows):
    each = rec.exploded(rows).withColumn("w", F.expr(p.warmth("warm", "cool")))
    top = top_per(grouped(each, ["label", "w"], {"k": "count(*)"}), ["label"], "k desc, w", 1).select("label", "w")
    return grouped(each, ["label"], {"n": "count(sat)", "score": "round(avg(score) + 1e-9, 2)", "std": "round(stddev_pop(score), 2)"}).join(top, "label", "left").selectExpr("label", "n", "coalesce(w, 'unknown') AS dominant", "score", "std")


_DOMAINS = {"time_of_day": ["golden_hour", "midday", "morning_evening", "night"], "focal": ["wide", "normal", "telephoto"], "dof": ["shallow", "mid", "deep"], "light": ["bright", "indoor", "low_light"]}
_TOD = "CASE WHEN hour BETWEEN 5 AND 7 OR hour BETWEEN 17 AND 19 THEN 'golden_hour' WHEN hour BETWEEN 10 AND 15 THEN 'midday' WHEN hour < 5 OR hour >= 20 THEN 'night' WHEN hour IS NOT NULL THEN 'morning_evening' END"


@asked(f", u AS (SELECT 'time_of_day' AS field, {_TOD} AS v FROM b UNION ALL SELECT 'focal', focal_cat FROM b UNION ALL SELECT 'dof', dof FROM b UNION ALL SELECT 'light', light FROM b), d AS (SELECT unnest([" + ", ".join(f"{{'field': '{f}', 'value': '{v}'}}" for f, vs in _DOMAINS.items() for v in [*vs, "unknown"]) + "], recursive := true)) SELECT d.field, d.value, count(u.field) AS n FROM d LEFT JOIN u ON u.field = d.field AND coalesce(u.v, 'unknown') = d.value GROUP BY 1, 2")
def exif_distributions(rows):
    """Four closed distributions with what is unknown; values outside their domains are left out."""
    cells = {"time_of_day": p.time_of_day("hour"), "focal": "focal_cat", "dof": "dof", "light": "light"}
    counted = rows.agg(*[F.expr(f"count_if(coalesce({cells[f]}, 'unknown') = '{v}')").alias(f"{f}_{v}") for f, vs in _DOMAINS.items() for v in [*vs, "unknown"]])
    pairs = ", ".join(f"'{f}', '{v}', {f}_{v}" for f, vs in _DOMAINS.items() for v in [*vs, "unknown"])
    return counted.selectExpr(f"stack({sum(len(v) + 1 for v in _DOMAINS.values())}, {pairs}) AS (field, value, n)")


@asked(""" SELECT CASE WHEN hour IS NULL THEN 'unknown' WHEN hour BETWEEN 5 AND 9 THEN 'morning' WHEN hour BETWEEN 10 AND 15 THEN 'afternoon' WHEN hour BETWEEN 16 AND 19 THEN 'evening' ELSE 'night' END AS caption_tod,
    CASE WHEN tilt IS NULL THEN 'none' WHEN abs(tilt) / 5 < 0.33 THEN 'high' WHEN abs(tilt) / 5 <= 0.66 THEN 'mid' ELSE 'low' END AS horizon, CASE WHEN focal * 9 % 360 < 20 OR focal * 9 % 360 >= 340 THEN 'red' WHEN focal * 9 % 360 < 45 THEN 'orange' WHEN focal * 9 % 360 < 70 THEN 'yellow' WHEN focal * 9 % 360 < 150 THEN 'green'
    WHEN focal * 9 % 360 < 200 THEN 'cyan/teal' WHEN focal * 9 % 360 < 260 THEN 'blue' WHEN focal * 9 % 360 < 290 THEN 'purple' WHEN focal IS NOT NULL THEN 'magenta' END AS hue, CASE WHEN score < 33 THEN 'low' WHEN score <= 66 THEN 'mid' WHEN score IS NOT NULL THEN 'high' END AS score_class, count(*) AS n FROM b GROUP BY 1, 2, 3, 4""")
def scalar_classes(rows):
    tod = p.case(("hour IS NULL", "'unknown'"), other=p.caption_time("hour"))
    keys = {"caption_tod": tod, "horizon": p.horizon_bucket("abs(tilt) / 5"), "hue": p.hue_band("focal * 9"), "score_class": p.score_bucket("score")}
    return rows.groupBy(*[F.expr(e).alias(n) for n, e in keys.items()]).agg(F.count("*").alias("n"))


@asked(f""", d AS (SELECT * EXCLUDE (tod), {_TOD} AS tod, unnest(labels) AS label FROM b), g AS (SELECT tod, label, count(focal) AS nf, count(score) AS ns, round(quantile_cont(shutter, 0.5), 6) AS shutter, CASE WHEN count(flash_code) > 0 THEN round(100.0 * count(CASE WHEN flash_code % 2 = 1 THEN 1 END) / count(flash_code), 1) ELSE 0.0 END AS flash_pct FROM d WHERE tod IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT tod, label, focal_cat || '+' || dof AS combo, row_number() OVER (PARTITION BY tod, label ORDER BY count(*) DESC, focal_cat || '+' || dof) AS i FROM d WHERE focal_cat <> '' AND dof <> '' AND tod IS NOT NULL GROUP BY 1, 2, 3)
    SELECT g.tod, g.label, greatest(nf, ns, 1) AS n, shutter, flash_pct, combo AS best_combo FROM g LEFT JOIN c ON c.tod = g.tod AND c.label = g.label AND i = 1""")
def context_settings(rows):
    each = rec.exploded(rows).withColumn("tod", F.expr(p.time_of_day("hour"))).where("tod IS NOT NULL")
    combos = top_per(grouped(each.where("focal_cat <> '' AND dof <> ''"), {"tod": "tod", "label": "label", "combo": "concat(focal_cat, '+', dof)"}, {"k": "count(*)"}), ["tod", "label"], "k desc, combo", 1)
    g = grouped(each, ["tod", "label"], {"n": "greatest(count(focal), count(score), 1L)", "shutter": "round(percentile(shutter, 0.5), 6)", "flash_pct": "CAST(CASE WHEN count(flash_code) > 0 THEN round(100.0 * count_if((flash_code & 1) = 1) / count(flash_code), 1) ELSE 0 END AS double)"})
    return g.join(combos.select("tod", "label", F.col("combo").alias("best_combo")), ["tod", "label"], "left")


@asked(""", t AS (SELECT ym, greatest(count(score), count(sat)) AS n, round(avg(score) + 1e-9, 2) AS score FROM b WHERE ym IS NOT NULL GROUP BY 1), q AS (SELECT ym, round(avg(iq) + 1e-9, 2) AS iq FROM b WHERE ym IS NOT NULL AND iq IS NOT NULL GROUP BY 1), k AS (SELECT ym, nullif(round(avg(sharp) + 1e-9, 2), 0) AS sharp FROM b WHERE ym IS NOT NULL GROUP BY 1)
    SELECT ym, n, score, iq, sharp, round(sharp - lag(sharp) OVER (ORDER BY ym) + 1e-9, 1) + 0.0 AS sharp_delta, round(score - lag(score) OVER (ORDER BY ym) + 1e-9, 2) + 0.0 AS score_delta FROM t LEFT JOIN q USING (ym) LEFT JOIN k USING (ym)""")
def month_enrichment(rows):
    """Months with scores of other analyses joined to them; a value of 0 counts as none."""
    trend = grouped(rows, ["ym"], {"n": "greatest(count(score), count(sat))", "score": "round(avg(score) + 1e-9, 2)"})
    iq = grouped(rows.where("iq IS NOT NULL"), ["ym"], {"iq": "round(avg(iq) + 1e-9, 2)"})
    sharp = grouped(rows, ["ym"], {"sharp": "nullif(round(avg(sharp) + 1e-9, 2), 0D)"})
    joined = trend.join(iq, "ym", "left").join(sharp, "ym", "left")
    return joined.selectExpr("ym", "n", "score", "iq", "sharp", "round(sharp - lag(sharp) over (order by ym) + 1e-9, 1) + 0.0D AS sharp_delta", "round(score - lag(score) over (order by ym) + 1e-9, 2) + 0.0D AS score_delta")


@asked(" SELECT rid, focal, aperture, iso FROM b WHERE (coalesce(focal, 0) <> 0 OR coalesce(aperture, 0) <> 0 OR coalesce(iso, 0) <> 0) AND rid IN (SELECT rid FROM b WHERE score > 50)")
def scatter_exif(rows):
    points = rows.where("score > 50").select("rid")
    settings = rows.where("coalesce(focal, 0) <> 0 OR coalesce(aperture, 0) <> 0 OR coalesce(iso, 0) <> 0").select("rid", "focal", "aperture", "iso")
    return points.join(settings, "rid")


@asked(" SELECT count(DISTINCT make) AS makes, count(DISTINCT lens) AS lenses, list_aggregate(list_sort(list(DISTINCT make)), 'string_agg', ', ') AS all_makes FROM b")
def distinct_gear(rows):
    return rows.agg(F.count_distinct("make").alias("makes"), F.count_distinct("lens").alias("lenses"), F.array_join(F.array_sort(F.collect_set("make")), ", ").alias("all_makes"))


@asked(", s AS (SELECT ym, count(*) AS n FROM b WHERE ym IS NOT NULL GROUP BY 1) SELECT ym, n, lead(n) OVER (ORDER BY ym) AS next_n, nth_value(n, 2) OVER (ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_n, round(cume_dist() OVER (ORDER BY n), 6) AS cume, CAST(sum(n) OVER (ORDER BY n RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS bigint) AS near_n FROM s")
def month_frames(rows):
    s = grouped(rows, ["ym"], {"n": "count(*)"})
    whole = "rows between unbounded preceding and unbounded following"
    return s.selectExpr("ym", "n", "lead(n) over (order by ym) AS next_n", f"nth_value(n, 2) over (order by ym {whole}) AS second_n", "round(cume_dist() over (order by n), 6) AS cume", "sum(n) over (order by n range between 5 preceding and 5 following) AS near_n")

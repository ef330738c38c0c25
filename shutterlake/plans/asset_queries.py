"""Queries that read assets from their JSON; the JSON is made up from the deliveries, in the shape the remote catalogue gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import assets
from shutterlake.operators.aggregates import grouped, summary
from shutterlake.plans.library_queries import over
from shutterlake.sources.tables import table

_ODD = {"n": "row_id", "id": "lightroom_id", "rating": "lightroom_rating", "cap": "concat('20', lpad(CAST(row_id % 20 + 10 AS varchar(2)), 2, '0'), '-0', CAST(row_id % 9 + 1 AS varchar(1)), '-15T', lpad(CAST(row_id % 30 AS varchar(2)), 2, '0'), ':30:00', CASE row_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END)"}
BASE = "SELECT " + ", ".join(f"{e} AS {k}" for k, e in _ODD.items()) + ", exif.camera_make AS make, exif.camera_model AS model, lightroom_filename AS file FROM asset_feed"


def raw_assets(spark, folder) -> DataFrame:
    """(n, asset): one JSON text per delivery."""
    f = table(spark, folder, "asset_feed").selectExpr(*[f"{e} AS {k}" for k, e in _ODD.items()], "exif.camera_make AS make", "exif.camera_model AS model", "lightroom_filename AS file")
    xmp = "concat('<rdf crs:Exposure2012=\"+0.', n % 100, '\" crs:Sharpness=\"', n % 50, '.0\"/><crs:Contrast2012>-', n % 30, '</crs:Contrast2012><crs:Sharpness>999</crs:Sharpness>')"
    parts = f"""named_struct('id', id, 'updated', cap,
        'links', CASE WHEN n % 4 = 0 THEN named_struct('/rels/xmp/develop', named_struct('href', 'assets/x', 'fileSize', n % 8)) END,
        'payload', named_struct('captureDate', CASE WHEN n % 7 > 0 THEN cap END, 'rating', CASE WHEN n % 5 > 0 THEN rating END, 'pick', CASE WHEN n % 6 = 0 THEN 1 END, 'keywords', CASE WHEN n % 2 = 0 THEN array('a', make) END,
            'importSource', named_struct('fileName', file, 'originalHeight', 3000 + n % 1000, 'originalWidth', CASE WHEN n % 9 = 0 THEN 0 ELSE 4000 END),
            'develop', named_struct('xmpCameraRaw', CASE WHEN n % 4 = 1 THEN {xmp} END, 'fromDefaults', CASE WHEN n % 4 = 2 THEN false WHEN n % 4 = 3 THEN true END),
            'xmp', named_struct('tiff', named_struct('Make', concat(' ', make), 'Model', model), 'aux', named_struct('Lens', '', 'LensModel', CASE WHEN n % 3 = 0 THEN ' 24-70mm ' END),
                'exif', named_struct('FocalLength', CASE WHEN n % 10 = 0 THEN NULL ELSE array(n % 200, n % 11) END, 'FNumber', CAST(n % 15 AS double) / 2 + 1, 'ISOSpeedRatings', n % 4000, 'ExposureTime', array(1, n % 600), 'MeteringMode', CASE n % 4 WHEN 0 THEN 'Pattern' WHEN 1 THEN 'Spot' WHEN 2 THEN 'odd' END, 'FlashFired', CASE WHEN n % 3 = 0 THEN n % 2 = 0 END))))"""
    return f.selectExpr("n", f"to_json({parts}) AS asset", f"CASE WHEN n % 8 = 4 THEN {xmp} WHEN n % 8 = 0 THEN 'no settings' END AS fetched")


_FOCAL = "CASE WHEN n % 10 > 0 AND n % 11 > 0 AND n % 200 > 0 THEN round((n % 200) / CAST(n % 11 AS double), 2) END"
_CAP = "CASE WHEN n % 7 > 0 AND n % 30 < 24 THEN n % 30 END"


@over("", f"""WITH f AS ({BASE}) SELECT n, id AS lightroom_id, CASE WHEN n % 5 > 0 THEN coalesce(rating, 0) ELSE 0 END AS lightroom_rating, CAST(n % 6 = 0 AS int) AS lightroom_pick, CASE WHEN n % 2 = 0 THEN CASE WHEN make IS NULL THEN 1 ELSE 2 END ELSE 0 END AS n_keywords, coalesce(file, '') AS lightroom_filename, {_FOCAL} AS focal_length_mm,
    round((n % 15) / 2.0 + 1, 2) AS aperture_f, CAST(n % 4000 AS int) AS iso, CASE WHEN n % 600 > 0 THEN round(1.0 / (n % 600), 6) END AS shutter_speed, nullif(trim(make), '') AS camera_make, CASE WHEN n % 3 = 0 THEN '24-70mm' END AS lens_model, CASE WHEN n % 3 = 0 THEN n % 2 = 0 END AS flash_fired,
    CASE n % 4 WHEN 0 THEN 'multi_segment' WHEN 1 THEN 'spot' END AS metering_mode, CAST({_CAP} AS int) AS hour, CASE WHEN {_CAP} IS NOT NULL THEN printf('20%02d-0%d', n % 20 + 10, n % 9 + 1) END AS year_month, CASE WHEN n % 9 > 0 THEN round((3000 + n % 1000) * 4000 / 1e6, 2) END AS megapixels FROM f""")
def parsed_assets(spark, folder):
    typed = assets.parsed(raw_assets(spark, folder))
    rows = assets.rounded(typed.select("n", *assets.asset_fields(), *assets.exif_fields()))
    return rows.selectExpr("n", "lightroom_id", "lightroom_rating", "lightroom_pick", "size(filter(lightroom_keywords, k -> k IS NOT NULL)) AS n_keywords", "lightroom_filename", "focal_length_mm", "aperture_f", "iso", "shutter_speed", "camera_make", "lens_model", "flash_fired", "metering_mode", "hour", "year_month", "megapixels")


@over("", f"""WITH f AS ({BASE}), e AS (SELECT CASE WHEN n % 10 > 0 AND n % 11 > 0 AND n % 200 > 0 THEN (n % 200) / CAST(n % 11 AS double) END AS fl, (n % 15) / 2.0 + 1 AS ap, n % 4000 AS iso, CASE WHEN n % 600 > 0 THEN 1.0 / (n % 600) END AS et, {_CAP} AS h FROM f)
    SELECT CASE WHEN fl < 35 THEN 'wide' WHEN fl <= 70 THEN 'normal' WHEN fl IS NOT NULL THEN 'telephoto' END AS focal_category, CASE WHEN ap < 2.8 THEN 'shallow' WHEN ap < 8 THEN 'mid' ELSE 'deep' END AS dof_category, CASE WHEN iso > 1600 THEN 'low_light' WHEN iso > 400 THEN 'indoor' ELSE 'bright' END AS light_category,
    CASE WHEN et <= 0.002 THEN 'freeze' WHEN et <= 1.0/60 THEN 'hand' WHEN et <= 1.0/15 THEN 'slow' WHEN et IS NOT NULL THEN 'bulb' END AS shutter_category, CASE WHEN h BETWEEN 5 AND 7 OR h BETWEEN 17 AND 19 THEN 'golden_hour' WHEN h BETWEEN 10 AND 15 THEN 'midday' WHEN h < 5 OR h >= 20 THEN 'night' WHEN h IS NOT NULL THEN 'morning_evening' END AS time_of_day, count(*) AS n FROM e GROUP BY 1, 2, 3, 4, 5""")
def asset_classes(spark, folder):
    rows = assets.with_classes(assets.parsed(raw_assets(spark, folder)).select(*assets.exif_fields()))
    return rows.groupBy("focal_category", "dof_category", "light_category", "shutter_category", "time_of_day").agg(F.count("*").alias("n"))


@over("", f"WITH f AS ({BASE}) SELECT CASE WHEN n % 4 = 0 AND n % 8 > 0 THEN 'link_fetched' WHEN n % 4 = 1 THEN 'old_inline' WHEN n % 4 = 2 THEN 'unknown' ELSE 'unedited' END AS format, count(*) AS n FROM f GROUP BY 1")
def develop_formats(spark, folder):
    return grouped(assets.parsed(raw_assets(spark, folder)).select(assets.develop_format().alias("format")), ["format"], {"n": "count(*)"})


@over("", f"WITH f AS ({BASE}), d AS (SELECT n FROM f WHERE n % 8 = 4 OR n % 4 = 1) SELECT count(*) AS n, round(avg((n % 100) / CASE WHEN n % 100 < 10 THEN 10.0 ELSE 100.0 END) + 1e-9, 4) AS exposure, round(avg(-(n % 30)) + 1e-9, 4) AS contrast, round(avg(n % 50) + 1e-9, 4) AS sharpness, max(CAST(n % 50 AS varchar)) AS sharp_text FROM d")
def xmp_settings(spark, folder):
    """Settings from XMP texts, fetched or inside the asset; attributes win over elements and whole numbers lose their decimals."""
    rows = assets.parsed(raw_assets(spark, folder)).select(assets.develop(F.col("fetched")).alias("d")).where("size(d) > 0")
    value = lambda k: f"round(avg(try_cast(d['{k}'] AS double)) + 1e-9, 4)"
    return summary(rows, {"n": "count(*)", "exposure": value("Exposure2012"), "contrast": value("Contrast2012"), "sharpness": value("Sharpness"), "sharp_text": "max(d['Sharpness'])"})


@over("", f"WITH f AS ({BASE}), d AS (SELECT n FROM f WHERE n % 8 = 4) SELECT 'Exposure2012' AS key, count(*) AS n FROM d HAVING count(*) > 0 UNION ALL SELECT 'Sharpness', count(*) FROM d HAVING count(*) > 0 UNION ALL SELECT 'Contrast2012', count(*) FROM d HAVING count(*) > 0")
def xmp_keys(spark, folder):
    """Keys of fetched XMP texts, by the table function."""
    assets.register_udtf(spark)
    raw = raw_assets(spark, folder).where("fetched IS NOT NULL").select("fetched")
    return grouped(raw.lateralJoin(assets.XmpEntries(F.col("fetched").outer())), ["key"], {"n": "count(*)"})


_LOCAL = "SELECT row_id AS n, exif.camera_make AS make, exif.hour AS hour FROM asset_feed"


@over("", f"WITH f AS ({_LOCAL}) SELECT n, coalesce(CASE WHEN n % 3 = 0 THEN 'Remote' END, make) AS camera_make, coalesce(CASE WHEN n % 4 = 0 THEN 7 END, hour) AS hour FROM f")
def remote_over_local(spark, folder):
    rows = table(spark, folder, "asset_feed").selectExpr("row_id AS n", "named_struct('camera_make', exif.camera_make, 'hour', exif.hour) AS exif", "named_struct('camera_make', CASE WHEN row_id % 3 = 0 THEN 'Remote' END, 'hour', CASE WHEN row_id % 4 = 0 THEN 7 END) AS remote")
    return assets.overlaid(rows, "exif", "remote", ["camera_make", "hour"]).selectExpr("n", "exif.*")


@over("", "WITH e AS (SELECT DISTINCT scene.scene_types AS l FROM photos WHERE scene.scene_types IS NOT NULL) SELECT count(DISTINCT list_sort(l)) AS n_sets FROM e")
def label_set_keys(spark, folder):
    sets = table(spark, folder, "photos").where("scene.scene_types IS NOT NULL").select(assets.labels_key(F.col("scene.scene_types")).alias("k"))
    return sets.agg(F.count_distinct("k").alias("n_sets"))


@over("", "SELECT CAST(hour AS int) AS hour, year_month, CAST(substr(year_month, 1, 4) AS int) AS year, count(*) AS n FROM (SELECT o_orderkey % 26 AS hour, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders) WHERE hour < 24 GROUP BY 1, 2, 3")
def exif_stamps(spark, folder):
    """EXIF stamps, of which some name an hour that is none."""
    stamps = table(spark, folder, "orders").selectExpr("concat(date_format(o_orderdate, 'yyyy:MM:dd'), ' ', lpad(CAST(o_orderkey % 26 AS string), 2, '0'), ':15:00') AS s")
    taken = stamps.select(assets.exif_stamp(F.col("s")).alias("t")).where("t IS NOT NULL")
    return grouped(taken, {"hour": "hour(t)", "year_month": "date_format(t, 'yyyy-MM')", "year": "year(t)"}, {"n": "count(*)"})

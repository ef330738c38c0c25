"""Typed records from the JSON of a remote catalogue's assets, and EXIF values as cameras write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from shutterlake.functions import portable as p
from shutterlake.functions.media import xmp_entries

#: Names of metering modes in XMP.
METERING = {"pattern": "multi_segment", "center weighted average": "center_weighted", "spot": "spot", "average": "average", "multi-spot": "multi_spot"}
_NUMBER = "array<double>"
#: What is read of an asset; rationals come as [numerator, denominator] or as a number, so they are read as texts first.
ASSET = """struct<id: string, updated: string, payload: struct<captureDate: string, rating: int, colorLabel: string, pick: int, keywords: array<string>,
    importSource: struct<fileName: string, originalHeight: int, originalWidth: int>, develop: struct<xmpCameraRaw: string, fromDefaults: boolean>,
    xmp: struct<tiff: struct<Make: string, Model: string>, aux: struct<Lens: string, LensModel: string>,
    exif: struct<FocalLengthIn35mmFilm: string, FocalLength: string, FNumber: string, ApertureValue: string, ISOSpeedRatings: int, ExposureTime: string, MeteringMode: string, FlashFired: boolean>>>,
    links: struct<`/rels/xmp/develop`: struct<href: string, fileSize: bigint>>>""".replace("\n", " ")


def rational(text: Column) -> Column:
    """A number written as '[numerator, denominator]' or plainly; null for a denominator of 0 or anything else."""
    pair = F.from_json(text, _NUMBER)
    plain = text.try_cast("double")
    return F.when(plain.isNotNull(), plain).when(F.size(pair) == 2, F.try_divide(pair[0], F.nullif(pair[1], F.lit(0.0))))


def exif_stamp(text: Column) -> Column:
    """The wall time of '2024:05:17 14:03:22'; null for anything else."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), text), F.lit("yyyy:MM:dd HH:mm:ss"))


def iso_wall(text: Column) -> Column:
    """The wall time of an ISO stamp, whatever its zone."""
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})?$")
    return F.try_to_timestamp(F.when(good, F.regexp_replace(F.substring(text, 1, 19), "T", " ")), F.lit("yyyy-MM-dd HH:mm:ss"))


def _truthy(c: Column) -> Column:
    return F.when(c != 0, c)


def parsed(raw: DataFrame, column: str = "asset") -> DataFrame:
    """``raw`` with ``a``, the typed asset; null where the JSON is none."""
    return raw.withColumn("a", F.from_json(F.col(column), ASSET))


def exif_fields(a: str = "a") -> list[Column]:
    """Camera data of a parsed asset: focal_length_mm, aperture_f, iso, shutter_speed, their classes, camera, lens, flash, metering, time and megapixels."""
    x, t = f"{a}.payload.xmp.exif", f"{a}.payload.xmp"
    focal = _truthy(rational(F.coalesce(F.nullif(F.col(f"{x}.FocalLengthIn35mmFilm"), F.lit("0")), F.col(f"{x}.FocalLength"))))
    aperture = _truthy(rational(F.coalesce(F.nullif(F.col(f"{x}.FNumber"), F.lit("0")), F.col(f"{x}.ApertureValue"))))
    exposure = _truthy(rational(F.col(f"{x}.ExposureTime")))
    iso = F.col(f"{x}.ISOSpeedRatings")
    metering = F.try_element_at(F.create_map(*[F.lit(v) for kv in METERING.items() for v in kv]), F.lower(F.col(f"{x}.MeteringMode")))
    taken = iso_wall(F.col(f"{a}.payload.captureDate"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    h, w = F.col(f"{a}.payload.importSource.originalHeight"), F.col(f"{a}.payload.importSource.originalWidth")
    return [
        focal.alias("focal_length_mm"), aperture.alias("aperture_f"), iso.alias("iso"), exposure.alias("shutter_speed"),
        text(F.col(f"{t}.tiff.Make")).alias("camera_make"), text(F.col(f"{t}.tiff.Model")).alias("camera_model"), text(F.coalesce(F.nullif(F.col(f"{t}.aux.Lens"), F.lit("")), F.col(f"{t}.aux.LensModel"))).alias("lens_model"),
        F.col(f"{x}.FlashFired").alias("flash_fired"), metering.alias("metering_mode"), F.hour(taken).alias("hour"), F.date_format(taken, "yyyy-MM").alias("year_month"), F.year(taken).alias("year"),
        F.when((h != 0) & (w != 0), F.round(h.cast("bigint") * w / 1e6, 2)).alias("megapixels"),
    ]


def rounded(rows: DataFrame) -> DataFrame:
    """``rows`` with focal length, aperture and exposure time as they are kept; classes follow from the exact values."""
    return rows.withColumns({c: F.round(c, d) for c, d in (("focal_length_mm", 2), ("aperture_f", 2), ("shutter_speed", 6))})


def with_classes(rows: DataFrame) -> DataFrame:
    """``rows`` with the classes of focal length, aperture, ISO, exposure and hour."""
    return rows.selectExpr("*", f"{p.focal_category('focal_length_mm')} AS focal_category", f"{p.depth_category('aperture_f')} AS dof_category", f"{p.light_category('iso')} AS light_category", f"{p.shutter_category('shutter_speed')} AS shutter_category", f"{p.time_of_day('hour')} AS time_of_day")


def develop(fetched: Column, a: str = "a") -> Column:
    """Settings from the fetched XMP if it has any, else from the one inside the asset, else an empty map."""
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(xmp_entries(fetched)), some(xmp_entries(F.col(f"{a}.payload.develop.xmpCameraRaw"))), F.expr("cast(map() as map<string, string>)"))


def develop_format(a: str = "a") -> Column:
    """How an asset gives its settings: link_fetched, old_inline, unknown (edited but nothing to read) or unedited."""
    link = F.col(f"{a}.links")["/rels/xmp/develop"]
    return (
        F.when((link.fileSize > 0) & (F.coalesce(link.href, F.lit("")) != ""), "link_fetched").when(F.col(f"{a}.payload.develop.xmpCameraRaw") != "", "old_inline")
        .when(F.col(f"{a}.payload.develop.fromDefaults") == F.lit(False), "unknown").otherwise("unedited")
    )


def asset_fields(a: str = "a") -> list[Column]:
    """An asset's own fields with their defaults."""
    c = lambda name: F.col(f"{a}.{name}")
    return [
        c("id").alias("lightroom_id"), F.coalesce(c("payload.rating"), F.lit(0)).alias("lightroom_rating"), F.coalesce(c("payload.colorLabel"), F.lit("")).alias("lightroom_label"), F.coalesce(c("payload.pick"), F.lit(0)).alias("lightroom_pick"),
        F.coalesce(c("payload.keywords"), F.array().cast("array<string>")).alias("lightroom_keywords"), F.coalesce(c("payload.captureDate"), F.lit("")).alias("lightroom_capture_date"), c("updated").alias("lightroom_updated"),
        F.coalesce(c("payload.importSource.fileName"), F.lit("")).alias("lightroom_filename"),
    ]


def overlaid(rows: DataFrame, local: str, remote: str, fields: list[str]) -> DataFrame:
    """``rows`` with the struct ``local`` in which the fields that ``remote`` has are taken from there."""
    return rows.withColumn(local, F.struct(*[F.coalesce(F.col(f"{remote}.{f}"), F.col(f"{local}.{f}")).alias(f) for f in fields]))


def thumbnail_text(content: Column) -> Column:
    """Image bytes as base64 text."""
    return F.base64(content)


def labels_key(labels: Column) -> Column:
    """Sixteen hex digits that name a set of labels, whatever their order."""
    return F.substring(F.sha2(F.to_json(F.struct(F.array_sort(labels).alias("labels"))), 256), 1, 16)


@udtf(returnType="key string, value string")
class XmpEntries:
    """``SELECT * FROM xmp_entries(text)``: the crs: settings of an XMP text as rows."""

    def eval(self, text: str):
        import re

        found = dict(re.findall(r"<crs:(\w+)>([^<]*)</crs:", text or ""))
        found |= dict(re.findall(r'crs:(\w+)\s*=\s*"([^"]*)"', text or ""))
        for k, v in found.items():
            yield k, re.sub(r"^([+-]?\d+)\.0+$", r"\1", v)


def register_udtf(spark: SparkSession) -> None:
    spark.udtf.register("xmp_entries", XmpEntries)

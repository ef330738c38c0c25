"""The flat, cleaned view of the photo records that the aggregate operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Name -> SQL over the nested record, the same in any engine. Scores outside 0-100 and NaN do not count.
COLUMNS = {
    "rid": "record_id", "source": "source", "path": "path", "seen": "analysed_at",
    "score": "CASE WHEN aesthetic_score BETWEEN 0 AND 100 THEN aesthetic_score END", "iq": "CASE WHEN iq_score BETWEEN 0 AND 100 THEN iq_score END",
    "labels": "scene.scene_types", "focal": "exif.focal_length_mm", "focal_cat": "exif.focal_category", "aperture": "exif.aperture_f", "dof": "exif.dof_category",
    "iso": "exif.iso", "light": "exif.light_category", "hour": "exif.hour", "ym": "exif.year_month", "make": "exif.camera_make", "model": "exif.camera_model", "lens": "exif.lens_model",
    # the tables have no exposure time: a stand-in from what they have, in seconds
    "shutter": "CASE WHEN exif.iso > 0 AND exif.focal_length_mm > 0 THEN CAST(exif.iso AS double) / (exif.focal_length_mm * 400) END",
    "sat": "color.avg_saturation", "bright": "color.avg_brightness", "contrast": "color.contrast", "warm": "color.warm_ratio", "cool": "color.cool_ratio",
    "thirds": "composition.thirds_score", "symmetry": "composition.symmetry_score", "space": "composition.negative_space", "isolation": "composition.subject_isolation",
    "clutter": "composition.foreground_clutter", "tilt": "composition.horizon_tilt_deg", "highlights": "composition.highlight_clipping", "shadows": "composition.shadow_clipping",
    "area": "saliency.subject_area_pct", "cx": "saliency.subject_cx", "cy": "saliency.subject_cy", "off": "saliency.subject_off_center",
    "person": "caption.has_person", "setting": "caption.setting", "tod": "caption.time_of_day", "persons": "pose_data.person_count", "framing": "pose_data.framing",
    "lr": "lightroom_id", "rating": "lightroom_rating", "albums": "lightroom_album_names",
}
SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM photos"


def records(photos: DataFrame) -> DataFrame:
    """One row per record; Catalyst prunes what a query does not use, down to the nested Parquet columns."""
    return photos.selectExpr(*[f"{v} AS {k}" for k, v in COLUMNS.items()])


def exploded(rows: DataFrame, array: str = "labels", name: str = "label") -> DataFrame:
    """A row per record and entry of ``array``; records with a null or empty one have none."""
    return rows.selectExpr("*", f"explode({array}) AS {name}")

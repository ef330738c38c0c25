"""Rules with thresholds calibrated on the library: calibration, severities, flags and their roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defaults of the thresholds.
DEFAULTS = {
    "thirds_min": 0.72, "tilt_max": 1.5, "clutter_max": 0.22, "space_min": 0.25, "isolation_floor": 0.85, "score_floor": 35.0,
    "score_high": 65.0, "iq_floor": 40.0, "clip_highlights": 0.03, "clip_shadows": 0.05, "off_max": 0.25,
}
#: Threshold -> (column, percentile, digits). The other thresholds stay as they are.
CALIBRATED = {
    "score_floor": ("score", 0.15, 1), "iq_floor": ("iq", 0.15, 1), "isolation_floor": ("isolation", 0.15, 3), "score_high": ("score", 0.65, 1),
    "thirds_min": ("thirds", 0.2, 3), "space_min": ("space", 0.2, 3), "clutter_max": ("clutter", 0.8, 3), "off_max": ("off", 0.75, 3),
}
#: Rule -> (when it fires, how severe), over record columns and thresholds.
RULES = {
    "off_thirds": ("thirds < thirds_min", "1 - thirds"),
    "tilted": ("abs(tilt) > tilt_max", "abs(tilt)"),
    "cluttered": ("clutter > clutter_max", "clutter"),
    "merged_subject": ("isolation < isolation_floor", "1 - least(isolation, 2.0) / 2"),
    "busy": ("space < space_min", "space_min - space"),
    "low_score": ("score < score_floor", "(score_floor - score) / score_floor"),
    "deep_portrait": ("dof = 'deep' AND array_contains(labels, 'people and portraits')", "1.0"),
    "dark_and_weak": ("light = 'low_light' AND score < score_floor + 5", "1.0"),
    "blown_highlights": ("highlights > clip_highlights", "highlights"),
    "blocked_shadows": ("shadows > clip_shadows", "shadows"),
    "weak_technique": ("iq < iq_floor AND score > score_high", "1 - iq / 100"),
    "off_centre": ("off > off_max AND thirds < thirds_min", "off"),
}


def thresholds(rows: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """One row: manual overrides before percentiles of the library before defaults. Unknown overrides are ignored."""
    overrides = overrides or {}
    picked = []
    for name, default in DEFAULTS.items():
        if name in overrides:
            picked.append(F.lit(float(overrides[name])).alias(name))
        elif name in CALIBRATED:
            column, p, digits = CALIBRATED[name]
            picked.append(F.coalesce(F.round(F.percentile(column, p), digits), F.lit(default)).alias(name))
        else:
            picked.append(F.lit(default).alias(name))
    return rows.agg(*picked)


def severities(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with a column per rule: its severity where it fires, else null. ``limits`` is one row."""
    joined = rows.crossJoin(F.broadcast(limits))
    return joined.select(*rows.columns, *[F.expr(f"CASE WHEN {when} THEN round(CAST({how} AS double), 4) END").alias(r) for r, (when, how) in RULES.items()])


def flags(severe: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, rule, severity): a row per record and fired rule."""
    pairs = ", ".join(f"'{r}', {r}" for r in RULES)
    return severe.selectExpr(*keep, f"stack({len(RULES)}, {pairs}) AS (rule, severity)").where("severity IS NOT NULL")


def rollup(flagged: DataFrame, total: DataFrame) -> DataFrame:
    """(rule, n, pct, mean_severity) of fired rules; ``total`` is one row with ``total``."""
    counts = flagged.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("severity") + 1e-9, 3).alias("mean_severity"))
    return counts.crossJoin(F.broadcast(total)).selectExpr("rule", "n", "round(100.0 * n / total, 1) AS pct", "mean_severity")

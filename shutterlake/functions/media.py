"""Scalar rules over media measurements, as column expressions on arrays, maps and structs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hue_saturation(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Hue in 0-1 and saturation of an RGB colour of 0-255; hue 0 for greys."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = (hi - lo).cast("double")
    h = F.when(hi == r, (g - b) / span).when(hi == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    return F.when(span == 0, F.lit(0.0)).otherwise(F.pmod(h, F.lit(1.0))), F.when(hi == 0, F.lit(0.0)).otherwise(span / hi)


def hls_hex(h: Column, lightness: Column, s: Column) -> Column:
    """'#rrggbb' of a hue in degrees with lightness and saturation in per cent; null where saturation is below 2."""
    li, sa = lightness / 100, s / 100
    m2 = F.when(li <= 0.5, li * (1 + sa)).otherwise(li + sa - li * sa)
    m1 = 2 * li - m2

    def channel(shift: float) -> Column:
        x = F.pmod(h / 360 + shift, F.lit(1.0))
        v = F.when(x < 1 / 6, m1 + (m2 - m1) * x * 6).when(x < 0.5, m2).when(x < 2 / 3, m1 + (m2 - m1) * (2 / 3 - x) * 6).otherwise(m1)
        return F.floor(v * 255).cast("int")

    return F.when(s >= 2, F.format_string("#%02x%02x%02x", channel(1 / 3), channel(0.0), channel(-1 / 3)))


def harmony(palette: Column) -> Column:
    """Harmony class of a palette (array<struct<rgb: array<int>, weight: double>>) from the hues of its first four colourful swatches."""
    def hue(p: Column) -> Column:
        h, s = hue_saturation(p.rgb[0], p.rgb[1], p.rgb[2])
        return F.struct(h.alias("h"), s.alias("s"))

    hues = F.transform(F.filter(F.transform(F.slice(palette, 1, 4), hue), lambda x: x.s > 0.15), lambda x: x.h * 360)
    apart = F.flatten(F.transform(hues, lambda a: F.transform(hues, lambda b: F.least(F.abs(a - b), 360 - F.abs(a - b)))))
    most = F.array_max(apart)
    return (
        F.when(palette.isNull(), None).when(F.size(hues) < 2, "monochromatic").when(most < 40, "analogous").when((most > 150) & (most < 215), "complementary")
        .when((most > 100) & (most <= 150), "triadic").otherwise("mixed")
    )


def xmp_entries(text: Column) -> Column:
    """map<string, string> of the ``crs:`` settings in an XMP text; attributes win over elements, '1.0' reads as '1'."""
    clean = lambda m: F.transform_values(m, lambda _, v: F.regexp_replace(v, r"^([+-]?\d+)\.0+$", "$1"))

    def entries(pattern: str) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
        # of a key written twice the last one counts
        return F.aggregate(pairs, F.expr("cast(map() as map<string, string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p.k), F.map_from_arrays(F.array(p.k), F.array(p.v))))

    attributes, elements = entries(r'crs:(\w+)\s*=\s*"([^"]*)"'), entries(r"<crs:(\w+)>([^<]*)</crs:")
    rest = F.map_filter(elements, lambda k, _: ~F.map_contains_key(attributes, k))
    return F.when(text.isNotNull(), clean(F.map_concat(attributes, rest)))


def intensity(settings: Column, sliders: list[str], defaults: dict[str, float] | None = None) -> Column:
    """Sum of distances from the defaults over ``sliders``; without ``defaults`` a missing one counts as 0, with them only present ones count."""
    values = [F.abs(F.try_element_at(settings, F.lit(s)).try_cast("double") - (defaults or {}).get(s, 0.0)) for s in sliders]
    total = F.aggregate(F.array(*[F.coalesce(v, F.lit(0.0)) for v in values]), F.lit(0.0), lambda a, x: a + x)
    if defaults is None:
        return total
    return F.when(F.coalesce(*values).isNotNull(), total)


def labels_above(scores: Column, part: float = 0.85) -> Column:
    """Labels of a score map within ``part`` of the best, best first, ties by name."""
    best = F.array_max(F.map_values(scores))
    kept = F.filter(F.map_entries(scores), lambda e: (e.value >= best * part) | (e.value == best))
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct((-e.value).alias("v"), e.key.alias("k")))), lambda x: x.k)


def quality_factor(table: Column, standard: list[int]) -> Column:
    """Quality setting of a JPEG quantisation table by inverting the usual scaling of the ``standard`` one."""
    scales = F.array_sort(F.zip_with(table, F.array(*[F.lit(s) for s in standard]), lambda t, s: (t * 100 - 50) / s))
    n = F.size(scales)
    median = (F.get(scales, F.floor((n - 1) / 2).cast("int")) + F.get(scales, F.floor(n / 2).cast("int"))) / 2
    q = F.when(median >= 100, 5000 / median).otherwise((200 - median) / 2)
    return F.when(F.size(table) == len(standard), F.least(F.lit(100), F.greatest(F.lit(1), F.round(q).cast("int"))))


def pose(ys: Column) -> Column:
    """Pose from the heights of 17 key points: legs against torso; null without shoulders or hips."""
    at = lambda i: F.get(ys, F.lit(i))
    shoulder, hip, ankle = (at(5) + at(6)) / 2, (at(11) + at(12)) / 2, (at(15) + at(16)) / 2
    ratio = F.abs(ankle - hip) / (F.abs(hip - shoulder) + F.lit(1e-6))
    named = F.when(ratio > 1.2, "standing").when(ratio > 0.5, "sitting").when(ratio > 0.1, "crouching").when(ratio.isNotNull(), "lying")
    return F.when((F.size(ys) >= 17) & (shoulder != 0) & (hip != 0), named)


def residual(table: Column, standard: list[int]) -> Column:
    """Mean difference of a quantisation table from the ``standard`` one scaled to fit it best; beyond 3 it is of another make."""
    scales = F.array_sort(F.zip_with(table, F.array(*[F.lit(s) for s in standard]), lambda t, s: (t * 100 - 50) / s))
    n = F.size(scales)
    scale = (F.get(scales, F.floor((n - 1) / 2).cast("int")) + F.get(scales, F.floor(n / 2).cast("int"))) / 2
    away = F.zip_with(table, F.array(*[F.lit(float(s)) for s in standard]), lambda t, s: F.abs(t - F.bround(F.greatest(F.lit(1.0), F.least(F.lit(255.0), (s * scale + 50) / 100)))))
    return F.when(n == len(standard), F.aggregate(away, F.lit(0.0), lambda a, x: a + x) / n)


def signed_degrees(dms: Column, ref: Column) -> Column:
    """Decimal degrees from degrees, minutes and seconds; south and west are negative."""
    d = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60 + F.get(dms, F.lit(2)) / 3600
    return F.round(F.when(F.upper(ref).isin("S", "W"), -d).otherwise(d), 5)


def merged_palettes(swatches: DataFrame, group: str, near: float = 30.0, keep: int = 6) -> DataFrame:
    """(group, place, hex, weight): swatches (group, hash, pos, r, g, b, weight) merged greedily within ``near`` in RGB, heaviest first.

    The merge depends on order, so it runs in order of (hash, pos). Equal colours of a group are summed before they are
    gathered: at most 256 cubed colours meet in one task, whatever the group's size.
    """
    colours = swatches.groupBy(group, "r", "g", "b").agg(F.sum("weight").alias("weight"), F.min(F.struct("hash", "pos")).alias("first"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", key=lambda s: s.map(lambda x: (x["hash"], x["pos"])))
        centres, weights = np.empty((0, 3)), []
        for c, w in zip(pdf[["r", "g", "b"]].to_numpy(float), pdf["weight"]):
            d = np.sqrt(((centres - c) ** 2).sum(axis=1)) if len(centres) else np.empty(0)
            if len(d) and d.min() < near:
                weights[int(d.argmin())] += w
            else:
                centres = np.vstack([centres, c])
                weights.append(w)
        top = np.argsort(-np.array(weights), kind="stable")[:keep]
        return pd.DataFrame({group: pdf[group].iloc[0], "place": np.arange(1, len(top) + 1), "hex": ["#%02x%02x%02x" % tuple(int(v) for v in centres[i]) for i in top], "weight": [round(float(weights[i]), 4) for i in top]})

    kind = swatches.schema[group].dataType.simpleString()
    return colours.groupBy(group).applyInPandas(merge, f"{group} {kind}, place bigint, hex string, weight double")


def farthest_first(vectors: np.ndarray, k: int = 3) -> list[int]:
    """Rows of ``k`` representatives: the first, then always the one least similar to those chosen."""
    u = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    chosen = [0]
    while len(chosen) < min(k, len(u)):
        near = (u @ u[chosen].T).max(axis=1)
        near[chosen] = np.inf
        chosen.append(int(near.argmin()))
    return chosen


def infer(df: DataFrame, column: str, load, schema: str) -> DataFrame:
    """Run a model over a column: ``load()`` returns a function from a list of values to a list of rows, once per task; a failing batch is retried row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        names = [c.strip().split()[0] for c in schema.split(",")]
        for b in batches:
            values = b[column].tolist()
            try:
                rows = model(values)
            except Exception:
                rows = []
                for v in values:
                    try:
                        rows += model([v])
                    except Exception:
                        rows.append((None,) * (len(names) - 1))
            yield pd.DataFrame([(k, *r) for k, r in zip(b["hash"], rows)], columns=names)

    return df.select("hash", column).mapInPandas(run, schema)

"""Analysis of develop settings: rows with ``develop``, a map of setting names to texts, null where there is none.

A record without settings, or with an empty map, has no part in any of these. Settings that are no number count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.media import hls_hex
from shutterlake.functions.portable import hue_band
from shutterlake.operators.aggregates import summary, top_per, unpivot

#: Setting names.
TONE = ["Exposure2012", "Highlights2012", "Shadows2012", "Whites2012", "Blacks2012", "Contrast2012", "Clarity2012", "Texture"]
CORE = [*TONE, "Dehaze", "Saturation", "Vibrance"]
#: The sliders of the plain statistics carry no version suffix.
PLAIN = ["Exposure", "Contrast", "Highlights", "Shadows", "Whites", "Blacks", "Clarity", "Vibrance", "Saturation", "Sharpness", "LuminanceSmoothing", "ColorNoiseReduction"]
JOURNEY = [*CORE, "GrainAmount", "PostCropVignetteAmount", "Sharpness", "LuminanceSmoothing", "ColorNoiseReduction"]
CHANNELS = ["Red", "Orange", "Yellow", "Green", "Aqua", "Blue", "Purple", "Magenta"]
SIGNATURE = {
    "Exposure2012": (5, "tone"), "Highlights2012": (100, "tone"), "Shadows2012": (100, "tone"), "Whites2012": (100, "tone"), "Blacks2012": (100, "tone"), "Contrast2012": (100, "tone"),
    "Texture": (100, "presence"), "Clarity2012": (100, "presence"), "Dehaze": (100, "presence"), "Vibrance": (100, "color"), "Saturation": (100, "color"),
}


def number(key: str) -> str:
    """SQL of a setting's value."""
    return f"try_cast(try_element_at(develop, '{key}') AS double)"


def text(key: str) -> str:
    return f"try_element_at(develop, '{key}')"


def edited(rows: DataFrame) -> DataFrame:
    return rows.where("size(develop) > 0")


#: Sum of distances from 0 over eleven sliders; a missing one counts as 0.
INTENSITY = " + ".join(f"abs(coalesce({number(k)}, 0D))" for k in CORE)
#: The same over ten sliders, without Dehaze.
INTENSITY10 = " + ".join(f"abs(coalesce({number(k)}, 0D))" for k in CORE if k != "Dehaze")
HSL_INTENSITY = " + ".join(f"abs(coalesce({number(a + 'Adjustment' + c)}, 0D))" for c in CHANNELS for a in ("Hue", "Saturation", "Luminance"))
AUTO_WB = f"lower(coalesce({text('WhiteBalance')}, '')) = 'auto'"
UPRIGHT = f"coalesce({text('PerspectiveUpright')}, '') NOT IN ('', '0', '0.0', 'Off', 'off')"
LENS_PROFILE = f"coalesce({text('LensProfileEnable')}, '') IN ('1', '1.0')"
LATERAL = f"coalesce({text('AutoLateralCA')}, '') IN ('1', '1.0')"
CURVE = f"coalesce({text('ToneCurveName2012')}, '') = 'Custom'"
CROP = f"coalesce({text('HasCrop')}, '') NOT IN ('', '0', '0.0')"
TONED = f"coalesce({number('SplitToningShadowSaturation')}, 0) > 3 OR coalesce({number('SplitToningHighlightSaturation')}, 0) > 3"
AUTOMATION = "(" + " + ".join(f"CAST({c} AS int)" for c in (AUTO_WB, UPRIGHT, LENS_PROFILE, LATERAL)) + ") / 4.0D"


def slider_rows(rows: DataFrame, keep: list[str], sliders: list[str]) -> DataFrame:
    """(keep, slider, value) of the settings that are there, in one pass."""
    return unpivot(edited(rows), keep, {k: number(k) for k in sliders}, "slider")


def slider_means(rows: DataFrame, by: list[str] | None = None, sliders: list[str] | None = None) -> DataFrame:
    by = by or []
    return slider_rows(rows, by, sliders or PLAIN).groupBy(*by, "slider").agg(F.expr("round(avg(value) + 1e-9, 4)").alias("mean"), F.count("*").alias("n"))


def split_toning(rows: DataFrame) -> DataFrame:
    """One row: colours of shadows, midtones and highlights, the style in words, and shifts."""
    keys = {
        "sh": "SplitToningShadowHue", "ss": "SplitToningShadowSaturation", "hh": "SplitToningHighlightHue", "hs": "SplitToningHighlightSaturation", "mh": "ColorGradeMidtoneHue", "ms": "ColorGradeMidtoneSat",
        "balance": "SplitToningBalance", "sl": "ColorGradeShadowLum", "ml": "ColorGradeMidtoneLum", "hl": "ColorGradeHighlightLum",
    }
    means = summary(edited(rows), {n: f"round(avg({number(k)}), 4)" for n, k in keys.items()})
    named = means.selectExpr("*", f"CASE WHEN coalesce(ss, 0) > 3 THEN {hue_band('sh')} END AS shadow", f"CASE WHEN coalesce(hs, 0) > 3 THEN {hue_band('hh')} END AS high")
    style = "CASE WHEN shadow IS NOT NULL AND high IS NOT NULL THEN concat(upper(left(high, 1)), substr(high, 2), ' highlights · ', shadow, ' shadows') WHEN shadow IS NOT NULL THEN concat(upper(left(shadow, 1)), substr(shadow, 2), ' shadows') WHEN high IS NOT NULL THEN concat(upper(left(high, 1)), substr(high, 2), ' highlights') ELSE 'Neutral (no toning)' END"
    shift = lambda c, out: F.expr(f"round(coalesce({c}, 0) + 1e-9, 1)").alias(out)
    c = F.col
    return named.select(
        hls_hex(c("sh"), F.lit(22.0), c("ss")).alias("shadow_color"), hls_hex(c("mh"), F.lit(50.0), c("ms")).alias("midtone_color"), hls_hex(c("hh"), F.lit(78.0), c("hs")).alias("highlight_color"),
        F.expr(style).alias("style"), shift("balance", "balance"), shift("sl", "shadow_shift"), shift("ml", "midtone_shift"), shift("hl", "highlight_shift"),
    )


def signature(rows: DataFrame) -> DataFrame:
    """(slider, kind, median, std, norm): the usual value of each slider, its spread, and how far it is along its range."""
    per = slider_rows(rows, [], [*SIGNATURE, "Temperature"]).groupBy("slider").agg(F.expr("percentile(value, 0.5)").alias("m"), F.stddev_pop("value").alias("s"))
    span = "CASE slider " + " ".join(f"WHEN '{k}' THEN {hi}" for k, (hi, _) in SIGNATURE.items()) + " END"
    kind = "CASE slider " + " ".join(f"WHEN '{k}' THEN '{g}'" for k, (_, g) in SIGNATURE.items()) + " ELSE 'color' END"
    temperature = "slider = 'Temperature'"
    return per.selectExpr(
        "slider", f"{kind} AS kind", f"CASE WHEN {temperature} THEN round(m, 0) ELSE round(m, 1) END AS median", f"CASE WHEN {temperature} THEN round(s, 0) ELSE round(s, 1) END AS std",
        f"round(CASE WHEN {temperature} THEN (m - 5500) / 5500 ELSE m / {span} END, 3) AS norm",
    )


def narrative(found: DataFrame) -> DataFrame:
    """One row: what ``signature`` says, in words; empty if nothing stands out."""
    m = {n: f"max(CASE WHEN slider = '{k}' THEN median END)" for n, k in (("hl", "Highlights2012"), ("sh", "Shadows2012"), ("vib", "Vibrance"), ("sat", "Saturation"), ("temp", "Temperature"), ("exp", "Exposure2012"))}
    v = summary(found, m).na.fill(0, ["hl", "sh", "vib", "sat", "exp"]).na.fill(5500, ["temp"])
    sign = lambda c: f"format_string('%+.0f', {c})"
    tonal = f"CASE WHEN hl < -40 AND sh > 30 THEN concat('Heavy tonal recovery — pulling highlights (', {sign('hl')}, ') while lifting shadows (', {sign('sh')}, ') for maximum dynamic range') WHEN hl < -20 THEN concat('Highlight recovery (', {sign('hl')}, ')') WHEN sh > 20 THEN concat('Shadow lifting (', {sign('sh')}, ')') END"
    colour = f"CASE WHEN vib > 20 AND sat < 0 THEN concat('Rich selective colour — vibrance ', {sign('vib')}, ' over global saturation (', {sign('sat')}, ') keeps skin tones natural') WHEN vib > 15 THEN concat('Vivid colour (vibrance ', {sign('vib')}, ')') END"
    white = "CASE WHEN temp > 6200 THEN concat('Warm white balance (', format_string('%.0f', temp), ' k)') WHEN temp < 4800 THEN concat('Cool white balance (', format_string('%.0f', temp), ' k)') END"
    light = "CASE WHEN abs(exp) > 0.4 THEN concat(CASE WHEN exp > 0 THEN 'Brightening' ELSE 'Darkening' END, ' exposure by ', format_string('%.1f', abs(exp)), ' stop', CASE WHEN abs(exp) >= 2 THEN 's' ELSE '' END) END"
    joined = f"array_join(array_compact(array({tonal}, {colour}, {white}, {light})), '. ')"
    return v.selectExpr(f"CASE WHEN {joined} = '' THEN '' ELSE concat({joined}, '.') END AS narrative")


def hsl_fingerprint(rows: DataFrame) -> DataFrame:
    """(channel, hue, sat, lum): mean adjustments of each colour channel, 0 where there are none."""
    each = ", ".join(f"'{c}', {', '.join(number(a + 'Adjustment' + c) for a in ('Hue', 'Saturation', 'Luminance'))}" for c in CHANNELS)
    long = edited(rows).selectExpr(f"stack({len(CHANNELS)}, {each}) AS (channel, h, s, l)")
    return long.groupBy("channel").agg(*[F.expr(f"coalesce(round(avg({x}) + 1e-9, 2), 0D)").alias(n) for x, n in (("h", "hue"), ("s", "sat"), ("l", "lum"))])


def journey(rows: DataFrame) -> DataFrame:
    """Per month ``ym``: means of the sliders, of intensities, adoption in per cent, and an automation score."""
    per = edited(rows).where("length(ym) >= 7").groupBy(F.expr("substr(ym, 1, 7)").alias("month"))
    rate = lambda c: f"round(100D * avg(CASE WHEN {c} THEN 1D ELSE 0D END) + 1e-9, 1)"
    auto = ", ".join(f"{rate(c)} / 100" for c in (AUTO_WB, UPRIGHT, LENS_PROFILE, LATERAL))
    metrics = {"n": "count(*)"} | {k.lower(): f"round(avg({number(k)}) + 1e-9, 3)" for k in JOURNEY}
    metrics |= {"hsl_intensity": f"round(avg({HSL_INTENSITY}) + 1e-9, 1)", "edit_intensity": f"round(avg({INTENSITY}) + 1e-9, 1)", "toning_pct": rate(TONED), "crop_pct": rate(CROP), "curve_pct": rate(CURVE), "lens_pct": rate(LENS_PROFILE), "wb_pct": rate(AUTO_WB)}
    metrics["automation"] = f"round(aggregate(array({auto}), 0D, (a, x) -> a + x) / 4 + 1e-9, 3)"
    return per.agg(*[F.expr(e).alias(n) for n, e in metrics.items()])


def profiles(rows: DataFrame) -> DataFrame:
    """(profile, n, third_party_pct): the five most used camera profiles; the share of third-party ones is over all."""
    named = edited(rows).selectExpr(f"trim(coalesce(nullif({text('CameraProfile')}, ''), {text('CameraCalibrationProfile')})) AS profile").where("profile <> ''")
    counts = named.groupBy("profile").agg(F.count("*").alias("n"))
    third = named.agg(F.expr("CAST(round(100.0 * avg(CASE WHEN lower(profile) RLIKE '^(adobe|camera |embedded)' THEN 0 ELSE 1 END), 1) AS double)").alias("third_party_pct"))
    return top_per(counts, [], "n desc,profile", 5).crossJoin(F.broadcast(third))


def style_signatures(rows: DataFrame) -> DataFrame:
    """(signature): the threshold rules over mean settings that hold."""
    mean = lambda k: f"coalesce(avg({number(k)}), 0)"
    pct = lambda c: f"100D * avg(CASE WHEN {c} THEN 1D ELSE 0D END)"
    profile = f"trim(coalesce(nullif({text('CameraProfile')}, ''), {text('CameraCalibrationProfile')}))"
    third = f"coalesce(round(100D * avg(CASE WHEN {profile} = '' THEN NULL WHEN lower({profile}) RLIKE '^(adobe|camera |embedded)' THEN 0D WHEN {profile} IS NOT NULL THEN 1D END), 1), 0)"
    rules = {
        "film_grain": f"{mean('GrainAmount')} > 20", "high_clarity": f"{mean('Clarity2012')} > 20", "muted_palette": f"{mean('Saturation')} < -10", "vivid_palette": f"{mean('Saturation')} > 20 OR {mean('Vibrance')} > 30",
        "heavy_vignette": f"{mean('PostCropVignetteAmount')} < -20", "custom_curves": f"{pct(CURVE)} > 40", "preset_heavy": f"{third} > 50", "automation_reliant": f"avg({AUTOMATION}) > 0.7", "geometry_corrector": f"{pct(UPRIGHT)} > 20",
    }
    fired = summary(edited(rows), {n: f"CAST({c} AS int)" for n, c in rules.items()})
    return unpivot(fired, [], {n: n for n in rules}, "signature", "fired").where("fired = 1").select("signature")


def tonal_hex(rows: DataFrame, by: str) -> DataFrame:
    """(by, shadow, midtone, highlight): colours of the mean toning per group."""
    keys = {"sh": "SplitToningShadowHue", "ss": "SplitToningShadowSaturation", "hh": "SplitToningHighlightHue", "hs": "SplitToningHighlightSaturation", "mh": "ColorGradeMidtoneHue", "ms": "ColorGradeMidtoneSat"}
    m = rows.groupBy(by).agg(*[F.expr(f"round(avg({number(k)}), 4)").alias(n) for n, k in keys.items()])
    c = F.col
    return m.select(by, hls_hex(c("sh"), F.lit(25.0), c("ss")).alias("shadow"), hls_hex(c("mh"), F.lit(50.0), c("ms")).alias("midtone"), hls_hex(c("hh"), F.lit(75.0), c("hs")).alias("highlight"))


def wall_time(c: Column | str) -> Column:
    """The wall time written in an ISO stamp, whatever its zone; null for other notations."""
    c = F.col(c) if isinstance(c, str) else c
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.]\d{1,6})?(Z|[+-]\d{2}:\d{2})?$")
    return F.when(iso, F.try_to_timestamp(F.regexp_replace(F.substring(c, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))

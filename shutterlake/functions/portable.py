"""Scalar rules of the record model as SQL text that reads the same in Spark and in other engines.

Thresholds are fixed values of the record model; each function takes the SQL of its inputs.
"""

from __future__ import annotations


def case(*arms: tuple[str, str], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {other} END"


def time_of_day(h: str) -> str:
    return case((f"{h} IS NULL", "NULL"), (f"{h} BETWEEN 5 AND 7 OR {h} BETWEEN 17 AND 19", "'golden_hour'"), (f"{h} BETWEEN 10 AND 15", "'midday'"), (f"{h} < 5 OR {h} >= 20", "'night'"), other="'morning_evening'")


def caption_time(h: str) -> str:
    return case((f"{h} IS NULL", "'afternoon'"), (f"{h} BETWEEN 5 AND 9", "'morning'"), (f"{h} BETWEEN 10 AND 15", "'afternoon'"), (f"{h} BETWEEN 16 AND 19", "'evening'"), other="'night'")


def season(month: str) -> str:
    return case((f"{month} IS NULL", "'summer'"), (f"{month} BETWEEN 3 AND 5", "'spring'"), (f"{month} BETWEEN 6 AND 8", "'summer'"), (f"{month} BETWEEN 9 AND 11", "'autumn'"), other="'winter'")


def score_bucket(x: str) -> str:
    return case((f"{x} IS NULL", "NULL"), (f"{x} < 33", "'low'"), (f"{x} <= 66", "'mid'"), other="'high'")


def horizon_bucket(x: str) -> str:
    return case((f"{x} IS NULL", "'none'"), (f"{x} < 0.33", "'high'"), (f"{x} <= 0.66", "'mid'"), other="'low'")


def focal_category(x: str) -> str:
    return case((f"{x} IS NULL", "NULL"), (f"{x} < 35", "'wide'"), (f"{x} <= 70", "'normal'"), other="'telephoto'")


def depth_category(x: str) -> str:
    return case((f"{x} IS NULL", "NULL"), (f"{x} < 2.8", "'shallow'"), (f"{x} < 8", "'mid'"), other="'deep'")


def light_category(x: str) -> str:
    return case((f"{x} IS NULL", "NULL"), (f"{x} > 1600", "'low_light'"), (f"{x} > 400", "'indoor'"), other="'bright'")


def shutter_category(x: str) -> str:
    return case((f"{x} IS NULL", "NULL"), (f"{x} <= CAST(1 AS double) / 500", "'freeze'"), (f"{x} <= CAST(1 AS double) / 60", "'hand'"), (f"{x} <= CAST(1 AS double) / 15", "'slow'"), other="'bulb'")


def warmth(warm: str, cool: str) -> str:
    return case((f"{warm} > {cool}", "'warm'"), (f"{cool} > {warm}", "'cool'"), (f"{warm} = {cool}", "'neutral'"))


def framing_tier(x: str) -> str:
    return case((f"{x} IS NULL", "NULL"), (f"{x} < 0.25", "'tight'"), (f"{x} > 0.55", "'wide'"), other="'medium'")


def ramp(x: str, lo: float, hi: float) -> str:
    """Confidence rising from 0 at ``lo`` to 1 at ``hi``."""
    return case((f"{x} IS NULL OR {x} <= {lo}", "0.0"), other=f"round(least(1.0, ({x} - {lo}) / {hi - lo}), 2)")


#: Words by which a camera's make and model tell its class, tried in this order.
PHONES = ("apple", "samsung", "google", "pixel", "iphone", "huawei", "xiaomi", "oneplus", "oppo", "vivo", "realme")
MIRRORLESS = (
    "ilce", "α", "a7", "a6", "zfc", "z50", "z6", "z7", "z8", "z9", "xt", "x-t", "x-s", "gfx", "om-1", "om-5", "e-m", "sl2", "sl3", "rp",
    "r5", "r6", "r7", "r8", "r10", "r50", "r100", "r3", "r1", "s5", "s9", "gh6", "gh7", "g9",
)
REFLEX = (
    "eos", "nikon d", "nikon z", "d3", "d4", "d5", "d6", "d7", "d8", "d500", "d750", "d800", "d810", "d850", "7d", "5d", "6d", "rebel", "k-", "pentax",
)


def device_class(make: str, model: str) -> str:
    """Phone, mirrorless, dslr, other or unknown, by the first list of which some word occurs in the lower-cased make and model."""
    text = f"lower(concat(coalesce({make}, ''), ' ', coalesce({model}, '')))"
    has = lambda words: " OR ".join(f"contains({text}, '{w}')" for w in words)
    empty = lambda x: f"coalesce({x}, '') = ''"
    return case((f"{empty(make)} AND {empty(model)}", "'unknown'"), (has(PHONES), "'phone'"), (has(MIRRORLESS), "'mirrorless'"), (has(REFLEX), "'dslr'"), (f"NOT {empty(make)}", "'other'"), other="'unknown'")


def is_zoom(lens: str) -> str:
    """A lens name with a dash and a digit is a zoom."""
    return f"(({lens} LIKE '%-%' OR {lens} LIKE '%–%') AND translate({lens}, '0123456789', '') <> {lens})"


def hue_band(h: str) -> str:
    """Name of a hue in degrees, whatever turn it is in."""
    h = f"({h} - 360 * floor({h} / 360))"
    return case((f"{h} IS NULL", "NULL"), (f"{h} < 20 OR {h} >= 340", "'red'"), (f"{h} < 45", "'orange'"), (f"{h} < 70", "'yellow'"), (f"{h} < 150", "'green'"), (f"{h} < 200", "'cyan/teal'"), (f"{h} < 260", "'blue'"), (f"{h} < 290", "'purple'"), other="'magenta'")


def bars(x: str, edges: list[float]) -> str:
    """Number of the half-open interval (edge, next edge] that ``x`` lies in, from 0; null outside."""
    return case(*[(f"{x} > {lo} AND {x} <= {hi}", str(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])

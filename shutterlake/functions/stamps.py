"""Reading written timestamps: many notations, precisions and zones, into UTC microseconds.

All of it is built from Spark expressions, so parsing stays inside the JVM.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Usual offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_BLANKS = " \t\r\n 　"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_TAIL = r"(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?\s*(.*)$"
#: Notation -> (pattern, order in which its groups give year, month, day, h, m, s, fraction, am/pm, zone).
_NOTATIONS = [
    ("i", r"^(\d{4})([-:/])(\d{1,2})\2(\d{1,2})(?:[Tt]|\s+)" + _TIME + _TAIL, "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("i", r"^(\d{4})(\d{2})(\d{2})[Tt\s]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?()\s*(.*)$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("s", r"^(\d{1,2})/(\d{1,2})/(\d{4}),?(?:[Tt]|\s+)" + _TIME + _TAIL, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("i", r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?(?:[Tt]|\s+)" + _TIME + _TAIL, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("n", r"^(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4}),?\s+" + _TIME + _TAIL, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("n", r"^(?:[A-Za-z]{3,9}\.?,\s*)?([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+" + _TIME + _TAIL, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
_ZONE = r"^(?:(?:UTC|GMT|Z)?([+\-−])(\d{1,2}):?(\d{2})?|([A-Za-z]{1,5})(?![A-Za-z_/]))?\s*[\[(]?((?:[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)?)[\])]?$"
SECOND = 1_000_000


def blankless(c: Column) -> Column:
    """Without outer blanks."""
    return F.btrim(c, F.lit(_BLANKS))


def _month_number(text: Column) -> Column:
    """1-12 from a month's English name or its first three letters; null otherwise."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(text, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def year_month_index(text: Column) -> Column:
    """``year * 12 + month - 1`` from a written year and month in any usual spelling; null if it isn't a real one."""
    t = blankless(text)
    y = F.when(t.rlike(r"^\d{4}[-/:. ]?\d{2}$"), F.substring(t, 1, 4)).otherwise(F.regexp_extract(t, r"(\d{4})$", 1))
    m = (
        F.when(t.rlike(r"^\d{4}[-/:. ]?\d{2}$"), F.right(t, F.lit(2)).try_cast("int"))
        .when(t.rlike(r"^\d{1,2}[-/:. ]\d{4}$"), F.regexp_extract(t, r"^(\d{1,2})", 1).try_cast("int"))
        .when(t.rlike(r"^[A-Za-z]{3,9}\.?[ -]\d{4}$"), _month_number(t))
    )
    return F.when(m.between(1, 12), y.try_cast("int") * 12 + m - 1)


def day_us(y: Column, m: Column, d: Column) -> Column:
    """Microseconds of a date's midnight counted from 1970 without any zone; null if there is no such date."""
    zero = F.lit(0)
    date = F.try_make_timestamp_ntz(y, m, d, zero, zero, F.lit(0).cast("decimal(16,6)")).cast("date")
    return F.when(y >= 1, F.unix_date(date).cast("bigint") * (86_400 * SECOND))


def wall_to_utc(local_us: Column, zone: Column) -> Column:
    """UTC microseconds of a wall time in a named zone.

    A wall time that occurs twice means the earlier instant; one that was skipped moves forward by the gap.
    Unknown zone names give null.
    """
    # one string literal: a list of some six hundred literals would cost seconds of planning
    known = F.lit("|" + "|".join(sorted(zoneinfo.available_timezones())) + "|")
    good = F.when(F.contains(known, F.concat(F.lit("|"), zone, F.lit("|"))) & ~F.contains(zone, F.lit("|")), zone)
    return F.when(good.isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), good)))


def with_stamp(df: DataFrame, text: Column, out: str, month: Column, default_zone: Column) -> DataFrame:
    """Add ``out``: the one instant in UTC microseconds that ``text`` denotes, or null.

    ``month``: a ``year_month_index`` that decides between day/month and month/day. ``default_zone``: the named zone of
    values without one. Impossible dates and times, incomplete values and unknown zones give null.
    """
    p = f"__{out}"
    while any(c.startswith(p) for c in df.columns):
        p = f"_{p}"
    # SQL text: one call for a stage instead of a round trip to the JVM for each of some hundred expressions
    df = df.withColumns({f"{p}_t": blankless(text), f"{p}_m": month, f"{p}_q": default_zone})
    # whole-stage code of all this would be one method too large for the JVM's compiler, which leaves it interpreted; a
    # higher-order function in a projection keeps it out of the stage, so that its code comes in small methods
    apart = lambda e: f"get(transform(array({e}), x -> x), 0)"
    number = lambda a, i: f"try_cast(get({a}, {i}) as int)"
    parts = f"CASE WHEN {p}_t RLIKE r'^\\d+$' AND length({p}_t) IN (10, 13, 16) THEN array('e', {p}_t) "
    for kind, pattern, order in _NOTATIONS:
        parts += f"WHEN {p}_t RLIKE r'{pattern}' THEN split(regexp_replace({p}_t, r'{pattern}', '{kind}|{order}'), r'\\|', 11) "
    df = df.withColumn(f"{p}_a", F.expr(apart(parts + "END")))
    names = ", ".join(f"'{m}'" for m in MONTHS)
    df = df.selectExpr(
        "*",
        f"{apart(f'get({p}_a, 0)')} AS {p}_k", f"{number(f'{p}_a', 1)} AS {p}_y", f"{number(f'{p}_a', 3)} AS {p}_dd", f"get({p}_a, 9) AS {p}_z",
        f"CASE WHEN get({p}_a, 0) = 'n' THEN nullif(array_position(array({names}), lower(left(get({p}_a, 2), 3))), 0) ELSE {number(f'{p}_a', 2)} END AS {p}_mm",
        f"CASE WHEN get({p}_a, 8) = '' THEN {number(f'{p}_a', 4)} WHEN {number(f'{p}_a', 4)} BETWEEN 1 AND 12 THEN {number(f'{p}_a', 4)} % 12 + if(upper(get({p}_a, 8)) = 'P', 12, 0) END AS {p}_h",
        f"{number(f'{p}_a', 5)} AS {p}_mi", f"if(get({p}_a, 6) = '', 0, {number(f'{p}_a', 6)}) AS {p}_s",
        f"if(get({p}_a, 7) = '', 0, try_cast(rpad(left(get({p}_a, 7), 6), 6, '0') AS int)) AS {p}_us",
    )
    day = lambda mo, d: f"CASE WHEN {p}_y >= 1 THEN CAST(unix_date(CAST(try_make_timestamp_ntz({p}_y, {mo}, {d}, 0, 0, CAST(0 AS decimal(16,6))) AS date)) AS bigint) * {86_400 * SECOND} END"
    fixed = "str_to_map('" + ",".join(f"{k}:{v}" for k, v in ABBREVIATIONS.items()) + "')"
    df = df.selectExpr(
        "*",
        f"CASE WHEN {p}_h BETWEEN 0 AND 23 AND {p}_mi BETWEEN 0 AND 59 AND {p}_s BETWEEN 0 AND 59 THEN CAST({p}_h * 3600 + {p}_mi * 60 + {p}_s AS bigint) * {SECOND} + {p}_us END AS {p}_c",
        f"{day(f'CAST({p}_mm AS int)', f'{p}_dd')} AS {p}_d1", f"CASE WHEN {p}_k = 's' THEN {day(f'{p}_dd', f'CAST({p}_mm AS int)')} END AS {p}_d2",
        f"{apart(f'try_cast(try_element_at({fixed}, upper({p}_z)) AS int)')} AS {p}_o",
        f"CASE WHEN {p}_z <> '' AND NOT {p}_z RLIKE r'^[A-Za-z]{{1,5}}$' AND {p}_z RLIKE r'{_ZONE}' THEN split(regexp_replace({p}_z, r'{_ZONE}', '$1|$2|$3|$4|$5'), r'\\|', 6) END AS {p}_p",
    )
    minutes = f"if(get({p}_p, 2) = '', 0, {number(f'{p}_p', 2)})"
    df = df.selectExpr(
        "*",
        f"""CASE WHEN {p}_d2 IS NULL OR {p}_d1 = {p}_d2 THEN {p}_d1 WHEN {p}_d1 IS NULL THEN {p}_d2
            WHEN {p}_y * 12 + {p}_mm - 1 = {p}_m THEN {p}_d1 WHEN {p}_y * 12 + {p}_dd - 1 = {p}_m THEN {p}_d2 END + {p}_c AS {p}_l""",
        f"""coalesce({p}_o, CASE WHEN get({p}_p, 0) <> '' THEN CASE WHEN {minutes} <= 59 AND {number(f'{p}_p', 1)} * 60 + {minutes} <= 1080
            THEN ({number(f'{p}_p', 1)} * 60 + {minutes}) * if(get({p}_p, 0) = '+', 1, -1) END
            WHEN get({p}_p, 3) <> '' THEN try_cast(try_element_at({fixed}, upper(get({p}_p, 3))) AS int) END) AS {p}_f""",
        # the zone a wall time is in, where no offset decides; a zone text that can't be read gives none
        apart(f"CASE WHEN {p}_z = '' THEN {p}_q WHEN get({p}_p, 0) = '' AND get({p}_p, 3) = '' AND get({p}_p, 4) <> '' THEN get({p}_p, 4) END") + f" AS {p}_n",
    )
    epoch = F.expr(f"try_cast(get({p}_a, 1) AS bigint) * CASE length(get({p}_a, 1)) WHEN 10 THEN {SECOND} WHEN 13 THEN 1000 ELSE 1 END")
    local, shift, name = F.col(f"{p}_l"), F.col(f"{p}_f"), F.col(f"{p}_n")
    instant = F.when(F.col(f"{p}_k") == "e", epoch).when(shift.isNotNull(), local - shift.cast("bigint") * (60 * SECOND)).when(name == "UTC", local).otherwise(wall_to_utc(local, name))
    # a wall time without any zone stays available to zone estimation
    df = df.withColumns({out: F.get(F.transform(F.array(instant), lambda x: x), F.lit(0)), f"{out}_wall": F.when(F.col(f"{p}_z") == "", local)})
    return df.drop(*[c for c in df.columns if c.startswith(f"{p}_")])

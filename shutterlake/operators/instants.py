"""Mixed timestamp formats and time zones: one UTC instant for each written stamp of a delivery feed.

Stamps with a zone of their own convert directly. Stamps without one need the camera's zone: the declared one, or an
estimate. The estimate aligns a camera's zone-less wall times with the times its rows were received: a row violates a
zone when its photo would have been taken after it was received, and the history of zones with the fewest violations
wins, a camera that moves having more than one.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.functions.stamps import SECOND, blankless, wall_to_utc, with_stamp, year_month_index

FIELDS = ("lightroom_capture_date", "lightroom_updated", "exif")


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_home_zone(feed: DataFrame, cameras: DataFrame) -> DataFrame:
    """``feed`` with ``__zone``, the declared zone of the row's camera. Catalyst broadcasts ``cameras`` only if its size allows."""
    zones = cameras.where(F.col("camera_id").isNotNull()).groupBy(F.col("camera_id").alias("__camera")).agg(F.max(blankless(F.col("home_tz"))).alias("__zone"))
    return feed.join(zones, feed.camera_id == F.col("__camera"), "left").drop("__camera")


def read_stamps(feed: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row per row of ``feed``: its keys and the instants ``capture_us``, ``updated_us`` and ``exif_us``.

    Nulls: a null, empty, impossible or incomplete stamp gives null; so does a stamp without zone where ``camera_id`` or
    its zone is null. ``exif_us`` is given only where ``capture_us`` is null. ``wall_us`` and ``exif_wall_us`` are the wall
    times of stamps that name no zone. Rows are never dropped or merged: repeated rows come out repeated, an empty feed
    gives an empty result, and other columns of ``feed`` are ignored, whatever they are called.
    """
    exif = feed.schema["exif"].dataType if "exif" in feed.columns else None
    has = lambda n: isinstance(exif, T.StructType) and n in exif.names
    slim = feed.select(
        "row_id", _column(feed, "lightroom_id", "string").alias("lightroom_id"), "camera_id",
        F.col("lightroom_capture_date").alias("__capture"), F.col("lightroom_updated").alias("__updated"),
        (F.col("exif.hour") if has("hour") else F.lit(None).cast("int")).alias("__hour"),
        year_month_index(F.col("exif.year_month") if has("year_month") else F.lit(None).cast("string")).alias("__month"),
        _column(feed, "received_at", "timestamp_ntz").alias("__received"),
    )
    slim = with_home_zone(slim, cameras)
    df = with_stamp(slim, F.col("__capture"), "capture_us", F.col("__month"), F.col("__zone"))
    df = with_stamp(df, F.col("__updated"), "updated_us", F.col("__month"), F.lit("UTC"))
    month = F.col("__month")
    first = F.unix_date(F.make_date((month / 12).cast("int"), month % 12 + 1, F.lit(1))).cast("bigint") * (86_400 * SECOND)
    wall = F.when(F.col("__hour").between(0, 23) & (month >= 12), first + F.col("__hour").cast("bigint") * (3600 * SECOND))
    exif_us = F.when(F.col("capture_us").isNull() & wall.isNotNull(), wall_to_utc(wall, F.col("__zone")))
    received = F.when(F.col("__received").isNotNull(), F.unix_date(F.col("__received").cast("date")).cast("bigint") * (86_400 * SECOND) + (F.hour("__received") * 3600 + F.minute("__received") * 60 + F.second("__received")).cast("bigint") * SECOND)
    return df.select("row_id", "lightroom_id", "camera_id", "capture_us", "updated_us", exif_us.alias("exif_us"), F.col("capture_us_wall").alias("wall_us"), F.when(F.col("capture_us").isNull(), wall).alias("exif_wall_us"), received.alias("received_us"), F.col("__zone").alias("zone"))


def instants(stamps: DataFrame) -> DataFrame:
    """``read_stamps`` as (row_id, field, utc_us), one row for each stamp that denotes an instant."""
    each = [F.struct(F.lit(f).alias("field"), F.col(c).alias("utc_us")) for f, c in zip(FIELDS, ("capture_us", "updated_us", "exif_us"))]
    return stamps.select("row_id", F.inline(F.filter(F.array(*each), lambda x: x.utc_us.isNotNull())))


#: What a change of zone costs against violations, so that a few late clocks don't make a camera travel.
SWITCH = 5.0
#: What an hour that even the quickest delivery of a month took costs for each of its rows: a zone too far east violates nothing.
IDLE = 0.02
_EVER = 1 << 62


def estimate_zones(feed: DataFrame, cameras: DataFrame, slack_s: int = 60, switch: float = SWITCH) -> DataFrame:
    """(camera_id, from_us, until_us, zone, n_rows, n_violations) for cameras without a declared zone: the history of zones that fits best.

    A camera's zone-less walls, of capture dates or else of exif, are scored by month: a row violates a candidate if its
    photo would have been taken after it was received. The history chosen has the fewest violations, each change of zone
    between months counting as ``switch`` of them and an hour's delay of even the quickest row of a month as ``IDLE`` for
    each of its rows, then the smallest total delay. ``from_us`` and ``until_us`` (exclusive)
    bound a stretch in wall time. Candidates are the zones that ``cameras`` declares, or all known ones if it declares none.
    Cameras without any zone-less stamp have no row. Ties take the name that sorts first.
    """
    minute = 60 * SECOND
    stamps = read_stamps(feed, cameras).withColumn("wall_us", F.coalesce("wall_us", "exif_wall_us"))
    open_ = F.col("zone").isNull() & F.col("camera_id").isNotNull() & F.col("wall_us").isNotNull() & F.col("received_us").isNotNull()
    to_minute = lambda c: (F.floor(F.col(c) / minute) * minute).cast("bigint").alias(c)
    # equal wall times and arrivals of a minute weigh as one row with a count: a hot camera is reduced before any join
    points = stamps.groupBy("camera_id", to_minute("wall_us"), to_minute("received_us")).agg(F.sum(F.when(open_, 1)).alias("n")).where("n > 0")
    everywhere = F.array(*[F.lit(z) for z in sorted(zoneinfo.available_timezones()) if "/" in z and not z.startswith(("Etc/", "posix/", "right/"))])
    declared = cameras.select(blankless(F.col("home_tz")).alias("z")).where("z is not null").agg(F.array_sort(F.collect_set("z")).alias("zones"))
    candidates = declared.select(F.when(F.size("zones") > 0, F.col("zones")).otherwise(everywhere).alias("zones"))
    tried = points.crossJoin(candidates).select("*", F.explode("zones").alias("cand")).drop("zones")
    delay = F.col("received_us") - wall_to_utc(F.col("wall_us"), F.col("cand"))
    month = F.trunc(F.timestamp_micros("wall_us").cast("date"), "month")
    scored = tried.withColumn("delay", delay).where("delay is not null").groupBy("camera_id", "cand", month.alias("month")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("delay") < -slack_s * SECOND, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.abs("delay") / SECOND * F.col("n")).alias("total"), F.min(F.when(F.col("delay") >= -slack_s * SECOND, F.col("delay"))).alias("least"))

    def history(pdf: pd.DataFrame) -> pd.DataFrame:
        # as many rows as months times candidates
        months, zones = sorted(pdf["month"].unique()), sorted(pdf["cand"].unique())
        grid = lambda c: pdf.pivot(index="month", columns="cand", values=c).reindex(index=months, columns=zones).fillna(0).to_numpy(float)
        bad, total, n = grid("bad"), grid("total"), grid("n").max(axis=1)
        idle = np.clip(grid("least") / (3600 * SECOND), 0, 24)
        cost = bad + IDLE * n[:, None] * idle + 0.5 * total / max(1.0, total.sum(axis=0).max())
        best, back = cost[0], []
        for row in cost[1:]:
            stay = np.arange(len(zones))
            back.append(np.where(best <= best.min() + switch, stay, best.argmin()))
            best = np.minimum(best, best.min() + switch) + row
        path = [int(best.argmin())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        starts = [i for i in range(len(path)) if i == 0 or path[i] != path[i - 1]]
        edge = [int(pd.Timestamp(months[i]).value // 1000) for i in starts]
        ends = [*starts[1:], len(path)]
        return pd.DataFrame({
            "camera_id": int(pdf["camera_id"].iloc[0]), "from_us": [-_EVER, *edge[1:]], "until_us": [*edge[1:], _EVER], "zone": [zones[path[i]] for i in starts],
            "n_rows": [int(n[i:j].sum()) for i, j in zip(starts, ends)], "n_violations": [int(bad[np.arange(i, j), path[i]].sum()) for i, j in zip(starts, ends)],
        })

    return scored.groupBy("camera_id").applyInPandas(history, "camera_id bigint, from_us bigint, until_us bigint, zone string, n_rows bigint, n_violations bigint")


def estimated_instants(stamps: DataFrame, zones: DataFrame) -> DataFrame:
    """(row_id, field, utc_us) of the zone-less stamps of ``stamps`` whose camera has a zone in ``zones`` (of ``estimate_zones``) only."""
    guess = zones.select(F.col("camera_id").alias("__c"), F.col("zone").alias("__guess"), "from_us", "until_us")
    wall = F.coalesce("wall_us", "exif_wall_us")
    rows = stamps.join(guess, (stamps.camera_id == F.col("__c")) & stamps.zone.isNull() & (wall >= F.col("from_us")) & (wall < F.col("until_us")), "inner")
    capture = wall_to_utc(F.col("wall_us"), F.col("__guess"))
    exif = F.when(F.col("wall_us").isNull(), wall_to_utc(F.col("exif_wall_us"), F.col("__guess")))
    each = F.array(F.struct(F.lit(FIELDS[0]).alias("field"), capture.alias("utc_us")), F.struct(F.lit(FIELDS[2]).alias("field"), exif.alias("utc_us")))
    return rows.select("row_id", F.inline(F.filter(each, lambda x: x.utc_us.isNotNull())))

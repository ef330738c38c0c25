import datetime as dt

import pytest
from pyspark.sql import functions as F

from shutterlake.operators.instants import estimate_zones, estimated_instants, instants, read_stamps

FEED = "row_id bigint, lightroom_id string, camera_id bigint, lightroom_capture_date string, lightroom_updated string, exif struct<hour int, year_month string>, received_at timestamp_ntz, extra string, zone string, capture_us int"
CAMERAS = "camera_id bigint, home_tz string, zone string"


def us(*x):
    return (dt.datetime(*x) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


CASES = [
    ("1393080742", None, us(2014, 2, 22, 14, 52, 22)), ("1393080742381", None, us(2014, 2, 22, 14, 52, 22, 381000)), (" 1393083203084627 ", None, us(2014, 2, 22, 15, 33, 23, 84627)),
    ("13930832030", None, None), ("2014-02-22T15:29:51Z", None, us(2014, 2, 22, 15, 29, 51)), ("2014-02-22T15:29:51.1234567z", None, us(2014, 2, 22, 15, 29, 51, 123456)),
    ("2014-02-22T18:34:18+03:00", None, us(2014, 2, 22, 15, 34, 18)), ("2014-02-22 18:34:18 +0530", None, us(2014, 2, 22, 13, 4, 18)), ("2014-02-22T18:34:18-04", None, us(2014, 2, 22, 22, 34, 18)),
    ("20140222T191729.5Z", None, us(2014, 2, 22, 19, 17, 29, 500000)), ("2014:02:22 07:27:45", None, us(2014, 2, 22, 6, 27, 45)), ("22.02.2014 06:44:28,5", None, us(2014, 2, 22, 5, 44, 28, 500000)),
    ("22/02/2014 07:24:49", None, us(2014, 2, 22, 6, 24, 49)), ("2/22/2014 7:24:49 PM", None, us(2014, 2, 22, 18, 24, 49)), ("02/03/2014 07:00:00", "2014-03", us(2014, 3, 2, 6)),
    ("02/03/2014 07:00:00", "03.2014", us(2014, 3, 2, 6)), ("02/03/2014 07:00:00", "Feb 2014", us(2014, 2, 3, 6)), ("02/03/2014 07:00:00", "2014/07", None), ("02/03/2014 07:00:00", None, None), ("03/03/2014 07:00:00", None, us(2014, 3, 3, 6)),
    ("Sun, 16 Mar 2014 07:07:47 +0530", None, us(2014, 3, 16, 1, 37, 47)), ("Apr 25, 2014, 3:51:44 PM", None, us(2014, 4, 25, 13, 51, 44)), ("5 Apr 2014 21:33:48", None, us(2014, 4, 5, 19, 33, 48)),
    ("2014-02-22 07:29:59 PST", None, us(2014, 2, 22, 15, 29, 59)), ("2014-08-20T06:52:07+02:00[Europe/London]", None, us(2014, 8, 20, 4, 52, 7)), ("2015-02-04T01:56:13 Europe/London", None, us(2015, 2, 4, 1, 56, 13)),
    ("2014-05-29T21:06:40[Asia/Kathmandu]", None, us(2014, 5, 29, 15, 21, 40)), ("2014-05-29T21:06:40[Mars/Base]", None, None), ("2014-05-29T21:06:40 XYZ", None, None), ("2014-10-26T02:30:00", None, us(2014, 10, 26, 0, 30)),
    ("2014-03-30T02:30:00", None, us(2014, 3, 30, 1, 30)), ("2014-02-30T00:00:00Z", None, None), ("2014-02-22T25:00:00Z", None, None), ("0000:00:00 00:00:00", None, None), ("2014-02-22", None, None), ("07:00:00", None, None),
    ("", None, None), ("   ", None, None), (None, None, None), ("unknown", None, None), ("x" * 20000, None, None), ("13/13/2014 10:00:00", None, None), ("2014-02-22T10:00:60Z", None, None), ("1/2/2014 13:00:00 PM", "2014-01", None),
]


@pytest.fixture(scope="module")
def cameras(spark):
    return spark.createDataFrame([(1, "Europe/Berlin", "x"), (2, None, "x"), (3, "No/Zone", "x")], CAMERAS)


def rows(spark, feed, cameras):
    return {(r.row_id, r.field): r.utc_us for r in instants(read_stamps(spark.createDataFrame(feed, FEED), cameras)).collect()}


def test_notations(spark, cameras):
    feed = [(i, "p", 1, text, None, (None, month), None, "e", "z", 0) for i, (text, month, _) in enumerate(CASES)]
    got = rows(spark, feed, cameras)
    wrong = {c[0]: (got.get((i, "lightroom_capture_date")), c[2]) for i, c in enumerate(CASES) if got.get((i, "lightroom_capture_date")) != c[2]}
    assert not wrong


def test_zones_and_fallback(spark, cameras):
    t = "2014-07-01T12:00:00"
    feed = [
        (1, "p", None, t, t, (5, "2014-07"), None, "", "", 0), (2, "p", 2, t, t, (5, "2014-07"), None, "", "", 0), (3, "p", 3, t, None, None, None, "", "", 0), (4, "p", 1, "unknown", None, (5, "2014:07"), None, "", "", 0),
        (5, "p", 1, None, None, (24, "2014-07"), None, "", "", 0), (6, "p", 1, t, None, (5, "2014-07"), None, "", "", 0), (6, "p", 1, t, None, (5, "2014-07"), None, "", "", 0), (7, "p", 99, t, None, (5, "2014-07"), None, "", "", 0),
    ]
    got = rows(spark, feed, cameras)
    assert got == {
        (1, "lightroom_updated"): us(2014, 7, 1, 12), (2, "lightroom_updated"): us(2014, 7, 1, 12), (4, "exif"): us(2014, 7, 1, 3), (6, "lightroom_capture_date"): us(2014, 7, 1, 10),
    }


def test_empty_feed(spark, cameras):
    assert rows(spark, [], cameras) == {}


def test_zone_is_estimated_from_arrivals(spark):
    cameras = spark.createDataFrame([(1, "Asia/Tokyo", ""), (2, "Europe/Berlin", ""), (3, None, "")], CAMERAS)
    day = dt.datetime(2014, 1, 5, 12)
    feed = [(i, "p", 3, str(day + dt.timedelta(hours=i)), None, None, day + dt.timedelta(hours=i - 9, minutes=3), "", "", 0) for i in range(20)]
    df = spark.createDataFrame(feed, FEED)
    zones = estimate_zones(df, cameras)
    assert [(r.camera_id, r.zone, r.n_rows, r.n_violations) for r in zones.collect()] == [(3, "Asia/Tokyo", 20, 0)]
    got = estimated_instants(read_stamps(df, cameras), zones).where(F.col("row_id") == 0).collect()
    assert [(r.field, r.utc_us) for r in got] == [("lightroom_capture_date", us(2014, 1, 5, 3))]


def test_a_camera_that_moves_has_two_zones(spark):
    cameras = spark.createDataFrame([(1, "Asia/Tokyo", ""), (2, "Europe/Berlin", ""), (3, None, ""), (4, None, "")], CAMERAS)
    first, then = dt.datetime(2014, 1, 5, 12), dt.datetime(2014, 3, 5, 12)
    feed = [(i, "p", 3, str(first + dt.timedelta(hours=i)), None, None, first + dt.timedelta(hours=i - 1, minutes=3), "", "", 0) for i in range(60)]
    feed += [(100 + i, "p", 3, str(then + dt.timedelta(hours=i)), None, None, then + dt.timedelta(hours=i - 9, minutes=3), "", "", 0) for i in range(60)]
    # one late clock is no journey; a camera with exif alone has a zone too
    feed += [(200, "p", 3, str(first), None, None, first - dt.timedelta(hours=30), "", "", 0), (300, "p", 4, None, None, (9, "2014-05"), dt.datetime(2014, 5, 1, 7, 5), "", "", 0)]
    df = spark.createDataFrame(feed, FEED)
    zones = sorted((r.camera_id, r.zone, r.n_violations) for r in estimate_zones(df, cameras).collect())
    assert zones == [(3, "Asia/Tokyo", 0), (3, "Europe/Berlin", 1), (4, "Europe/Berlin", 0)]
    got = {r.row_id: r.utc_us for r in estimated_instants(read_stamps(df, cameras), estimate_zones(df, cameras)).collect()}
    assert got[0] == us(2014, 1, 5, 11) and got[100] == us(2014, 3, 5, 3) and got[300] == us(2014, 5, 1, 7)


def test_without_any_declared_zone_all_are_candidates(spark):
    cameras = spark.createDataFrame([(3, None, "")], CAMERAS)
    day = dt.datetime(2014, 1, 5, 12)
    df = spark.createDataFrame([(i, "p", 3, str(day + dt.timedelta(hours=i)), None, None, day + dt.timedelta(hours=i) - dt.timedelta(hours=5, minutes=45), "", "", 0) for i in range(5)], FEED)
    assert [r.zone for r in estimate_zones(df, cameras).collect()] == ["Asia/Kathmandu"]

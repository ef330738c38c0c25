"""Queries of problems 5 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators.instants import estimate_zones, estimated_instants, instants, read_stamps
from shutterlake.operators.sessions import GapTree, photo_times
from shutterlake.sources.tables import table

HOUR_US = 3_600_000_000


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants(read_stamps(table(spark, folder, "asset_feed"), table(spark, folder, "cameras")))


def p5_zones(spark: SparkSession, folder: str) -> DataFrame:
    return estimate_zones(table(spark, folder, "asset_feed"), table(spark, folder, "cameras"))


def p5_estimated(spark: SparkSession, folder: str) -> DataFrame:
    """What p5_found leaves open and an estimated zone settles."""
    feed, cameras = table(spark, folder, "asset_feed"), table(spark, folder, "cameras")
    return estimated_instants(read_stamps(feed, cameras), estimate_zones(feed, cameras))


def _sessions(spark: SparkSession, folder: str, hours: float) -> DataFrame:
    stamps = read_stamps(table(spark, folder, "asset_feed"), table(spark, folder, "cameras"))
    found = GapTree(photo_times(stamps)).sessions(int(hours * HOUR_US))
    return found.select(F.col("entity").alias("camera_id"), "start_us", "end_us", F.col("n").alias("n_photos"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder, 4)


def p7_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions under pauses of half an hour, four hours and a day, from one tree."""
    stamps = read_stamps(table(spark, folder, "asset_feed"), table(spark, folder, "cameras"))
    runs = GapTree.runs(GapTree(photo_times(stamps)).built(), [HOUR_US // 2, 4 * HOUR_US, 24 * HOUR_US])
    return runs.groupBy((F.col("gap_setting_us") / HOUR_US).alias("gap_hours")).agg(F.count("*").alias("sessions"), F.sum("n").alias("photos"), F.max("n").alias("largest"), F.max(F.col("end_us") - F.col("start_us")).alias("longest_us"))


QUERIES = {"p5_found": p5_found, "p5_zones": p5_zones, "p5_estimated": p5_estimated, "p7_found": p7_found, "p7_gaps": p7_gaps}
ORACLES: dict[str, str] = {}

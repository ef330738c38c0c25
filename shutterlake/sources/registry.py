"""Sources by name, and settings from JSON and YAML files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.sources.replay import catalogue, image_files
from shutterlake.sources.tables import table

SOURCES: dict[str, Callable] = {
    "local": lambda spark, folder, **options: image_files(spark, folder, **options),
    "lightroom": lambda spark, folder, **options: catalogue(spark, folder, **options),
}


def load_source(spark: SparkSession, name: str, folder: str, refresh: bool = True, **options) -> DataFrame:
    """Rows of a source by name; without ``refresh`` the remote one comes from the records already stored."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(sorted(SOURCES))}")
    if name == "lightroom" and not refresh:
        return table(spark, folder, "photos").where(F.col("source").isin("lightroom", "both"))
    return SOURCES[name](spark, folder, **options)


def albums(spark: SparkSession, folder: str) -> DataFrame:
    """Albums of a replayed catalogue without the sets that only hold albums."""
    return catalogue(spark, folder).where("coalesce(subtype, '') <> 'collection_set'")


def json_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON settings file under an explicit schema; a missing or broken file gives no row."""
    try:
        return spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache().where("_corrupt IS NULL").drop("_corrupt")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def yaml_overrides(text: str, known: set[str]) -> dict[str, float]:
    """Numbers of the known keys from a flat YAML text; comments, other keys and values that are no number are left out."""
    out = {}
    for line in text.splitlines():
        key, sep, value = line.split("#", 1)[0].partition(":")
        if sep and key.strip() in known:
            try:
                out[key.strip()] = float(value.strip())
            except ValueError:
                pass
    return out

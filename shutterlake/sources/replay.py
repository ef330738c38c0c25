"""Sources other than Parquet: files with content digests, and JSON-lines replays of a paged catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = ("jpg", "jpeg", "png", "tiff", "tif", "webp")


def image_files(spark: SparkSession, folder: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """(hash, path, source, bytes) of the images below ``folder``, in order of path; a sample is drawn by hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))
    rows = files.select(F.sha2("content", 256).alias("hash"), "path", F.lit("local").alias("source"), F.col("length").alias("bytes"))
    return rows.orderBy("path") if sample is None else rows.orderBy(F.xxhash64("path", F.lit(seed))).limit(sample)


class _Page(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.after = options["folder"], options.get("captured_after")

    def partitions(self):
        import glob

        return [_Page(p) for p in sorted(glob.glob(f"{self.folder}/*.json"))] or [_Page("")]

    def read(self, partition):
        import json
        import re

        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as f:
            # a guard that some services put before their JSON
            page = json.loads(re.sub(r"^\s*while\s*\(1\)\s*\{\}\s*", "", f.read()))
        for r in page.get("resources", []):
            p = r.get("payload") or {}
            captured = p.get("captureDate")
            if self.after and (captured or "") < self.after:
                continue
            yield (r.get("id"), r.get("subtype"), captured, r.get("updated"), json.dumps(p, sort_keys=True))


class Catalogue(DataSource):
    """``spark.read.format("catalogue")``: pages of a remote catalogue saved as JSON files; ``captured_after`` is pushed down to the reader."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "id string, subtype string, captured string, updated string, payload string"

    def reader(self, schema):
        return CatalogueReader(self.options)


def catalogue(spark: SparkSession, folder: str, captured_after: str | None = None) -> DataFrame:
    spark.dataSource.register(Catalogue)
    reader = spark.read.format("catalogue").option("folder", folder)
    return (reader.option("captured_after", captured_after) if captured_after else reader).load()

"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    # one thread of linear algebra per task: eight tasks of eight threads each would only get in each other's way
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shutterlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folder per application that had none set and runs on one machine.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the checkpoint directory the context was given.

    A session of local threads (tests) without either gets a temporary folder; on a cluster a missing setting is an error,
    as a folder of one machine would not be seen by the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = folder = tempfile.mkdtemp(prefix="shutterlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it from there.

    Not by a checkpoint: that keeps the optimiser's estimate of the plan behind it, which every join multiplies, so that in a
    loop its digits double with each round until the driver can't hold it. A table has the size of its files.
    """
    return materialise(df, "cut")[0]


def materialise(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it; ``drop`` removes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # with the schema given, no job has to look for it
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``materialise``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

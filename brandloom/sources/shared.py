"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: Spark's setting by which an execution's shuffle files go when it ends; else they stay until the driver collects its garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """Within it, what is executed leaves no shuffle files behind."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES_GO, before) if before is not None else spark.conf.unset(_SHUFFLES_GO)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all cores, by keys if there are any: for rows that cost far more than their bytes say."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, a lost executor costs no recomputation, and its shuffles' files are gone.

    The table goes with drop_stored, or when the Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """The path of a folder in the shared folder, not yet made, that goes when the Python process ends."""
    path = f"{shared_dir(spark)}/brandloom-{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def kept(spark: SparkSession, name: str, make) -> DataFrame:
    """The table of that name in the shared folder; if it isn't there, make() is written beside it and renamed, so that readers find it whole or not at all.

    It stays. A name should hold a digest of what the table follows from.
    """
    path = f"{shared_dir(spark)}/brandloom-{name}"
    system, place = file_system(spark, path)
    if not system.exists(place):
        new = f"{shared_dir(spark)}/_brandloom-{name}-{uuid.uuid4().hex}"
        with shuffles_go(spark):
            make().write.parquet(new)
        # Where another session has been faster, the rename fails, or puts this one under its hidden name into that table.
        if system.exists(place) or not system.rename(file_system(spark, new)[1], place):
            _delete(spark, new)
    return spark.read.parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    system, place = file_system(spark, path)
    system.delete(place, True)


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables that stored has made, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path in _written:
            _delete(_written.pop(path), path)


def _sweep() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; what is left belongs to the folder's owner
            return


atexit.register(_sweep)

"""Incremental runs: the upsert as a sink, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import first_of_each, upsert
from ..sources.shared import file_system


def read_stream(spark: SparkSession, folder: str, schema, most_files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n and total of each window and kind; works on batches and, with a watermark, on streams."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key by time; on a stream, the first that arrives within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else first_of_each(events, keys, [F.col(time), F.to_json(F.struct(*sorted(events.columns)))])


def _parts(spark: SparkSession, path: str, before: str) -> dict[int, list[str]]:
    """bucket -> its folders below path, oldest first, of finished versions before a version."""
    system, place = file_system(spark, path)
    found: dict[int, list[str]] = {}
    if not system.exists(place):
        return found
    for name in sorted(s.getPath().getName() for s in system.listStatus(place)):
        if name.startswith("v") and name < before and system.exists(file_system(spark, f"{path}/{name}/_SUCCESS")[1]):
            for s in system.listStatus(file_system(spark, f"{path}/{name}")[1]):
                if s.getPath().getName().startswith("bucket="):
                    found.setdefault(int(s.getPath().getName()[7:]), []).append(f"{path}/{name}/{s.getPath().getName()}")
    return found


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table as the finished versions below path make it: of each bucket the newest."""
    return spark.read.parquet(*[folders[-1] for folders in _parts(spark, path, "w").values()])


def upsert_sink(path: str, keys: list[str], order: Callable[[], list[Column]], buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: puts each batch into a table below path, dealt to buckets by key.

    A batch writes the buckets that it touches, as a new version; the others stay where they are. What is there is read
    from the folder, so that a restarted stream goes on where the last one stopped, and a batch that is run again writes
    its version again. Of each bucket the last `keep` folders stay.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark, version = batch.sparkSession, f"v{epoch:010d}"
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets`
        if not touched:
            return
        there = _parts(spark, path, version)
        old = [there[b][-1] for b in touched if b in there]
        existing = spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
        upsert(existing, batch, keys, order()).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{version}")
        for b in touched:
            for folder in there.get(b, [])[: -keep + 1 or None]:
                system, place = file_system(spark, folder)
                system.delete(place, True)

    return run

"""Identity resolution over a stream of accounts: what earlier batches have opened is kept, and given to the next.

Accounts arrive in their order, cut into batches anywhere. Each batch is resolved against the anchors (slugs and domains)
of all batches before it, which is what one run over everything gives. Both tables below the path, `links` and `known`,
have a folder a batch: a batch that is run again reads the batches before it only, and writes its own folders anew, so that a
restarted stream goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import resolve_known
from ..sources.shared import drop_stored, file_system, shuffles_go, stored

KNOWN = "kind string, name string, identity_id string"


def read_known(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The anchors opened so far, or before a batch."""
    system, place = file_system(spark, f"{path}/known")
    if not system.exists(place):
        return spark.createDataFrame([], KNOWN)
    rows = spark.read.schema(f"{KNOWN}, batch long").parquet(f"{path}/known")
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/links").drop("batch")


def identity_sink(path: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: resolves accounts (slug, domain and a long column that orders them) into tables below path."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = read_known(spark, path, epoch)
        rows = stored(batch, "batch")
        found, opened = resolve_known(rows, order, known)
        with shuffles_go(spark):
            opened.write.mode("overwrite").parquet(f"{path}/known/batch={epoch}")
            found.write.mode("overwrite").parquet(f"{path}/links/batch={epoch}")
        drop_stored(rows)

    return run

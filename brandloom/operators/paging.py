"""Pages of an ordered table without a sort for each: the table is stored once in ranges of its order, with their counts.

A page begins in the range that the counts say, so that it reads one range, or two where it lies across a border, and sorts
these alone. `ranking.page_of` sorts the whole table, which is right for a table that is asked for one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shuffles_go


def store_ranges(df: DataFrame, order: list[Column], path: str, ranges: int) -> None:
    """df below path in so many ranges of its order, which should leave no ties."""
    dealt = df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    with shuffles_go(df.sparkSession):
        dealt.write.partitionBy("range").parquet(f"{path}/rows")
        df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")


def page_of_ranges(spark: SparkSession, path: str, order: list[Column], page: int, size: int = 12) -> DataFrame:
    """A page (from 1), as page_of gives it."""
    low, high = (page - 1) * size, page * size
    rows, upto, first, chosen = spark.read.parquet(f"{path}/rows"), 0, 0, []
    for r in sorted(spark.read.parquet(f"{path}/counts").collect(), key=lambda r: r["range"]):  # a row a range
        if upto < high and upto + r["n"] > low:
            first = first if chosen else upto
            chosen.append(r["range"])
        upto += r["n"]
    return rows.where(F.col("range").isin(chosen)).drop("range").orderBy(*order).offset(max(0, low - first)).limit(size)

"""Tables by folder and name, seed files, and their sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert
from . import snapshots

SEED = (
    "id string, name string, niche string, platforms array<string>, audience_types array<string>, content_style string, products_sold array<string>, sample_links array<string>, estimated_engagement double, "
    "metrics struct<top_topics:array<string>,post_frequency_per_week:int,content_formats:array<string>,platform_metrics:map<string,struct<followers:double,avg_views:double,engagement_rate:double>>>"
)
#: Seed targets by their names.
TARGETS = {"real": "creators", "creators": "creators", "synthetic": "synthetic_creators", "synthetic_creators": "synthetic_creators"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(spark: SparkSession, statement: str, **values) -> DataFrame:
    """SQL with named parameters (:name), which are never pasted into the text."""
    return spark.sql(statement, args=values)


def _objects(text: str):
    """The objects that JSON text holds, each as JSON, out of arrays however deep; none if it doesn't parse. A file is one row, and its depth is open, so Python walks it."""

    def walk(value):
        try:
            left, out = [json.loads(value or "null")], []
        except ValueError:
            return []
        while left:
            x = left.pop()
            if isinstance(x, list):
                left += reversed(x)
            elif isinstance(x, dict):
                out.append(json.dumps(x))
        return out

    return F.udf(walk, "array<string>", useArrow=True)(text)


def seeds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Creators of JSON files, in which arrays may nest to any depth; rows without id, name or niche go, and of equal ids the first file's first counts."""
    text = spark.read.text(paths, wholetext=True).select("value", "_metadata.file_path")
    bare = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"  # a scheme may be followed by one slash or three
    position = F.array_position(F.lit([re.sub(bare, "/", p) for p in paths]), F.regexp_replace("file_path", bare, "/"))
    one = F.from_json("r", SEED)
    rows = text.select(F.coalesce(position, F.lit(0)).alias("file"), F.posexplode(_objects("value")).alias("place", "r")).select("file", "place", one.alias("r"))
    rows = rows.select("file", "place", "r.*").where("id IS NOT NULL AND name IS NOT NULL AND niche IS NOT NULL")
    first = rows.groupBy("id").agg(F.min(F.struct("file", "place")).alias("f"))
    return rows.join(first, "id").where((F.col("file") == F.col("f.file")) & (F.col("place") == F.col("f.place"))).drop("file", "place", "f")


def target_table(target: str | None) -> str:
    """The table that a seed target names; synthetic creators without one."""
    name = (target or "synthetic").strip().lower()
    if name not in TARGETS:
        raise ValueError(f"seed target {target!r}: one of {', '.join(TARGETS)}")
    return TARGETS[name]


def seed_sink(spark: SparkSession, root: str, rows: DataFrame, target: str | None = None) -> str:
    """Puts seed rows into their target's table below root, by id, and gives its name. Readers (snapshots.read) see the old table or the new."""
    name = target_table(target)
    existing = snapshots.read(spark, root, name)
    snapshots.publish(spark, root, {name: upsert(rows.limit(0) if existing is None else existing, rows, ["id"])})
    return name


def invented_creators(spark: SparkSession, n: int = 200, seed: int = 1337) -> DataFrame:
    """Made-up creators; a row depends on seed and number alone. Earlier niches are met more often: the k-th of n weighs n - k."""
    number = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m))
    niches = ("fitness coaching", "personal finance", "beauty & skincare", "ecommerce & marketing", "ai productivity", "real estate investing", "business coaching", "wellness & nutrition", "life coaching", "study productivity")
    rows = spark.range(n)
    return rows.select(
        F.concat(F.lit("syn_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.concat(F.lit("Creator "), F.col("id")).alias("name"), F.element_at(F.lit([x for k, x in enumerate(niches) for _ in range(len(niches) - k)]), (number("niche", len(niches) * (len(niches) + 1) // 2) + 1).cast("int")).alias("niche"),
        F.slice(F.lit(["instagram", "tiktok", "youtube", "x", "linkedin"]), (number("first", 4) + 1).cast("int"), (number("count", 2) + 1).cast("int")).alias("platforms"), (number("followers", 500_000) + 1000).alias("followers"), ((number("rate", 90) + 10) / 1000.0).alias("estimated_engagement"),
    )


def write(df: DataFrame, folder: str, name: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{folder}/{name}.parquet")

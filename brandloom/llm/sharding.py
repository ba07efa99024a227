"""Sharding by longest-processing-time scheduling.

Groups of rows that must stay together (equal texts) are sorted by size, and each goes to the least-loaded shard, taken
from a heap. The schedule is made on the driver over a bounded list of units: every group above 1/HEAVY of a shard's
mean load is a unit of its own (at most shards * HEAVY of them), and the smaller groups are gathered by their hash into
bundles of three sizes (BUNDLES), of which the smallest fill the last gaps. So the driver's work does not grow with the
rows, and a group is never divided. A group larger than a shard's mean load gets a shard to itself as far as possible;
the other shards then share the rest evenly.

Law: "bytes". Slots number the rows of a shard from 0 without gaps: rows are counted by (shard, cell), cells being hash
classes of the rows, the counts are summed to offsets, and each cell is numbered on its own, so that a shard that holds
a large part of all rows is numbered by many tasks.

Edge cases: a null text has size 16 and crc 0 and stays with the empty texts. Repeated rows each get a slot. Null ids
are ordinary rows. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OVERHEAD = 16
HEAVY = 64
#: Bundles a shard by size class; a class gets as many 21sts of the hash space as its weight.
BUNDLES = ((64, 16), (64, 4), (64, 1))
ROWS_A_CELL = 640
CELLS = (64, 65_536)


def schedule(sizes: dict, shards: int) -> dict:
    """Longest processing time first: unit -> shard. Ties go by the unit's key, then the lowest shard."""
    loads = [(0, shard) for shard in range(shards)]
    out = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        out[unit] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def _bundle(group: F.Column, shards: int) -> F.Column:
    """The bundle of a group: two independent hashes choose the size class and the bundle in it."""
    share = F.pmod(F.xxhash64(group, F.lit("class")), F.lit(sum(w for _, w in BUNDLES)))
    place = F.xxhash64(group, F.lit("bundle"))
    out, below, first = None, 0, 0
    for count, weight in BUNDLES:
        below += weight
        number = (F.pmod(place, F.lit(count * shards)) + first).cast("int")
        out = F.when(share < below, number) if out is None else out.when(share < below, number)
        first += count * shards
    return out


def assign(rows: DataFrame, shards: int, size_col="size", group_col="grp") -> DataFrame:
    """rows (a stored table) with a column shard. Rows of equal group_col stay together."""
    spark = rows.sparkSession
    groups = stored(rows.groupBy(group_col).agg(F.sum(size_col).alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = {r[0]: r[1] for r in groups.where(F.col("bytes") * (shards * HEAVY) > F.lit(total)).collect()}
    light = groups.where(F.col("bytes") * (shards * HEAVY) <= F.lit(total))
    bundles = {r[0]: r[1] for r in light.groupBy(_bundle(F.col(group_col), shards).alias("bundle")).agg(F.sum("bytes")).collect()}
    placed = schedule({("g", k): v for k, v in heavy.items()} | {("b", f"{k:09d}"): v for k, v in bundles.items()}, shards)
    n = sum(c * shards for c, _ in BUNDLES)
    by_bundle = F.lit([placed.get(("b", f"{i:09d}"), 0) for i in range(n)])
    alone = spark.createDataFrame([(k, placed["g", k]) for k in heavy], f"__group {rows.schema[group_col].dataType.simpleString()}, __shard int")
    return (
        rows.join(F.broadcast(alone), F.col(group_col) == F.col("__group"), "left")  # at most shards * HEAVY rows
        .withColumn("shard", F.coalesce("__shard", F.get(by_bundle, _bundle(F.col(group_col), shards))).cast("int"))
        .drop("__group", "__shard")
    )


def number(rows: DataFrame, cells: int, order: list[str]) -> DataFrame:
    """rows (with a column shard) with a column slot: 0, 1, ... in each shard."""
    celled = stored(rows.withColumn("cell", F.pmod(F.xxhash64(*order, F.lit("cell")), F.lit(cells)).cast("int")), "cells")
    counts = celled.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = celled.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order)))
    return ranked.join(offsets, ["shard", "cell"]).withColumn("slot", (F.col("offset") + F.col("__rank") - 1).cast("long")).drop("cell", "offset", "__rank")


def shard_documents(docs: DataFrame, shards: int = 40, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"), F.md5(text).alias("grp"),
    )
    rows = stored(rows, "sizes")
    cells = max(CELLS[0], min(CELLS[1], rows.count() // ROWS_A_CELL))
    placed = number(assign(rows, shards), cells, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

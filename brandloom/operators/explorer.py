"""Explorer: groups of niches, search, prices, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import round_half_up
from ..functions.text import phrase
from ..plans import rules


def niche_group(niche: Column) -> Column:
    """The first group that has a label equal to the niche, inside it, or around it."""
    n, out = phrase(F.coalesce(niche, F.lit(""))), None
    out = F.when(n == "", rules.NICHE_GROUPS[0][0])
    for group, labels in rules.NICHE_GROUPS:
        held = F.lit(False)
        for label in labels:
            held = held | F.contains(n, F.lit(label)) | F.contains(F.lit(label), n)
        out = out.when(held, group)
    return out.otherwise("Business")


def zero_filled(df: DataFrame, column: str, domain: list[str], count: str = "n") -> DataFrame:
    """How many rows have each value of the domain, zeros included."""
    spark = df.sparkSession
    every = spark.range(1).select(F.posexplode(F.lit(domain)).alias("position", column))
    counts = df.where(F.col(column).isin(domain)).groupBy(column).agg(F.count("*").alias(count))
    return every.join(counts, column, "left").select("position", column, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def price(niche: Column, views: Column) -> Column:
    """Estimated price of a video; null without views."""
    low, cpm = F.lower(F.coalesce(niche, F.lit(""))), None
    for words, rate in rules.CPM:
        held = F.regexp_like(low, F.lit(words))
        cpm = F.when(held, F.lit(float(rate))) if cpm is None else cpm.when(held, F.lit(float(rate)))
    return F.when(views > 0, round_half_up(views / 1000 * cpm.otherwise(float(rules.CPM_OTHERWISE))).cast("long"))


def within_budget(price_col: Column, budget: float) -> Column:
    return F.coalesce(price_col <= budget * 1.1, F.lit(False))


def matches_search(term: str, *columns: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term.strip().lower()))


def search(df: DataFrame, platform: str = "all", group: str = "all", term: str = "", platforms: str = "platforms", niche: str = "niche", blob: tuple[str, ...] = ()) -> DataFrame:
    """Creators on a platform, in a niche group, whose blob columns (strings or arrays) hold the term; "all" and "" ask for nothing."""
    out = df
    if platform != "all":
        out = out.where(F.array_contains(platforms, platform))
    if group != "all":
        out = out.where(niche_group(F.col(niche)) == group)
    return out.where(matches_search(term, *map(F.col, blob))) if term.strip() else out


def positive_total(values: Column) -> Column:
    return F.aggregate(F.filter(values, lambda v: v > 0), F.lit(0.0), lambda s, v: s + v)


def positive_mean(values: Column) -> Column:
    """Rounded mean of the positive values, null if there are none."""
    kept = F.filter(values, lambda v: v > 0)
    return F.when(F.size(kept) > 0, round_half_up(F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(kept)))


def coverage(df: DataFrame, platform: str, slug: Column) -> DataFrame:
    """One row: total, with_slug, pct, and a count for each platform of the domain."""
    each = [F.count_if(F.lower(F.coalesce(F.col(platform), F.lit("unknown"))) == p).alias(f"n_{p}") for p in rules.PLATFORMS]
    counted = df.agg(F.count("*").alias("total"), F.count_if(slug.isNotNull()).alias("with_slug"), *each)
    return counted.withColumn("pct", F.when(F.col("total") > 0, round_half_up(100 * F.col("with_slug") / F.col("total"), 2)).otherwise(0.0))

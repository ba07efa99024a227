"""Social performance from priors, and what is derived from platform metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import clamp, round_half_up
from ..functions.urls import normal_platform
from ..plans.rules import ENGAGEMENT, VIEW_RATE


def prior(table: dict[str, float], platform: Column) -> Column:
    out = None
    for name, value in table.items():
        held = platform == name
        out = F.when(held, F.lit(value)) if out is None else out.when(held, F.lit(value))
    return out.otherwise(F.lit(table["unknown"]))


def group_signals(accounts: DataFrame, keys: list[str], platform: str, followers: str) -> DataFrame:
    """followers (largest) and signal_count of each key and normal platform."""
    name = F.coalesce(normal_platform(F.lower(F.coalesce(F.col(platform), F.lit("unknown"))), "unknown"), F.lit("unknown"))
    return accounts.groupBy(*keys, name.alias("platform")).agg(F.max(followers).alias("followers"), F.count("*").alias("signal_count"))


def social_signal(platform: Column, followers: Column, signals: Column, outbound: Column) -> Column:
    """Struct of followers, avg_views, engagement_rate, sample_size, quality and confidence."""
    views, rate = prior(VIEW_RATE, platform), prior(ENGAGEMENT, platform)
    has = F.coalesce(followers > 0, F.lit(False))
    n = F.greatest(F.lit(0), signals)
    avg_views = F.when(has, F.greatest(F.lit(1.0), round_half_up(followers * views * F.least(F.lit(1.3), 0.9 + n * 0.08))))
    engagement = clamp(rate + F.least(F.lit(0.02), F.greatest(F.lit(0), n - 1) * 0.003) + F.when(outbound, 0.002).otherwise(0.0), 0.008, 0.2)
    yes = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    sure = 0.24 + yes(platform != "unknown", 0.1) + yes(has, 0.34) + yes(n >= 2, 0.14) + yes(n >= 4, 0.06) + yes(outbound, 0.12) + yes(has, 0.1)
    quality = F.when(has & (n >= 2), "estimated_multi_signal").when(has, "estimated_single_signal").when(outbound, "platform_presence_only").otherwise("sparse")
    return F.struct(
        F.when(has, round_half_up(followers).cast("long")).alias("followers"), avg_views.cast("long").alias("avg_views"), round_half_up(engagement, 4).alias("engagement_rate"),
        F.greatest(n, F.when(outbound, 1).otherwise(0)).cast("long").alias("sample_size"), quality.alias("quality"), clamp(round_half_up(sure, 3), 0.2, 0.95).alias("confidence"),
    )


def enough_followers(followers: Column, least: int) -> Column:
    """False for a known count below least; unknown and zero counts pass."""
    return ~F.coalesce((F.lit(least) > 0) & (followers > 0) & (followers < least), F.lit(False))


def weighted_rate(df: DataFrame, keys: list[str], rate: str, followers: str, confidence: str, variant: str) -> DataFrame:
    """engagement of each key: rates weighted by confidence and reach; variant "enrich" or "import"."""
    c, f = F.col(confidence), F.col(followers)
    weight = {
        "enrich": F.greatest(F.lit(0.2), c) * F.when(f.isNotNull(), F.log10(f + 10)).otherwise(1.0),
        "import": F.greatest(F.lit(0.2), F.coalesce(c, F.lit(0.4))) * F.greatest(F.lit(1.0), F.log10(F.coalesce(f, F.lit(1)) + 10)),
    }[variant]
    rows = df.where(F.col(rate).isNotNull())
    return rows.groupBy(*keys).agg(round_half_up(F.sum(F.col(rate) * weight) / F.sum(weight), 4).alias("engagement"))


def primary_score(views: Column, followers: Column, confidence: Column) -> Column:
    part = lambda x: F.log10(F.greatest(F.lit(1.0), F.coalesce(x, F.lit(0)) + 1))
    return part(views) * 0.5 + part(followers) * 0.35 + F.coalesce(confidence, F.lit(0.4)) * 0.15


def primary_platform(df: DataFrame, keys: list[str], platform: str, score: Column) -> DataFrame:
    """The platform with the highest score; of equals the first by name."""
    return df.withColumn("__s", round_half_up(score, 9)).groupBy(*keys).agg(F.min(F.struct((-F.col("__s")).alias("s"), F.col(platform).alias("p"))).alias("b")).select(*keys, F.col("b.p").alias("primary_platform"))


def merged_metrics(old: Column, new: Column) -> Column:
    """Maps by platform; new wins, unknown stays out."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), F.map_filter(new, lambda k, _: k != "unknown"))

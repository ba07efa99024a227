"""Social enrichment: each identity's platforms from its accounts and links, what is skipped and why, and the sync to creators.

Store enrichment: each identity's store page, read if its fetch has given one; a failed fetch fails its identity alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import distinct_texts, round_half_up
from ..functions.urls import host, normal_platform
from .crawl import store_pages
from .social import enough_followers, merged_metrics, social_signal, weighted_rate

NO_SIGNALS = "no social account signals found"
ALL_LOW = "all signals filtered by minFollowerEstimate"
TOO_FEW = "insufficient social signals after filtering"
NO_SLUG = "identity missing canonical_stan_slug"


def candidates(identities: DataFrame, accounts: DataFrame) -> DataFrame:
    """identity_id, platform, followers, signal_count and outbound for each platform of an identity's accounts or outbound links.

    accounts: identity_id, platform, followers, signal_count. identities: identity_id, outbound (URLs).
    """
    name = F.coalesce(normal_platform("platform", "unknown"), F.lit("unknown"))
    held = accounts.groupBy("identity_id", name.alias("platform")).agg(F.max("followers").alias("followers"), F.sum(F.greatest(F.lit(0), F.coalesce("signal_count", F.lit(0)))).alias("signal_count"))
    linked = identities.select("identity_id", F.explode("outbound").alias("url")).select("identity_id", normal_platform(host("url"), "unknown").alias("platform")).where("platform is not null").distinct().withColumn("outbound", F.lit(True))
    return held.join(linked, ["identity_id", "platform"], "full").select("identity_id", "platform", "followers", F.coalesce("signal_count", F.lit(0)).cast("long").alias("signal_count"), F.coalesce("outbound", F.lit(False)).alias("outbound"))


def signals(found: DataFrame, min_followers: int = 0) -> DataFrame:
    """The candidates that count, with the struct signal."""
    kept = found.where(enough_followers(F.col("followers"), min_followers) & ((F.col("signal_count") > 0) | F.col("outbound")))
    return kept.withColumn("signal", social_signal(F.col("platform"), F.col("followers"), F.col("signal_count"), F.col("outbound")))


def results(identities: DataFrame, found: DataFrame, min_followers: int = 0) -> DataFrame:
    """identity_id, status (enriched, updated, skipped, failed), reason and platforms of each identity (has_social: it had signals before)."""
    low = ~enough_followers(F.col("followers"), min_followers)
    counted = found.groupBy("identity_id").agg(F.count("*").alias("n"), F.count_if(low).alias("n_low"), F.count_if(~low & ((F.col("signal_count") > 0) | F.col("outbound"))).alias("platforms"))
    rows = identities.select("identity_id", "has_social").join(counted, "identity_id", "left")
    reason = F.when(F.col("identity_id").isNull(), "no identity").when(F.col("n").isNull(), NO_SIGNALS).when(F.col("platforms") == 0, F.when(F.col("n_low") > 0, ALL_LOW).otherwise(TOO_FEW))
    status = F.when(F.col("identity_id").isNull(), "failed").when(F.col("reason").isNotNull(), "skipped").when(F.col("has_social"), "updated").otherwise("enriched")
    return rows.withColumn("reason", reason).withColumn("status", status).select("identity_id", "status", "reason", F.coalesce("platforms", F.lit(0)).cast("long").alias("platforms"))


def stats(rows: DataFrame) -> DataFrame:
    """One row: selected, processed, enriched, updated, skipped_no_signals, skipped_low_followers and failed."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    status, reason = F.col("status"), F.col("reason")
    return rows.agg(
        F.count("*").alias("selected"), F.count("*").alias("processed"), n(status == "enriched", "enriched"), n(status == "updated", "updated"),
        n(reason == NO_SIGNALS, "skipped_no_signals"), n(reason.isin(ALL_LOW, TOO_FEW), "skipped_low_followers"), n(status == "failed", "failed"),
    )


def sync(creators: DataFrame, kept: DataFrame) -> DataFrame:
    """creators (identity_id, platforms, metrics) with the signals' platforms and metrics put in, engagement, avg_confidence and n_signals.

    New metrics win over old ones; platforms are named the normal way; "unknown" stays out of both.
    """
    flat = kept.select("identity_id", "platform", "signal.*")
    metric = F.struct(F.col("followers").cast("double").alias("followers"), F.col("avg_views").cast("double").alias("avg_views"), "engagement_rate", "confidence", F.col("sample_size").cast("double").alias("sample_size"))
    each = flat.groupBy("identity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("platform").alias("key"), metric.alias("value"))))).alias("__new"),
        round_half_up(F.avg("confidence"), 4).alias("avg_confidence"), F.count("*").alias("n_signals"),
    )
    rate = weighted_rate(flat, ["identity_id"], "engagement_rate", "followers", "confidence", "enrich")
    out = creators.join(each, "identity_id").join(rate, "identity_id")
    old = F.filter(F.transform("platforms", lambda p: normal_platform(p)), lambda p: p.isNotNull())
    named = F.filter(F.array_sort(F.map_keys("__new")), lambda p: p != "unknown")
    return out.withColumns({"platforms": distinct_texts(F.concat(old, named)), "metrics": merged_metrics(F.coalesce("metrics", F.col("__new")), F.col("__new"))}).drop("__new")


def plain_slug(slug: Column) -> Column:
    """Trimmed, lower-cased, without slashes around; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(slug)), "^/+|/+$", ""), F.lit(""))


def store_results(identities: DataFrame, fetched: DataFrame) -> DataFrame:
    """identity_id, slug, status (enriched, skipped, failed), reason, and what store_pages reads of an enriched identity's page.

    identities: identity_id and slug. fetched: slug (plain, each once), url, html and error of the fetches; without one, or
    without a page, an identity has failed.
    """
    rows = identities.select("identity_id", plain_slug(F.col("slug")).alias("slug"))
    pages = store_pages(fetched.where("error is null and html is not null")).drop("html", "error", "offers")
    tried = rows.join(fetched.select("slug", F.col("error").alias("__error")), "slug", "left").join(pages.withColumn("__read", F.lit(True)), "slug", "left")
    status = F.when(F.col("slug").isNull(), "skipped").when(F.col("__read"), "enriched").otherwise("failed")
    reason = F.when(F.col("slug").isNull(), NO_SLUG).when(F.col("__read").isNull(), F.coalesce("__error", F.lit("unknown error")))
    return tried.withColumns({"status": status, "reason": reason}).drop("__error", "__read")


def store_stats(rows: DataFrame) -> DataFrame:
    """One row: selected, processed, succeeded, failed and skipped_no_slug."""
    n = lambda status, name: F.count_if(F.col("status") == status).alias(name)
    return rows.agg(F.count("*").alias("selected"), F.count("*").alias("processed"), n("enriched", "succeeded"), n("failed", "failed"), n("skipped", "skipped_no_slug"))

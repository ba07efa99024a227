"""Import of identities as creators: rule signals over text, and aggregates over linked accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import clamp, distinct_texts, finite, round_half_up
from ..functions.text import keywords_in, let, strings, title_case
from ..functions.urls import normal_platform
from ..plans import rules
from .social import primary_score


#: All keywords of the rules, each once.
KEYWORDS = list(dict.fromkeys(k for table in (rules.NICHES, rules.TOPICS, rules.AUDIENCES, rules.PRODUCTS, rules.INTENTS) for row in table for k in row[1]))


def found_keywords(text: Column) -> Column:
    """The rules' keywords in a text (lower-cased)."""
    return keywords_in(text, KEYWORDS)


def niche_of(found: Column, table=rules.NICHES) -> Column:
    """Struct of niche, score, topics and audiences: the rule with the largest share of its keywords found; of equals the first."""
    share = lambda words: F.size(F.array_intersect(found, strings(*words))) / len(words)
    rated = F.array_max(F.array(*[F.struct(share(words).alias("score"), F.lit(-i).alias("i")) for i, (_, words, _, _) in enumerate(table)]))
    default = next(i for i, r in enumerate(table) if r[0] == rules.DEFAULT_NICHE)

    def named(best):
        at = F.when(best["score"] > 0, -best["i"]).otherwise(default) + 1
        pick = lambda k: F.element_at(F.array(*[strings(*r[k]) for r in table]), at)
        return F.struct(F.element_at(strings(*[r[0] for r in table]), at).alias("niche"), best["score"].alias("score"), pick(2).alias("topics"), pick(3).alias("audiences"))

    return let(rated, named)


def signals(found: Column, table) -> Column:
    """The values whose rules have a keyword found, in order."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(found, strings(*words)), F.lit(value)) for value, words in table]))


def _by_value(value: Column, table: dict[str, str]) -> Column:
    """The table's entry for a value, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def selling_style(cta: Column, intents: Column) -> Column:
    out = F.when(cta.isin(*rules.STYLE_OF_CTA), _by_value(cta, rules.STYLE_OF_CTA))
    for intent, style in rules.STYLE_OF_INTENT:
        out = out.when(F.array_contains(intents, intent), style)
    return out.otherwise(rules.STYLE_OTHERWISE)


def content_style(style: Column, topics: Column) -> Column:
    told = _by_value(style, rules.CONTENT_OF_STYLE)
    return F.coalesce(told, F.when(F.array_contains(topics, rules.CONTENT_OF_TOPIC[0]), rules.CONTENT_OF_TOPIC[1]).otherwise(rules.CONTENT_OTHERWISE))


def compatibility(df: DataFrame, text: str, cta: str, has_price: Column | None = None, has_social: Column | None = None, has_primary: Column | None = None) -> DataFrame:
    """df with niche, niche_confidence, topics, audiences, products, intents, selling_style, content_style and buying_intent, read from text.

    has_price, has_social, has_primary: whether prices, platform metrics and a primary platform are known besides.
    """
    price, social, primary = (F.lit(False) if x is None else F.coalesce(x, F.lit(False)) for x in (has_price, has_social, has_primary))
    t = F.col("__f")
    out = df.withColumn("__t", F.lower(F.coalesce(text, F.lit("")))).withColumn("__f", found_keywords(F.col("__t"))).withColumns({
        "__n": niche_of(t), "__topics": signals(t, rules.TOPICS), "__aud": signals(t, rules.AUDIENCES), "products": signals(t, rules.PRODUCTS), "intents": signals(t, rules.INTENTS),
    })
    has = lambda v: F.array_contains("intents", v)
    yes = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    out = out.withColumns({
        "niche": F.col("__n.niche"), "niche_confidence": round_half_up(clamp(0.35 + F.col("__n.score") * 1.3, 0.25, 0.98), 3),
        "topics": F.slice(distinct_texts(F.concat("__n.topics", "__topics", "products", F.transform("intents", lambda i: F.replace(i, F.lit("_"), F.lit(" "))))), 1, 12),
        "audiences": F.slice(distinct_texts(F.concat("__n.audiences", "__aud")), 1, 8), "selling_style": selling_style(F.col(cta), F.col("intents")),
    })
    n = F.size("products")
    bought = 0.3 + yes(price, 0.15) + yes(n >= 1, 0.1) + yes(n >= 3, 0.06) + yes(has("direct_purchase"), 0.14) + yes(has("lead_generation"), 0.1) + yes(has("affiliate"), 0.08)
    bought = bought + yes(F.col("selling_style").isin("direct_response", "consultative"), 0.08) + yes(social, 0.07) + yes(primary, 0.04)
    return out.withColumns({"content_style": content_style(F.col("selling_style"), F.col("__topics")), "buying_intent": round_half_up(clamp(bought, 0.1, 0.98), 3)}).drop("__t", "__f", "__n", "__topics", "__aud")


def profile_confidence(store: Column, social: Column, niche: Column, topics: Column, audiences: Column, products: Column, has_social: Column) -> Column:
    share = lambda n, most: F.least(F.lit(1.0), n / most)
    c = 0.26 + 0.23 * clamp(F.coalesce(store, F.lit(0.4))) + 0.2 * clamp(F.coalesce(social, F.lit(0.4))) + 0.12 * niche + 0.07 * share(topics, 8) + 0.05 * share(audiences, 5) + 0.04 * share(products, 4)
    return round_half_up(clamp(c + F.when(has_social, 0.08).otherwise(0.0), 0.2, 0.98), 3)


def linked_accounts(accounts: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """key with a sorted list of the distinct values of each column in lists (new name -> column), nulls left out."""
    return accounts.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(name) for name, c in lists.items()])


def platform_metrics(rows: DataFrame, key: str, platform: str, fields: list[str], confidence: str) -> DataFrame:
    """key with metrics (map of platform to a struct of fields) and the mean confidence."""
    known = rows.where(F.col(platform).isNotNull())
    entry = F.struct(F.col(platform).alias("key"), F.struct(*fields).alias("value"))
    return known.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("metrics"), F.avg(confidence).alias("confidence"))


def display_name(handle: Column, slug: Column, identity: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(title_case(blank(handle)), title_case(blank(slug)), F.concat(F.lit("Creator "), F.substring(F.regexp_replace(identity, "^ci_", ""), 1, 8)))


def store_confidence(variant: str, **has: Column) -> Column:
    """Confidence in a store profile, from what was found; variant "baseline" or "page"."""
    # What each finding adds.
    table = {
        "baseline": {"offers": 0.2, "prices": 0.2, "types": 0.15, "email": 0.1, "socials": 0.1},
        "page": {"name": 0.08, "bio": 0.12, "offers": 0.16, "prices": 0.14, "types": 0.13, "socials": 0.1, "image": 0.07, "email": 0.07, "offers3": 0.04, "prices2": 0.04},
    }[variant]
    total = sum((F.when(has[k], F.lit(v)).otherwise(0.0) for k, v in table.items() if k in has), F.lit(0.25))
    return clamp(round_half_up(total, 2 if variant == "baseline" else 3))


def extraction_confidence(slug, followers, profile, handle, ig_url, ig_handle) -> Column:
    parts = ((slug, 0.38), (followers, 0.2), (profile, 0.16), (handle, 0.1), (ig_url, 0.04), (ig_handle, 0.02))
    return round_half_up(clamp(sum((F.when(c, F.lit(v)).otherwise(0.0) for c, v in parts), F.lit(0.1))), 3)


def sane_metrics(raw: Column) -> Column:
    """A map of platform metrics with normal names and sane numbers: counts rounded and not below 0, rates within 0 and 1.

    Platforms without a name or a number are dropped; of two entries of a platform the later counts.
    """
    whole = lambda x: F.when(finite(x).isNotNull(), F.greatest(F.lit(0.0), round_half_up(finite(x))))
    share = lambda x: F.when(finite(x).isNotNull(), clamp(finite(x)))

    def cleaned(e):
        v = e["value"]
        value = F.struct(whole(v["followers"]).alias("followers"), whole(v["avg_views"]).alias("avg_views"), share(v["engagement_rate"]).alias("engagement_rate"), share(v["confidence"]).alias("confidence"), whole(v["sample_size"]).alias("sample_size"))
        return F.struct(normal_platform(e["key"], "unknown").alias("key"), value.alias("value"))

    entries = F.transform(F.map_entries(raw), cleaned)
    known = F.filter(entries, lambda e: e["key"].isNotNull() & F.coalesce(*[e["value"][n] for n in ("followers", "avg_views", "engagement_rate", "confidence", "sample_size")]).isNotNull())
    return let(known, lambda es: F.map_from_entries(F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"]))))


def sample_links(*links: Column, most: int = 24) -> Column:
    """Arrays of links as one, each once whatever its case, the first casing kept."""
    none = F.array().cast("array<string>")
    return F.slice(distinct_texts(F.concat(*[F.coalesce(x, none) for x in links]), fold=False), 1, most)


def creator_id(identity: Column) -> Column:
    return F.concat(F.lit("cr_real_"), F.regexp_replace(identity, "^ci_", ""))


def assemble(rows: DataFrame, require_store: bool = True) -> DataFrame:
    """Identities as creators: creator_id, status (imported, updated, skipped), reason, name, links, and what compatibility reads.

    rows: identity_id, handles, slug, store_url, profile_urls, source_urls, outbound, platforms (arrays), metrics (map), prices,
    cta, corpus (all their texts), store_confidence, social_confidence and already_imported.
    """
    metrics = sane_metrics(F.col("metrics"))
    out = rows.withColumn("platform_metrics", metrics)
    has_social = F.coalesce(F.size("platform_metrics") > 0, F.lit(False))
    out = out.withColumn("primary_platform", primary_of(F.col("platform_metrics"), F.col("platforms")))
    out = compatibility(out, "corpus", "cta", F.size("prices") > 0, has_social, F.col("primary_platform").isNotNull())
    missing = F.coalesce(F.col("store_url") == "", F.lit(True)) if require_store else F.lit(False)
    first = F.get(F.filter(F.coalesce("handles", F.array().cast("array<string>")), lambda h: F.trim(h) != ""), F.lit(0))
    return out.withColumns({
        "creator_id": creator_id(F.col("identity_id")), "status": F.when(missing, "skipped").when(F.col("already_imported"), "updated").otherwise("imported"), "reason": F.when(missing, "missing stan profile"),
        "name": display_name(first, F.col("slug"), F.col("identity_id")), "links": sample_links(F.array("store_url"), F.col("profile_urls"), F.col("source_urls"), F.col("outbound")),
        "confidence": profile_confidence(F.col("store_confidence"), F.col("social_confidence"), F.col("niche_confidence"), F.size("topics"), F.size("audiences"), F.size("products"), has_social),
        "social_confidence": round_half_up("social_confidence", 4),
    })


def primary_of(metrics: Column, platforms: Column) -> Column:
    """The platform whose metrics weigh most, of equals the first by name; without metrics the first platform known."""
    rated = F.transform(F.map_entries(metrics), lambda e: F.struct((-round_half_up(primary_score(e["value"]["avg_views"], e["value"]["followers"], e["value"]["confidence"]), 9)).alias("s"), e["key"].alias("p")))
    named = F.filter(rated, lambda r: r["p"] != "unknown")
    return F.coalesce(F.array_min(named)["p"], F.get(F.filter(platforms, lambda p: p != "unknown"), F.lit(0)))


def import_stats(rows: DataFrame) -> DataFrame:
    """One row: selected, skipped_missing_profile, skipped_low_confidence, imported and updated."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    status = F.col("status")
    return rows.agg(F.count("*").alias("selected"), n((status == "skipped") & (F.col("reason") == "missing stan profile"), "skipped_missing_profile"), n((status == "skipped") & (F.col("reason") == "low confidence"), "skipped_low_confidence"), n(status == "imported", "imported"), n(status == "updated", "updated"))

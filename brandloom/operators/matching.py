"""The exact top k creators of each brand without scoring every pair: postings, upper bounds, a threshold a brand.

Phrases that brands want and phrases that creators offer are held against each other as vocabularies (`likeness.alike`). From
there postings lead to creators: a pair gets the strong likenesses (STRONG or more) of its phrases by equi-joins, and for each
phrase that it has no strong match for, the most that any weaker phrase of the vocabulary could give. With these, and with the
parts that are a creator's own, a pair has an upper bound of its total.

A total is a mean of module scores weighted by trust, w * c, plus a boost. It can reach T only if the sum over modules of
w * c * (score - (T - boost)) is 0 or more, which is linear, so that unknown scores and confidences are replaced by the ends of
their ranges. The threshold of a brand is the k-th best total among SEEDS creators that look best and are scored exactly. Pairs
whose bound reaches it are scored; all others are not. A creator that no posting leads to has the bound of the brand alone: if
that reaches the threshold (a brand that wants nothing, a pool smaller than k), the brand is scored against all creators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import clamp
from ..plans.rules import MODULES
from ..sources.shared import dealt, stored
from . import likeness, scoring
from .ranking import top_k

STRONG, WEAK = 0.75, 0.34
#: Seeds a place of the top k, and what rounding a total to four places can add to it.
SEEDS, SLACK = 3, 1e-4

#: kind: (brand's column, creator's column, measure)
KINDS = {"topic": ("__topics", "__offered", "jaccard"), "audience": ("__audience", "__offered_audience", "overlap"), "priority": ("__priorities", "__signals", "phrase"), "niche": ("__category", "__niche", "phrase")}


def _list(kind: str, column: str) -> Column:
    """Phrases of a column of terms."""
    if kind == "niche":
        return F.filter(F.array(F.col(column)["p"]), lambda p: p != "")
    return F.transform(F.col(column), lambda t: t["p"])


def _exploded(df: DataFrame, key: str, side: int) -> DataFrame:
    """key, kind, at and phrase, for all kinds in one pass."""

    def placed(kind):
        return F.transform(_list(kind, KINDS[kind][side]), lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), p.alias("phrase")))

    lists = F.array(*map(placed, KINDS))
    return df.select(key, F.explode(F.flatten(lists)).alias("x")).select(key, "x.*")


def _vocabulary(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """kind, a, b, likeness and, for niches, confidence: of phrases alike by WEAK or more."""
    pairs = likeness.alike_by(wanted, offered, "kind", {kind: measure for kind, (_, _, measure) in KINDS.items()}, WEAK)
    level, niche = scoring.niche_affinity(scoring.term(F.col("a")), scoring.term(F.col("b"))), F.col("kind") == "niche"
    return pairs.select("kind", "a", "b", F.when(niche, level["score"]).otherwise(F.col("likeness")).alias("likeness"), F.when(niche, level["confidence"]).alias("sure")).where("likeness > 0")


def _gain(score: Column, low: Column, high: Column, level: Column) -> Column:
    """The most that a module of this score and this range of confidence adds to the sum that must not be below 0."""
    return F.when(score >= level, (score - level) * high).otherwise((score - level) * low)


def _boost(n: Column, most: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(0.16), 0.04 * F.least(F.lit(3), n) + 0.07 * F.least(F.lit(1.0), most))).otherwise(0.0)


#: What is known of a module's score (at most) and confidence (at least, at most); of several, any may hold.
Part = tuple[Column, Column, Column]


def _reaches(parts: dict[str, list[Part]], boost: Column, threshold: Column) -> Column:
    """Whether a pair can reach the threshold."""
    level = threshold - boost - SLACK
    most = lambda options: F.greatest(*options) if len(options) > 1 else options[0]
    total = sum((F.col(f"__base.{m}") * most([_gain(*part, level) for part in parts[m]]) for m in MODULES), F.lit(0.0))
    return total >= -1e-9


def _brand_bounds(brands: DataFrame, wanted: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of a brand whoever the creator is: sizes of its lists, and what weaker phrases could give, in all and by phrase."""
    weak = vocabulary.where(F.col("likeness") < STRONG).groupBy("kind", "a").agg(F.max("likeness").alias("weak"))
    rest = F.when(F.col("kind") == "priority", F.coalesce("weak", F.lit(0.0))).otherwise(F.coalesce("weak", F.lit(WEAK)))  # below WEAK there is no boost
    each = wanted.join(weak.withColumnRenamed("a", "phrase"), ["kind", "phrase"], "left").select("__b", "kind", "at", rest.alias("rest"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    sums = each.groupBy("__b").agg(
        *[F.coalesce(F.sum(of(k, F.col("rest"))), F.lit(0.0)).alias(f"{k}_rest") for k in ("topic", "audience")], F.count(of("priority", F.nullif("rest", F.lit(0.0)))).alias("weak_n"),
        F.coalesce(F.max(of("priority", F.col("rest"))), F.lit(0.0)).alias("weak_most"),
    )
    named = brands.select("__b", "__base", F.size("__topics").alias("nt"), F.size("__audience").alias("na"), F.size("__platforms").alias("np"), (F.col("__category.p") != "").alias("has_category"))
    bounds = named.join(sums, "__b", "left").fillna({"topic_rest": 0.0, "audience_rest": 0.0, "weak_n": 0, "weak_most": 0.0})
    return bounds, each


def _platform(n: Column) -> Part:
    """Bounds of platform_alignment."""
    none = n == 0
    return F.when(none, 0.5).otherwise(1.0), F.when(none, 0.2).otherwise(0.35), F.when(none, 0.2).otherwise(clamp(0.93 + 0.05 * F.least(F.lit(1.0), n / 4)))


def _exactly(score: Column, confidence: Column) -> Part:
    return score, confidence, confidence


def _pair_parts() -> dict[str, Part]:
    """Of rows that hold a brand's bounds, a creator's summary and the gains of their strong likenesses."""
    c = F.col
    topic, audience = (c("nt") == 0) | (c("offers") == 0), (c("na") == 0) | (c("audiences") == 0)
    likes = lambda rest, gain, n: F.least(F.lit(1.0), (c(rest) + c(gain)) / F.greatest(c(n), F.lit(1)))
    topic_trust = clamp(0.4 + 0.35 * F.least(F.lit(1.0), c("nt") / 4) + F.least(F.lit(0.18), 0.02 * c("offers")) + 0.15 * c("sure_of"))
    audience_trust = clamp(0.45 + 0.08 * F.least(F.lit(4), c("na")) + 0.15 * c("sure_of"))
    unknown = F.when(c("has_category") & c("has_niche"), 0.85).otherwise(0.1)
    return {
        "niche": _exactly(F.coalesce("niche_score", F.lit(0.0)), F.coalesce("niche_sure", unknown)),
        "topic": _exactly(F.when(topic, 0.0).otherwise(likes("topic_rest", "topic_gain", "nt")), F.when(topic, 0.2).otherwise(topic_trust)),
        "audience": _exactly(F.when(audience, 0.0).otherwise(likes("audience_rest", "audience_gain", "na")), F.when(audience, 0.2).otherwise(audience_trust)),
        "platform": _platform(c("np")), "engagement": _exactly(c("fit.score"), c("fit.confidence")),
    }


def _unmatched_parts() -> dict[str, list[Part]]:
    """Of a brand's bounds, for any creator that no posting leads to."""
    c = F.col
    none = _exactly(F.lit(0.0), F.lit(0.2))  # a side has no phrases
    likes = lambda rest, n: F.when(c(n) == 0, 0.0).otherwise(c(rest) / F.greatest(c(n), F.lit(1)))
    trust = lambda n, least, more: (F.when(c(n) == 0, 0.2).otherwise(least), F.when(c(n) == 0, 0.2).otherwise(clamp(least + more)))
    return {
        "niche": [_exactly(F.lit(0.0), F.lit(0.85)), _exactly(F.lit(0.0), F.lit(0.1))], "topic": [(likes("topic_rest", "nt"), *trust("nt", 0.4 + 0.35 * F.least(F.lit(1.0), c("nt") / 4), 0.33)), none],
        "audience": [(likes("audience_rest", "na"), *trust("na", 0.45 + 0.08 * F.least(F.lit(4), c("na")), 0.15)), none], "platform": [_platform(c("np"))], "engagement": [(F.lit(1.0), F.lit(0.0), F.lit(1.0))],
    }


def _estimate(parts: dict[str, Part], boost: Column) -> Column:
    """What a pair looks like; only the choice of seeds depends on it."""
    weight = {m: F.col(f"__base.{m}") * parts[m][2] for m in MODULES}
    return sum((weight[m] * parts[m][0] for m in MODULES), F.lit(0.0)) / sum(weight.values(), F.lit(1e-9)) + boost


def _score_columns() -> tuple:
    """What pairs are compared by and what follows from it, for both tables of pairs that are scored."""
    return {"b_": F.col("__b"), "c_": F.col("__c"), **scoring.pair_columns()}, scoring.score_columns()


def _scored(pairs: DataFrame, brands: DataFrame, creators: DataFrame, columns: tuple) -> DataFrame:
    """Pairs (__b, __c), scored in full."""
    paired = scoring.with_terms(creators.join(pairs, "__c", "left_semi"))
    rows = dealt(paired.join(pairs, "__c").join(brands, "__b"), "__b", "__c")
    return scoring.score_prepared(rows.withColumns(columns[0]), columns[1])


def top_matches(brands: DataFrame, creators: DataFrame, brand_id: str, creator_id: str, k: int = 12) -> DataFrame:
    """The scored pairs of the k best creators of each brand, with their rank: by total, then by creator_id."""
    raw = creators
    brands = stored(scoring.prepare_brands(brands).withColumn("__b", F.monotonically_increasing_id()), "brands")
    creators = stored(scoring.prepare_phrases(creators).withColumn("__c", F.monotonically_increasing_id()), "creators")
    columns = _score_columns()
    pairs, thresholds = _candidates(brands, creators, k, columns)
    order = [F.desc("total"), F.col(creator_id)]
    found = top_k(_scored(pairs, brands, creators, columns), ["b_"], order, k).drop("b_", "c_")
    if not thresholds.where("reached").limit(1).count():
        return found
    still_open = stored(thresholds.where("reached").join(brands, "__b").select(*[c for c in brands.columns if not c.startswith("__")]), "open")
    rest = top_k(scoring.score_all(still_open, raw), [brand_id], order, k)
    return found.join(still_open.select(brand_id), brand_id, "left_anti").unionByName(rest.select(*found.columns))


def _candidates(brands: DataFrame, creators: DataFrame, k: int, columns: tuple) -> tuple[DataFrame, DataFrame]:
    """The pairs that can be among the k best, and for each brand whether a creator beyond them might."""
    wanted = _exploded(brands, "__b", 0)
    words = stored(_exploded(creators, "__c", 1).select("kind", "phrase").distinct(), "phrases")
    vocabulary = stored(_vocabulary(wanted, words), "vocabulary")
    bounds, rests = _brand_bounds(brands, wanted, vocabulary)
    strong = vocabulary.where((F.col("likeness") >= STRONG) | (F.col("kind") == "niche"))
    lists = wanted.join(rests, ["__b", "kind", "at"]).join(strong.withColumnRenamed("a", "phrase"), ["kind", "phrase"]).select("__b", "kind", "at", "rest", "likeness", "sure", F.col("b").alias("phrase"))
    # Creators are moved, once, not their pairs: where the lists are broadcast (they are stored, so that their size is known), all of a pair is where its creator is.
    postings = _exploded(creators.repartition("__c"), "__c", 1).drop("at").join(stored(lists, "lists"), ["kind", "phrase"])
    best = postings.groupBy("__b", "__c", "kind", "at").agg(F.max("likeness").alias("likeness"), F.max("rest").alias("rest"), F.max("sure").alias("sure"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    more = F.greatest(F.col("likeness") - F.col("rest"), F.lit(0.0))
    gains = best.groupBy("__b", "__c").agg(
        *[F.coalesce(F.sum(of(x, more)), F.lit(0.0)).alias(f"{x}_gain") for x in ("topic", "audience")], F.max(of("niche", F.col("likeness"))).alias("niche_score"), F.max(of("niche", F.col("sure"))).alias("niche_sure"),
        F.count(of("priority", F.lit(1))).alias("strong_n"), F.coalesce(F.max(of("priority", F.col("likeness"))), F.lit(0.0)).alias("strong_most"),
    )
    own = creators.select("__c", F.col("__fit").alias("fit"), clamp(F.coalesce("signal_confidence", F.lit(0.0))).alias("sure_of"), F.size("__offered").alias("offers"), F.size("__offered_audience").alias("audiences"), (F.col("__niche.p") != "").alias("has_niche"))
    parts, boost = _pair_parts(), _boost(F.col("strong_n") + F.col("weak_n"), F.greatest("strong_most", "weak_most"))
    seen = stored(gains.join(own, "__c").join(bounds, "__b").withColumn("boost_most", boost).withColumn("looks", _estimate(parts, boost)), "candidates")
    seeds = top_k(seen.select("__b", "__c", "looks"), ["__b"], [F.desc("looks"), F.col("__c")], SEEDS * k)
    totals = _scored(seeds.select("__b", "__c"), brands, creators, columns).select(F.col("b_").alias("__b"), "total")
    kth = top_k(totals, ["__b"], [F.desc("total")], k).groupBy("__b").agg(F.min("total").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    threshold = bounds.join(kth, "__b", "left").withColumn("threshold", F.coalesce("least", F.lit(-1.0)))
    reached = _reaches(_unmatched_parts(), _boost(F.col("weak_n"), F.col("weak_most")), F.col("threshold"))
    thresholds = stored(threshold.select("__b", "threshold", reached.alias("reached")), "thresholds")
    kept = seen.join(thresholds, "__b").where(~F.col("reached") & _reaches({m: [part] for m, part in parts.items()}, F.col("boost_most"), F.col("threshold")))
    return stored(kept.select("__b", "__c"), "kept"), thresholds

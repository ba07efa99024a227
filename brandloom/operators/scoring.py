"""Brand and creator compatibility, as column expressions over a row that holds both sides.

Each module gives a struct of score and confidence. A brand's columns: category, target_audience, goals, campaign_angles,
match_topics, preferred_platforms, priority_niches, priority_topics. A creator's: niche, platforms, audience_types,
topics, estimated_engagement, metrics (map of platform to followers, avg_views, engagement_rate, confidence, sample_size),
signal_confidence, primary_platform. Lists may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import clamp, distinct_texts, round_half_up
from ..functions.text import jaccard, keyword_hits, let, overlap, phrase, phrase_similarity, tokens
from ..plans.rules import INTENT_KEYWORDS, MODULES, POLICIES
from ..sources.shared import dealt, stored

NONE = "array<string>"


def result(score: Column, confidence: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), confidence.cast("double").alias("confidence"))


def some(xs: Column | str) -> Column:
    return F.coalesce(F.col(xs) if isinstance(xs, str) else xs, F.array().cast(NONE))


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)


def best_of(wanted: Column, offered: Column, likeness) -> Column:
    """For each of wanted the best likeness among offered, 0 if there are none; both are terms."""
    return let(offered, lambda os: F.transform(wanted, lambda w: F.coalesce(F.array_max(F.transform(os, lambda o: likeness(w, o))), F.lit(0.0))))


def topic_likeness(w: Column, o: Column) -> Column:
    return F.when(w["p"] == o["p"], F.lit(1.0)).otherwise(jaccard(w["t"], o["t"]))


def audience_likeness(w: Column, o: Column) -> Column:
    return F.when(w["p"] == o["p"], F.lit(1.0)).otherwise(overlap(w["t"], o["t"]))


def term(p: Column) -> Column:
    return F.struct(p.alias("p"), tokens(p).alias("t"))


def terms(phrases: Column) -> Column:
    """Each phrase with its tokens."""
    return F.transform(phrases, term)


def niche_affinity(category: Column, niche: Column) -> Column:
    """category, niche: terms of one phrase each."""
    a, b = category["p"], niche["p"]
    return (
        F.when((a == "") | (b == ""), result(F.lit(0), F.lit(0.1))).when(a == b, result(F.lit(1), F.lit(0.95)))
        .when(F.contains(a, b) | F.contains(b, a), result(F.lit(0.75), F.lit(0.8)))
        .when(overlap(category["t"], niche["t"]) >= 0.5, result(F.lit(0.55), F.lit(0.65))).otherwise(result(F.lit(0), F.lit(0.85)))
    )


def topic_similarity(likes: Column, offered: Column, signal_confidence: Column) -> Column:
    """likes: what best_of gives for the topics wanted; offered: terms."""
    nb, nc = F.size(likes), F.size(offered)
    score = mean(likes)
    confidence = clamp(0.4 + 0.35 * F.least(F.lit(1.0), nb / 4) + F.least(F.lit(0.18), 0.02 * nc) + 0.15 * clamp(signal_confidence))
    return F.when((nb == 0) | (nc == 0), result(F.lit(0), F.lit(0.2))).otherwise(result(score, confidence))


def audience_fit(likes: Column, offered: Column, signal_confidence: Column) -> Column:
    """likes: what best_of gives for the audiences wanted; offered: terms."""
    score = mean(likes)
    confidence = clamp(0.45 + 0.08 * F.least(F.lit(4), F.size(likes)) + 0.15 * clamp(signal_confidence))
    return F.when((F.size(likes) == 0) | (F.size(offered) == 0), result(F.lit(0), F.lit(0.2))).otherwise(result(score, confidence))


def _part(x: Column, low: float = 0.0) -> Column:
    return F.coalesce(x.cast("double"), F.lit(low))


def presence_of(platforms: Column, metrics: Column, primary: Column) -> Column:
    """Struct of what platform_alignment needs of a creator: names it is on, names measured, and the most views."""
    keys = F.coalesce(F.map_keys(metrics), F.array().cast(NONE))
    most = F.coalesce(F.array_max(F.transform(F.map_values(metrics), lambda m: _part(m["avg_views"]))), F.lit(0.0))
    return F.struct(F.array_distinct(F.array_compact(F.concat(platforms, keys, F.array(primary)))).alias("names"), keys.alias("keys"), most.alias("most"))


def platform_alignment(wanted: Column, presence: Column, metrics: Column) -> Column:
    """wanted: normal names; presence: what presence_of gives. metrics may be null."""
    present, keys, most = presence["names"], presence["keys"], presence["most"]

    def measured(m):
        views, followers = _part(m["avg_views"]), _part(m["followers"])
        by_views = 0.35 * F.log1p(views) / F.log1p(F.greatest(views, most))
        by_followers = 0.18 * clamp(F.log1p(F.greatest(F.lit(0.0), followers)) / F.log1p(F.lit(1e6)))
        return clamp(0.35 + F.when((views > 0) & (most > 0), by_views).otherwise(by_followers) + 0.2 * clamp(_part(m["engagement_rate"]) / 0.07) + 0.1 * clamp(_part(m["confidence"])) + 0.06 * clamp(_part(m["sample_size"]) / 6))

    strength = lambda p: F.when(~F.array_contains(present, p), F.lit(0.0)).when(~F.array_contains(keys, p), F.lit(0.42)).otherwise(let(F.try_element_at(metrics, p), measured))
    n = F.size(wanted)
    share = lambda names: F.size(F.array_intersect(wanted, names)) / n
    confidence = clamp(0.35 + 0.3 * share(present) + 0.28 * share(keys) + 0.05 * F.least(F.lit(1.0), n / 4))
    return (
        F.when(n == 0, result(F.lit(0.5), F.lit(0.2))).when(F.size(present) == 0, result(F.lit(0), F.lit(0.4)))
        .otherwise(result(let(mean(F.transform(wanted, strength)), lambda x: clamp(x)), confidence))
    )


def _weighted(values: Column, value, weight) -> Column:
    pairs = F.transform(values, lambda m: F.struct((value(m) * weight(m)).alias("v"), weight(m).alias("w")))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"])
    return F.when(total > 0, F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["v"]) / total)


def derived_engagement(metrics: Column) -> Column:
    """rate and confidence from measured rates, else from views per follower; a null rate if there are neither."""
    values = F.coalesce(F.map_values(metrics), F.array().cast("array<struct<followers:double,avg_views:double,engagement_rate:double,confidence:double,sample_size:double>>"))
    rated = F.filter(values, lambda m: m["engagement_rate"] > 0)
    seen = F.filter(values, lambda m: (m["avg_views"] > 0) & (m["followers"] > 0))
    weight = lambda m: F.greatest(F.lit(0.2), F.coalesce(m["confidence"], F.lit(0.6))) * F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.coalesce(m["sample_size"], F.lit(1.0)) / 5)) * F.greatest(F.lit(1.0), F.log10(F.coalesce(m["followers"], F.lit(0.0)) + 10))
    rate = _weighted(rated, lambda m: m["engagement_rate"], weight)
    conf = clamp(0.45 + 0.2 * F.least(F.lit(1.0), F.size(rated) / 3) + 0.25 * mean(F.transform(rated, lambda m: F.coalesce(m["confidence"], F.lit(0.6)))))
    return (
        F.when(F.size(rated) > 0, F.struct(rate.alias("rate"), conf.alias("confidence")))
        .when(F.size(seen) > 0, F.struct(mean(F.transform(seen, lambda m: m["avg_views"] / m["followers"])).alias("rate"), clamp(0.38 + 0.14 * F.least(F.lit(1.0), F.size(seen) / 3)).alias("confidence")))
        .otherwise(F.struct(F.lit(None).cast("double").alias("rate"), F.lit(0.0).alias("confidence")))
    )


def engagement_fit(direct: Column, derived: Column) -> Column:
    """derived: what derived_engagement gives."""
    rate, conf = derived["rate"], derived["confidence"]
    weight = F.greatest(F.lit(0.2), conf)
    both = (direct * 0.8 + rate * weight) / (0.8 + weight)
    score = lambda r: clamp(r / 0.045)
    return (
        F.when(direct.isNotNull() & rate.isNotNull(), result(score(both), clamp(0.55 + 0.25 * conf))).when(direct.isNotNull(), result(score(direct), F.lit(0.86)))
        .when(rate.isNotNull(), result(score(rate), conf)).otherwise(result(F.lit(0), F.lit(0.25)))
    )


def intent_vector(texts: Column) -> Column:
    """Struct of shares over the intents; texts: a brand's goals, angles and topics, as distinct phrases."""
    hits = {k: keyword_hits(texts, words) + (1 if k == "product_sale" else 0) for k, words in INTENT_KEYWORDS.items()}
    total = sum(hits.values(), F.lit(0))
    return F.when(F.size(texts) == 0, F.struct(*[F.lit(1.0 if k == "product_sale" else 0.0).alias(k) for k in hits])).otherwise(F.struct(*[(n / total).alias(k) for k, n in hits.items()]))


def blended_weights(intent: Column) -> Column:
    """Struct of module weights that sum to one."""
    raw = {m: sum((clamp(intent[k]) * p[i] for k, p in POLICIES.items()), F.lit(0.0)) for i, m in enumerate(MODULES)}
    total = sum(raw.values(), F.lit(0.0))
    return F.struct(*[(w / total).alias(m) for m, w in raw.items()])


def trusted_weights(base: Column, modules: Column) -> Column:
    """Base weights times each module's confidence, made to sum to one; the base if that is nothing."""
    trusted = {m: base[m] * clamp(modules[m]["confidence"]) for m in MODULES}
    total = sum(trusted.values(), F.lit(0.0))
    return F.when(total <= 1e-9, base).otherwise(F.struct(*[(w / total).alias(m) for m, w in trusted.items()]))


def priority_boost(priorities: Column, likes: Column) -> Column:
    """boost and the (up to three) priorities, of likeness 0.34 or more, that earn it. priorities: terms; likes: what best_of gives for them."""
    # likes stands outside all lambdas: Spark writes an expression in where its column is used once, and would work it out for each priority.
    paired = F.zip_with(priorities, likes, lambda p, like: F.struct(like.alias("likeness"), p["p"].alias("priority")))

    def rate(r, i):
        return F.struct(r["likeness"], (-i).alias("rank"), r["priority"])

    def boost(top):
        return F.struct(F.when(F.size(top) > 0, F.least(F.lit(0.16), 0.04 * F.size(top) + 0.07 * mean(F.transform(top, lambda r: r["likeness"])))).otherwise(0.0).alias("boost"), F.transform(top, lambda r: r["priority"]).alias("matched"))

    return let(F.slice(F.reverse(F.array_sort(F.filter(F.transform(paired, rate), lambda r: r["likeness"] >= 0.34))), 1, 3), boost)


def term_similarity(a: Column, b: Column) -> Column:
    """phrase_similarity of two terms."""
    return phrase_similarity(a["p"], b["p"], a["t"], b["t"])


def _phrases(*names: str) -> Column:
    return distinct_texts(F.transform(F.concat(*[some(n) for n in names]), phrase))


def prepare_brands(brands: DataFrame) -> DataFrame:
    """What the pairs need of a brand, worked out once: __topics, __audience, __platforms, __priorities, __category, __base."""
    staged = brands.withColumn("__texts", _phrases("goals", "campaign_angles", "match_topics")).withColumn("__intent", intent_vector(F.col("__texts")))
    return staged.select(
        *brands.columns, terms(_phrases("match_topics", "campaign_angles", "goals")).alias("__topics"), terms(_phrases("target_audience")).alias("__audience"),
        _phrases("preferred_platforms").alias("__platforms"), terms(_phrases("priority_niches", "priority_topics")).alias("__priorities"), term(phrase(F.coalesce("category", F.lit("")))).alias("__category"), blended_weights(F.col("__intent")).alias("__base"),
    )


def prepare_creators(creators: DataFrame) -> DataFrame:
    """What the pairs need of a creator, worked out once: __offered, __offered_audience, __presence, __signals, __niche, __fit."""
    return with_terms(prepare_phrases(creators))


def prepare_phrases(creators: DataFrame) -> DataFrame:
    """prepare_creators, with terms that have no tokens yet."""
    staged = creators.withColumns({"__derived": derived_engagement(F.col("metrics")), "__offered": _phrases("topics"), "__offered_audience": _phrases("audience_types"), "__niche": phrase(F.coalesce("niche", F.lit("")))})
    signals = F.array_distinct(F.concat(F.filter(F.array("__niche"), lambda p: p != ""), "__offered", "__offered_audience"))
    bare = lambda phrases: F.transform(phrases, lambda p: F.struct(p.alias("p")))
    return staged.select(
        *creators.columns, bare("__offered").alias("__offered"), bare("__offered_audience").alias("__offered_audience"), presence_of(_phrases("platforms"), F.col("metrics"), F.col("primary_platform")).alias("__presence"),
        bare(signals).alias("__signals"), F.struct(F.col("__niche").alias("p")).alias("__niche"), engagement_fit(F.col("estimated_engagement"), F.col("__derived")).alias("__fit"),
    )


def with_terms(prepared: DataFrame) -> DataFrame:
    """What prepare_phrases gives, with the tokens of its phrases."""
    return prepared.withColumns({name: F.transform(name, lambda x: term(x["p"])) for name in ("__offered", "__offered_audience", "__signals")} | {"__niche": term(F.col("__niche.p"))})


def match_spec(brands: DataFrame) -> DataFrame:
    """brands with topics, audiences, platforms, priorities, evidence_confidence and specificity."""
    n = lambda c: F.size(some(c))
    named = [n(c) > 0 for c in ("match_topics", "campaign_angles", "goals", "target_audience", "preferred_platforms")] + [F.coalesce(F.col("category") != "", F.lit(False))]
    breadth = n("match_topics") + n("campaign_angles") + n("goals") + n("target_audience")
    return brands.withColumns({
        "topics": _phrases("match_topics", "campaign_angles", "goals"), "audiences": _phrases("target_audience"), "platforms": _phrases("preferred_platforms"), "priorities": _phrases("priority_niches", "priority_topics"),
        "evidence_confidence": clamp(0.35 + 0.1 * sum((x.cast("int") for x in named), F.lit(0))),
        "specificity": F.when(breadth <= 1, 0.2).when(breadth <= 4, 0.5).when(breadth <= 8, 0.68).otherwise(0.82),
    })


def breakdown(scored: DataFrame) -> DataFrame:
    """scored pairs with a struct of what a match shows: four scores, the best platform and the boost, at 4 places."""
    parts = [round_half_up(f"modules.{m}.score", 4).alias(f"{m}_score") for m in ("niche", "topic", "platform", "engagement")]
    return scored.withColumn("breakdown", F.struct(*parts, "best_platform", round_half_up("boost", 4).alias("priority_boost")))


#: What is compared by phrases: brand's column, creator's column, likeness.
COMPARED = {"topics": ("__topics", "__offered", topic_likeness), "audience": ("__audience", "__offered_audience", audience_likeness), "priorities": ("__priorities", "__signals", term_similarity)}


#: What pairs need of one column of the brand alone, besides the creator: brand's column, result of its value.
BY_VALUE = {
    "niche": ("__category", lambda category: niche_affinity(category, F.col("__niche"))),
    "platform": ("__platforms", lambda wanted: platform_alignment(wanted, F.col("__presence"), F.col("metrics"))),
}


def pair_columns() -> dict[str, Column]:
    """The likenesses of COMPARED and the results of BY_VALUE, of rows that hold both sides."""
    likes = {f"__like_{name}": best_of(F.col(b), F.col(c), like) for name, (b, c, like) in COMPARED.items()}
    return likes | {f"__fit_{name}": fit(F.col(b)) for name, (b, fit) in BY_VALUE.items()}


def score_columns() -> tuple[dict[str, Column], Column, dict[str, Column]]:
    """The columns of score_prepared, step by step; they are large, and can be used for several tables."""
    c, conf = F.col, F.coalesce(F.col("signal_confidence"), F.lit(0.0))
    staged = {
        "modules": F.struct(
            c("__fit_niche").alias("niche"), topic_similarity(c("__like_topics"), c("__offered"), conf).alias("topic"),
            c("__fit_platform").alias("platform"),
            audience_fit(c("__like_audience"), c("__offered_audience"), conf).alias("audience"), c("__fit").alias("engagement"),
        ),
        "__boost": priority_boost(c("__priorities"), c("__like_priorities")),
    }
    total = sum((clamp(c(f"modules.{m}.score")) * c(f"weights.{m}") for m in MODULES), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(c(f"modules.{m}.score") * c(f"modules.{m}.confidence") >= 0.15, F.lit(m)) for m in MODULES], F.when(c("__boost.boost") > 0, F.lit("priority"))))
    out = {"boost": c("__boost.boost"), "total": round_half_up(clamp(clamp(total) + c("__boost.boost")), 4), "reasons": reasons, "best_platform": F.lower(F.get(some("platforms"), F.lit(0)))}
    return staged, trusted_weights(c("__base"), c("modules")), out


def score_prepared(pairs: DataFrame, columns: tuple | None = None) -> DataFrame:
    """Prepared pairs, with what pair_columns gives, with modules, weights, boost, total, best_platform and reasons."""
    staged, weights, scores = score_columns() if columns is None else columns
    out = pairs.withColumns(staged).withColumn("weights", weights).withColumns(scores)
    return out.drop(*[n for n in out.columns if n.startswith("__")])


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Rows that hold a brand's and a creator's columns, scored."""
    rows = prepare_creators(prepare_brands(pairs))
    return score_prepared(rows.withColumns(pair_columns()))


def score_all(brands: DataFrame, creators: DataFrame, most_brands: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Every brand with every creator. Brands are measured: up to most_brands of them and most_bytes are broadcast, more go in rounds of as much."""
    brands, creators = stored(prepare_brands(brands), "brands"), prepare_creators(creators)  # brands are read three times
    # A creator costs a score for every brand, so creators are dealt to all cores before they are paired.
    creators = dealt(creators, creators.columns[0])
    n, held = brands.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*brands.columns)))), F.lit(0))).first()
    rounds = max(1, -(-n // most_brands), -(-held // most_bytes))
    parts = [brands] if rounds == 1 else [brands.where(F.pmod(F.hash(*brands.columns[:1]), F.lit(rounds)) == k) for k in range(rounds)]
    return reduce(DataFrame.unionByName, [score_prepared(_paired(part, creators)) for part in parts])


def _paired(brands: DataFrame, creators: DataFrame) -> DataFrame:
    """Every brand (few enough to be broadcast) with every creator, and what pair_columns gives.

    Brands share phrases, categories and lists of platforms: each creator is held against each different one once, and pairs look that up.
    """
    phrases = lambda column: F.array_distinct(F.flatten(F.collect_list(F.transform(column, lambda x: x["p"]))))
    values = {f"__all_{name}": F.array_sort(F.collect_set(F.col(b))) for name, (b, _) in BY_VALUE.items()}
    known = brands.agg(*[terms(F.array_sort(phrases(F.col(b)))).alias(f"__all_{name}") for name, (b, _, _) in COMPARED.items()], *[v.alias(n) for n, v in values.items()])  # one row, no larger than the brands
    places = {f"__at_{name}": F.transform(b, lambda w: F.array_position(F.transform(f"__all_{name}", lambda x: x["p"]), w["p"]).cast("int")) for name, (b, _, _) in COMPARED.items()}  # noqa: B023
    places |= {f"__at_{name}": F.array_position(f"__all_{name}", F.col(b)).cast("int") for name, (b, _) in BY_VALUE.items()}
    found = {f"__best_{name}": best_of(F.col(f"__all_{name}"), F.col(c), like) for name, (_, c, like) in COMPARED.items()}
    found |= {f"__best_{name}": F.transform(f"__all_{name}", fit) for name, (_, fit) in BY_VALUE.items()}
    spoken = [f"__all_{name}" for name in (*COMPARED, *BY_VALUE)]
    left = creators.crossJoin(F.broadcast(known)).withColumns(found).drop(*spoken)
    right = brands.crossJoin(F.broadcast(known)).withColumns(places).drop(*spoken)
    looked_up = {f"__like_{name}": F.transform(f"__at_{name}", lambda i: F.element_at(f"__best_{name}", i)) for name in COMPARED}  # noqa: B023
    looked_up |= {f"__fit_{name}": F.element_at(f"__best_{name}", F.col(f"__at_{name}")) for name in BY_VALUE}
    return left.crossJoin(F.broadcast(right)).withColumns(looked_up)

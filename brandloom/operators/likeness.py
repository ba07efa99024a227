"""Phrase likeness as a set-similarity join: which of some phrases are alike, and how much, without comparing each with each.

Three measures, as the scores use them: `jaccard` (1 if equal, else shared tokens over all), `overlap` (1 if equal, else
shared tokens over the smaller set) and `phrase` (1 if equal, 0.84 if one contains the other, else the overlap).

Candidates come from equi-joins. Tokens are ordered by rarity over both sides; two sets that share enough tokens share one of
the first few of each (prefix filter), and how many these are follows from the least likeness asked for and from the sets'
sizes (length filter, for Jaccard). For the overlap the smaller set's prefix is held against every token of the larger one.
A phrase that another contains is met by its rarest gram of three letters (of fewer, if it is shorter). Each candidate is then
measured exactly, so that the result is that of comparing all pairs.

The tables are of distinct phrases, so that what travels follows the vocabulary and not the rows that use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, overlap, phrase_similarity, tokens

GRAM = 3
MEASURES = ("jaccard", "overlap", "phrase")


def measure(kind: str, a: Column, b: Column, a_tokens: Column, b_tokens: Column) -> Column:
    """The likeness of two phrases of which the tokens are known."""
    if kind == "phrase":
        return phrase_similarity(a, b, a_tokens, b_tokens)
    return F.when(a == b, F.lit(1.0)).otherwise(jaccard(a_tokens, b_tokens) if kind == "jaccard" else overlap(a_tokens, b_tokens))


def _phrases(df: DataFrame, by: str, column: str, name: str) -> DataFrame:
    return df.select(F.col(by).alias("by"), F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn(f"{name}_tokens", tokens(name))


def _grams(text: Column, size: int) -> Column:
    n = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size))))


def _features(phrases: DataFrame, name: str, contains: Column, own: str, other: str) -> DataFrame:
    """by, name, role and feature: what a phrase can be met by. own, other: marks of the grams by which it is contained, and contains.

    Roles: `t` a token, `i` a gram of a phrase that may be contained (one is enough), `c` a gram of a phrase that may contain.
    """
    text = F.col(name)
    marked = lambda role, mark, xs: F.transform(xs, lambda x: F.struct(F.lit(role).alias("role"), F.concat(F.lit(mark), x).alias("feature")))
    inner = F.when(F.length(text) >= GRAM, _grams(text, GRAM)).otherwise(F.array(text))
    outer = F.flatten(F.array(*[_grams(text, n) for n in range(1, GRAM + 1)]))
    grams = F.when(contains & (text != ""), F.concat(marked("i", own, inner), marked("c", other, outer)))
    none = F.when(F.size(f"{name}_tokens") == 0, marked("t", "e:", F.array(text)))  # equal phrases without tokens
    found = F.concat(marked("t", "t:", F.col(f"{name}_tokens")), *[F.coalesce(x, F.array().cast("array<struct<role:string,feature:string>>")) for x in (grams, none)])
    return phrases.select("by", name, F.explode(found).alias("x")).select("by", name, "x.*")


def _share(least: float, size: Column) -> Column:
    """Tokens of `size` that must be shared for a part of at least `least` of them."""
    return F.greatest(F.ceil(size * least - 1e-9), F.lit(1))


def _placed(features: DataFrame, name: str, rarity: DataFrame) -> DataFrame:
    """Features with their place (from 1, the rarest first) among those of a role, and their number; of role `i` the rarest alone."""
    ordered = features.join(rarity, ["by", "feature"]).groupBy("by", name, "role").agg(F.array_sort(F.collect_list(F.struct("often", "feature"))).alias("fs"))
    chosen = F.when(F.col("role") == "i", F.slice("fs", 1, 1)).otherwise(F.col("fs"))
    each = ordered.select("by", name, F.size("fs").alias(f"{name}_size"), F.posexplode(chosen).alias("place", "f"))
    return each.select("by", name, F.col("f.feature").alias("feature"), (F.col("place") + 1).alias(f"{name}_place"), f"{name}_size")


def _candidates(left: DataFrame, right: DataFrame, measures: dict[str, str], least: float) -> DataFrame:
    named = lambda kind: F.col("by").isin([by for by, m in measures.items() if m == kind])
    a, b = _features(left, "a", named("phrase"), "l:", "r:"), _features(right, "b", named("phrase"), "r:", "l:")
    rarity = a.select("by", "feature").unionByName(b.select("by", "feature")).groupBy("by", "feature").agg(F.count("*").alias("often"))
    pairs = _placed(a, "a", rarity).join(_placed(b, "b", rarity), ["by", "feature"])
    first = lambda side: F.col(f"{side}_place") <= F.col(f"{side}_size") - _share(least, F.col(f"{side}_size")) + 1
    sizes = (F.col("a_size") >= least * F.col("b_size") - 1e-9) & (F.col("b_size") >= least * F.col("a_size") - 1e-9)
    smaller = F.when(F.col("a_size") <= F.col("b_size"), first("a")).otherwise(first("b"))
    by_tokens = F.when(named("jaccard"), first("a") & first("b") & sizes).otherwise(smaller)
    held = F.when(F.col("feature").startswith("l:"), F.contains("b", F.col("a"))).when(F.col("feature").startswith("r:"), F.contains("a", F.col("b"))).otherwise(by_tokens)
    return pairs.where(held).select("by", "a", "b").distinct()


def alike_by(left: DataFrame, right: DataFrame, by: str, measures: dict[str, str], least: float = 0.0, left_col="phrase", right_col="phrase") -> DataFrame:
    """(by, a, b, likeness) for the distinct phrases of left and right of equal `by` that are alike by more than 0, and by `least` or more.

    measures: the measure of each value of `by`.
    """
    if not set(measures.values()) <= set(MEASURES):
        raise ValueError(f"measures are {', '.join(MEASURES)}")
    left, right = _phrases(left, by, left_col, "a"), _phrases(right, by, right_col, "b")
    near = _candidates(left, right, measures, least).withColumns({"a_tokens": tokens("a"), "b_tokens": tokens("b")})
    value = None
    for name, kind in measures.items():
        own = measure(kind, *map(F.col, ("a", "b", "a_tokens", "b_tokens")))
        value = F.when(F.col("by") == name, own) if value is None else value.when(F.col("by") == name, own)
    return near.select(F.col("by").alias(by), "a", "b", value.alias("likeness")).where((F.col("likeness") > 0) & (F.col("likeness") >= least))


def alike(left: DataFrame, right: DataFrame, kind: str, least: float = 0.0, left_col="phrase", right_col="phrase") -> DataFrame:
    """(a, b, likeness) by one measure."""
    one = F.lit(kind)
    return alike_by(left.select(left_col, one.alias("kind")), right.select(right_col, one.alias("kind")), "kind", {kind: kind}, least, left_col, right_col).drop("kind")


def candidates(left: DataFrame, right: DataFrame, kind: str, least: float = 0.0, left_col="phrase", right_col="phrase") -> DataFrame:
    """(a, b): the pairs that `alike` measures."""
    one = F.lit(kind)
    sides = _phrases(left.withColumn("by", one), "by", left_col, "a"), _phrases(right.withColumn("by", one), "by", right_col, "b")
    return _candidates(*sides, {kind: kind}, least).select("a", "b")

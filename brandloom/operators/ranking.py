"""Ranking: top k of each group, pools, caps, decks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark prunes each partition to k a key before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def pool_cascade(pools: list[tuple[str, DataFrame]], order: list[Column], limit: int = 500, scope: str | None = None) -> DataFrame:
    """The first pool that has rows, with its name as column pool, ordered and cut to limit.

    scope: the name of a pool that is asked for; it never falls through to another.
    """
    if scope is not None:
        pools = [p for p in pools if p[0] == scope]
    ranked = None
    for i, (name, pool) in enumerate(pools):
        part = pool.withColumns({"__pool": F.lit(i), "pool": F.lit(name)})
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    first = ranked.agg(F.min("__pool").alias("__first"))  # one row
    return ranked.join(F.broadcast(first), F.col("__pool") == F.col("__first")).drop("__pool", "__first").orderBy(*order).limit(limit)


def capped(df: DataFrame, query: str, agent: str, position: str, per_query: int, per_agent: int) -> DataFrame:
    """At most per_query rows a query, then per_agent rows an agent, in the order of position; rank is the place in the query."""
    first = top_k(df, [agent, query], [F.col(position)], per_query, "rank")
    return top_k(first, [agent], [F.col(query), F.col("rank")], per_agent, "agent_rank")


def union_by_priority(parts: list[DataFrame], order: list[Column], limit: int) -> DataFrame:
    """All rows, those of earlier parts first."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("priority", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("priority", *order).limit(limit)


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 12) -> DataFrame:
    """A page (from 1) of an ordered table."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def decks(requests: DataFrame, ranked: DataFrame, key: str, text: str, budget: str, order: list[Column], price: str) -> DataFrame:
    """What each request (key, text, budget) is shown of the ranked rows of its key: with a rank, by what it asks for.

    Asked about a budget: six of those within it, or the first three; asked for the best: six, within the budget if any are;
    asked why: three; otherwise none.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    like = lambda p: F.regexp_like(low, F.lit(p))
    kind = F.when(like(r"budget|\$|price|cost"), "budget").when(like("top|best|fit|match|creator|recommend|shortlist"), "best").when(like("why|reason|explain"), "why")
    asked = requests.withColumn("__kind", kind).where("__kind is not null").withColumn("__request", F.monotonically_increasing_id())
    rows = asked.join(ranked, key).withColumn("__fits", F.coalesce((F.col(budget) > 0) & (F.col(price) <= F.col(budget) * 1.1), F.lit(False)))
    rows = rows.withColumn("__any", F.max("__fits").over(Window.partitionBy("__request"))).where("__fits or not __any")
    size = F.when((F.col("__kind") == "why") | ((F.col("__kind") == "budget") & ~F.col("__any")), 3).otherwise(6)
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("__request").orderBy(*order))).where(F.col("rank") <= size)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def deck_history(shown: DataFrame, key: str, signature: str, at: str, most: int = 7) -> DataFrame:
    """The last decks of each key, newest first: a deck shown again moves to the front."""
    last = shown.groupBy(key, signature).agg(F.max(at).alias(at))
    return top_k(last, [key], [F.desc(at), F.col(signature)], most, "place")

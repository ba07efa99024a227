"""Discovery: search rows to raw accounts, page filters, link choice, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..plans import rules
from .importer import extraction_confidence
from .ranking import capped, latest
from .upsert import stable_id, upsert


def explode_results(payloads: DataFrame, results: str = "results") -> DataFrame:
    """One row a search result; its position is its place where none is given."""
    rows = payloads.select("*", F.posexplode(results).alias("__i", "__r")).drop(results)
    return rows.select(*[c for c in rows.columns if c not in ("__i", "__r")], "__r.*", F.coalesce("__r.position", F.col("__i") + 1).alias("place")).drop("position").withColumnRenamed("place", "position")


#: What a search payload looks like.
SERP = "run string, query string, results array<struct<title:string,snippet:string,url:string,position:int,raw:string>>"


def ingest(existing: DataFrame, payloads: DataFrame) -> DataFrame:
    """existing raw accounts with a batch of search payloads (SERP) put in, by run, query and URL.

    Redirect links are followed first. A result without a raw payload keeps its whole row as one; unreadable URLs are left out.
    """
    rows = explode_results(payloads).withColumn("raw", F.coalesce("raw", F.to_json(F.struct("title", "snippet", "url", "position"))))
    rows = rows.withColumn("url", F.coalesce(u.unwrapped("url"), F.col("url")))
    out = normalize(rows, "url", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    out = out.withColumn("id", raw_account_id("run", "query", "url")).select(*existing.columns)
    return upsert(existing, out, ["id"], [F.col("position")])


def normalize(rows: DataFrame, url: str, title: Column, snippet: Column) -> DataFrame:
    """Search rows as raw accounts; rows whose URL can't be read are left out."""
    said = F.concat_ws(" ", title, snippet, url)
    out = rows.where(u.host(url).isNotNull()).withColumns({"platform": u.platform(u.host(url)), "profile_url": u.profile(url)})
    out = out.withColumns({"handle": u.handle(F.col("profile_url")), "store_slug": u.store_slug(said), "followers": t.follower_count(said)})
    return out.withColumn("store_url", F.when(F.col("store_slug").isNotNull(), F.concat(F.lit(f"https://{u.STORE_HOST}/"), "store_slug")))


def raw_account_id(run: Column | str, query: Column | str, url: Column | str) -> Column:
    return stable_id("ra", run, query, url)


def fits_plan(url: Column, blob: Column, hosts: tuple[str, ...], prefix: str, all_terms: tuple[str, ...], any_terms: tuple[str, ...] = (), relaxed: bool = False) -> Column:
    """Whether a result is on a plan's hosts, under its path, and its text (url, title, snippet, lower-cased) has its terms."""
    h, ok = u.host(url), F.lit(False)
    for name in hosts:
        ok = ok | u.on_host(h, name)
    if prefix:
        ok = ok & F.lower(u.path(url)).startswith(prefix)
    if not relaxed:
        for term in all_terms:
            ok = ok & F.contains(blob, F.lit(term))
        if any_terms:
            some = F.lit(False)
            for term in any_terms:
                some = some | F.contains(blob, F.lit(term))
            ok = ok & some
    return F.coalesce(ok, F.lit(False))


def accept(rows: DataFrame, url: str, agent: str, query: str, position: str, keep: Column, per_query: int, per_agent: int) -> DataFrame:
    """Rows that pass keep, once by canonical URL and agent, under both caps."""
    once = latest(rows.where(keep).withColumn("canonical", u.canonical(url)), [agent, "canonical"], [F.col(position)])
    return capped(once, query, agent, position, per_query, per_agent)


def accept_by_plan(rows: DataFrame, url: str, agent: str, query: str, position: str, blob: Column, per_query: int = 10, per_agent: int = 20) -> DataFrame:
    """Rows whose agent is one of the search plans and that fit it, each canonical URL once, under both caps."""
    fits = F.lit(False)
    for name, _, hosts, prefix, terms in rules.PLANS:
        fits = fits | ((F.col(agent) == name) & fits_plan(F.col(url), blob, hosts, prefix, terms))
    return accept(rows, url, agent, query, position, fits & u.is_page(url) & ~u.is_search_host(url), per_query, per_agent)


def grouped_by_query(rows: DataFrame, query: str, url: str, position: str) -> DataFrame:
    """query (trimmed; blank ones are dropped), n, n_urls and the first URL of each group, in the order of positions."""
    named = rows.withColumn("query", F.trim(F.col(query))).where("query <> ''")
    return named.groupBy("query").agg(F.count("*").alias("n"), F.count_distinct(url).alias("n_urls"), F.min_by(url, position).alias("first_url"), F.min(position).alias("place"))


def crawl_summary(rows: DataFrame, url: str, agent: str, query: str, blocked: str) -> DataFrame:
    """One row: rows, different URLs, agents, and queries that were blocked."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct(url).alias("n_urls"), F.count_distinct(agent).alias("n_agents"), F.count_distinct(F.when(F.col(blocked), F.struct(agent, query))).alias("n_blocked"))


def looks_challenged(page: Column | str, least: int = 2, marks: tuple[str, ...] = rules.CHALLENGE_MARKS) -> Column:
    low = F.lower(F.col(page) if isinstance(page, str) else page)
    return sum((F.contains(low, F.lit(m)).cast("int") for m in marks), F.lit(0)) >= least


def hrefs(page: Column) -> Column:
    """What the page's links say, in order: quoted in either way, or bare."""
    found = F.regexp_extract_all(page, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.filter(F.transform(found, lambda h: F.trim(F.regexp_replace(h, "^[\"']|[\"']$", ""))), lambda h: h != "")


def interesting_links(page: Column, base: Column, most: int = 8) -> Column:
    """Links to the base URL's host, whole, by their hints, without junk, in page order."""
    full = F.transform(hrefs(page), lambda h: u.resolved(h, base))
    own = F.filter(full, lambda x: F.coalesce(u.without_www(u.host(x)) == u.without_www(u.host(base)), F.lit(False)))
    path = lambda x: F.lower(u.path(x))
    like = F.regexp_like
    kept = F.filter(own, lambda x: ~path(x).isin("", "/") & ~like(path(x), F.lit(rules.PAGE_JUNK)) & like(path(x), F.lit("|".join(rules.PAGE_HINTS))))
    return F.slice(F.array_distinct(kept), 1, most)


def extract(accounts: DataFrame, texts: Column) -> DataFrame:
    """accounts (normalize's columns) with what their texts add, and the confidence in it."""
    out = accounts.withColumns({"mentions": F.size(F.regexp_extract_all(texts, F.lit(t.FOLLOWERS), F.lit(1))), "followers": F.coalesce("followers", t.most_followers(texts)), "store_slug": F.coalesce("store_slug", u.store_slug(texts))})
    ig = F.col("platform") == "instagram"
    return out.withColumn("confidence", extraction_confidence(F.col("store_slug").isNotNull(), F.col("followers").isNotNull(), F.col("profile_url").isNotNull(), F.col("handle").isNotNull(), ig & F.col("profile_url").isNotNull(), ig & F.col("handle").isNotNull()))


def extraction_stats(source: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row over source rows and what was extracted of them; failed: rows that couldn't be read."""
    count = lambda c, name: F.count_if(c).alias(name)
    has = lambda c: F.col(c).isNotNull()
    seen = extracted.agg(
        F.count("*").alias("read"), count(has("store_slug"), "with_slug"), count(has("followers"), "with_followers"), count(has("profile_url"), "with_profile"), count(has("handle"), "with_handle"),
        count(F.col("platform") == "unknown", "unknown_platform"), count(F.col("confidence") >= 0.5, "confident"),
    )
    both = source.agg(F.count("*").alias("processed")).crossJoin(seen)  # one row each
    return both.withColumn("failed", F.col("processed") - F.col("read")).drop("read")

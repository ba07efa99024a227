"""Identity resolution: accounts to identities by store slug and personal domain, in the order of the accounts.

An account with a known slug gets that identity. A new slug opens an identity, unless its account's domain has one already:
then it gets that one, and the slug is not recorded. An account without slug gets or opens its domain's identity, and one
without either is queued. Only the first account of each (slug, domain) pair can change anything, so pairs are reduced to
their first account. Of these, an account opens an identity if no earlier one that opens has its slug or its domain. So the
openers are the greedy matching of slugs and domains in the order of the accounts, and are found by rounds of joins over all
pairs at once, with no task for a component and nothing folded row by row. All accounts are then resolved by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host, on_host, store_slug, without_www
from ..plans.rules import SEARCH_HOSTS, SOCIAL_HOSTS
from ..sources.shared import drop_stored, stored
from .upsert import stable_id


def personal_domain(url_host: Column, by_suffix: bool = False) -> Column:
    """The host without www if it is no social or search host; by_suffix: their subdomains aren't personal either."""
    h = without_www(F.lower(F.trim(url_host)))
    known = F.lit(False)
    for name in (*SOCIAL_HOSTS, *SEARCH_HOSTS):
        known = known | (on_host(h, name) if by_suffix else h == name)
    return F.when(F.contains(h, F.lit(".")) & ~known, h)


def text_domain(text: Column) -> Column:
    """The first personal domain among a text's links, else the first bare name.tld."""
    urls = F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s)]+"), F.lit(0))
    domains = F.filter(F.transform(urls, lambda u: personal_domain(host(F.regexp_replace(u, "[.,;:!?]+$", "")))), lambda d: d.isNotNull())
    bare = F.regexp_extract(text, r"(?i)(?:^|[^A-Za-z0-9_])([a-z0-9-]+\.[a-z]{2,})(?:/\S*)?", 1)
    return F.coalesce(F.get(domains, F.lit(0)), personal_domain(F.nullif(bare, F.lit(""))))


def anchors(accounts: DataFrame, slug: Column, url: Column, text: Column) -> DataFrame:
    """accounts with slug, domain and where they come from (direct, cross or neither)."""
    own, cross = F.lower(slug), store_slug(text)
    domain, cross_domain = personal_domain(host(url)), text_domain(text)
    return accounts.withColumns({
        "slug": F.coalesce(own, cross), "domain": F.coalesce(domain, cross_domain),
        "reason": F.when(own.isNotNull(), "stan_slug").when(cross.isNotNull(), "cross_link_stan_slug").when(domain.isNotNull(), "personal_domain").when(cross_domain.isNotNull(), "cross_link_personal_domain").otherwise("queued"),
    })


def _least(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias(f"__{name}")).agg(F.min("order").alias(name))


def _openers(pairs: DataFrame) -> DataFrame:
    """The pairs (slug, domain, order) that open an identity; an order occurs once.

    Rounds: a pair that is the first of its slug and of its domain, among those left, opens; what shares a slug or domain with
    it goes. Where most pairs wait for one other pair each (accounts that name a slug and a domain by turns), a round decides
    few of them; then such chains are followed as well, by pointer doubling, since every other pair of a chain opens.
    """
    one = lambda c, other: F.coalesce(F.concat(F.lit("="), c), F.concat(F.lit(other), "order"))  # noqa: E731  without a slug: a key of its own
    left = stored(pairs.withColumns({"by_slug": one("slug", "s"), "by_domain": one("domain", "d")}), "left")
    found, n, chained = None, left.count(), False
    while n:
        marked = left.join(_least(left, "by_slug", "slug_first"), F.col("by_slug") == F.col("__slug_first")).join(_least(left, "by_domain", "domain_first"), F.col("by_domain") == F.col("__domain_first"))
        marked = marked.select(*left.columns, "slug_first", "domain_first")
        if chained:
            marked = stored(marked, "marked")
            opens = stored(_chained(marked), "opens")
        else:
            opens = stored(marked.where("order = slug_first and order = domain_first").select(*left.columns), "opens")
        found = opens if found is None else found.unionByName(opens)
        rest = stored(left.join(opens.select("by_slug"), "by_slug", "left_anti").join(opens.select("by_domain"), "by_domain", "left_anti").select(*left.columns), "left")
        drop_stored(left, marked)
        before, left, n = n, rest, rest.count()
        chained = 2 * n > before
    return pairs.limit(0) if found is None else found.select("slug", "domain", "order")


def _chained(marked: DataFrame) -> DataFrame:
    """The pairs that open by themselves, and those that open or not as one other pair does not or does."""
    later = lambda key, name: _least(marked.where(F.col("order") > F.col(f"{name}_first")), key, f"{name}_second")
    both = marked.join(later("by_slug", "slug"), F.col("by_slug") == F.col("__slug_second"), "left").join(later("by_domain", "domain"), F.col("by_domain") == F.col("__domain_second"), "left")
    waits = F.when((F.col("order") == F.col("slug_first")) & (F.col("order") == F.col("domain_second")), F.col("domain_first")).when((F.col("order") == F.col("domain_first")) & (F.col("order") == F.col("slug_second")), F.col("slug_first"))
    opens = (F.col("order") == F.col("slug_first")) & (F.col("order") == F.col("domain_first"))
    chains = stored(both.select("by_slug", "by_domain", "slug", "domain", "order", waits.alias("at"), opens.alias("opens")).where("opens or at is not null"), "chains")
    steps = stored(chains.where("not opens").select("order", "at", F.lit(1).alias("steps")), "steps")
    while True:
        ahead = steps.select(F.col("order").alias("__order"), F.col("at").alias("__at"), F.col("steps").alias("__steps"))
        joined = steps.join(ahead, F.col("at") == F.col("__order"), "left")
        further = stored(joined.select("order", F.coalesce("__at", "at").alias("at"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__at").isNotNull().alias("moved")), "steps")
        moved = further.where("moved").limit(1).count()
        drop_stored(steps)
        steps = further.drop("moved")
        if not moved:
            break
    roots = chains.where("opens").select(F.col("order").alias("at"))
    even = steps.where("steps % 2 = 0").join(roots, "at", "left_semi").select("order")
    return chains.join(even.unionByName(roots.withColumnRenamed("at", "order")), "order", "left_semi").select("slug", "domain", "order", "by_slug", "by_domain")


def resolve(accounts: DataFrame, order: str, known: DataFrame | None = None) -> DataFrame:
    """accounts (slug, domain, and a long column that orders them without ties) with identity_id; null where queued.

    known: anchors of identities that earlier runs have opened (kind: slug or domain, name, identity_id). They count from
    before the first account, so that runs over parts of the accounts, each given what the runs before it opened, give the
    identities of one run over all of them.
    """
    return resolve_known(accounts, order, known)[0]


def resolve_known(accounts: DataFrame, order: str, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What resolve gives, and the anchors (kind, name, identity_id) that these accounts open."""
    spark = accounts.sparkSession
    held = known if known is not None else spark.createDataFrame([], "kind string, name string, identity_id string")
    slugs, domains = (held.where(F.col("kind") == k).select(F.col("name").alias(k), F.col("identity_id").alias(f"__known_{k}")) for k in ("slug", "domain"))
    rows = accounts.join(slugs, "slug", "left").join(domains, "domain", "left")
    # A known slug or domain opens nothing; only the rest is folded.
    open_rows = rows.where(F.coalesce("__known_slug", "__known_domain").isNull() & F.coalesce("slug", "domain").isNotNull())
    first = open_rows.groupBy("slug", "domain").agg(F.min(order).alias("order"))
    openers = _openers(first)
    anchor = F.coalesce(F.concat(F.lit("s:"), "slug"), F.concat(F.lit("d:"), "domain"))
    entry = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("name"), anchor.alias("anchor"), F.col("order").alias("since"))
    opened = openers.select(F.explode(F.array(entry("slug"), entry("domain"))).alias("e")).select("e.*").where("name is not null")
    by_slug = opened.where("kind = 'slug'").select(F.col("name").alias("slug"), F.col("anchor").alias("__s"), F.col("since").alias("__s_since"))
    by_domain = opened.where("kind = 'domain'").select(F.col("name").alias("domain"), F.col("anchor").alias("__d"))
    joined = rows.join(by_slug, "slug", "left").join(by_domain, "domain", "left")
    named = lambda c: F.when(c.isNotNull(), stable_id("ci", c))
    own = F.when(F.col("__s_since") <= F.col(order), F.col("__s"))
    identity = F.coalesce("__known_slug", named(own), "__known_domain", named(F.col("__d")))
    out = joined.withColumn("identity_id", identity).drop("__s", "__s_since", "__d", "__known_slug", "__known_domain")
    return out, opened.select("kind", "name", stable_id("ci", F.col("anchor")).alias("identity_id"))


def resolve_run(accounts: DataFrame, order: str, known: DataFrame | None = None, linked: DataFrame | None = None) -> dict[str, DataFrame]:
    """A run's tables: links (accounts with an identity, and why), queue (accounts without, with the candidate by handle), known and stats.

    accounts: order, slug, domain, reason (as anchors gives it), account, handle and platform. linked: handle, platform,
    identity_id and created_at of accounts linked before.
    """
    spark = accounts.sparkSession
    rows, opened = resolve_known(accounts, order, known)
    rows, opened = stored(rows, "resolved"), stored(opened, "opened")
    links = rows.where("identity_id is not null").withColumnRenamed("reason", "linkage_reason")
    held = linked if linked is not None else spark.createDataFrame([], "handle string, platform string, identity_id string, created_at timestamp")
    queue = candidate_identity(rows.where("identity_id is null").select("account", "handle", "platform"), held)
    queue = queue.withColumn("reason", F.lit("no slug, personal domain or cross link"))
    created = opened.agg(F.count_distinct("identity_id").alias("n"))
    return {"links": links, "queue": queue, "known": opened if known is None else opened.unionByName(known), "stats": identity_stats(rows).crossJoin(created.withColumnRenamed("n", "created"))}


def identity_stats(rows: DataFrame) -> DataFrame:
    """One row: processed, merged_by_slug, merged_by_domain, merged_by_cross_link and queued. rows: reason and identity_id."""
    n = lambda *reasons: F.count_if(F.col("identity_id").isNotNull() & F.col("reason").isin(*reasons))
    return rows.agg(
        F.count("*").alias("processed"), n("stan_slug").alias("merged_by_slug"), n("personal_domain").alias("merged_by_domain"),
        n("cross_link_stan_slug", "cross_link_personal_domain").alias("merged_by_cross_link"), F.count_if(F.col("identity_id").isNull()).alias("queued"),
    )


def resolve_fast(accounts: DataFrame, order: str) -> DataFrame:
    """The same where each slug has one domain and each domain one slug: the first account of an anchor names the identity."""
    key = F.coalesce("slug", "domain")
    first = accounts.where(key.isNotNull()).groupBy(key.alias("anchor")).agg(F.min(order).alias("first_account"))
    return accounts.withColumn("anchor", key).join(first, "anchor", "left")


def candidate_identity(queued: DataFrame, linked: DataFrame) -> DataFrame:
    """queued (account, handle, platform) with the latest identity that has the handle on another platform, and the confidence in it.

    Of each handle only the latest identity of each platform can count, so accounts meet a handful of rows, however often a handle is linked.
    """
    latest = linked.groupBy("handle", F.col("platform").alias("__p")).agg(F.max(F.struct("created_at", "identity_id")).alias("__l"))
    by_handle = latest.groupBy("handle").agg(F.collect_list(F.struct("__p", "__l")).alias("__of"))
    other = F.filter("__of", lambda x: x["__p"] != F.coalesce("platform", F.lit("unknown")))
    best = F.array_max(F.transform(other, lambda x: x["__l"]))["identity_id"]
    found = queued.join(by_handle, "handle", "left").withColumn("candidate", best).drop("__of")
    return found.withColumn("confidence", F.when(F.col("candidate").isNotNull(), 0.55).otherwise(0.3))

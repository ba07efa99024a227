"""Registered queries: each applies operators to the given tables. The bindings stand in for the engine's own tables:
creators are customers, brands are nations, topics are names of parts bought, platform signals are events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce, text, urls
from .operators import brand, discovery, explorer, identity, importer, likeness, matching, ranking, scoring, social, upsert
from .plans import rules
from .sources.shared import dealt, stored
from .sources.tables import table
from .streaming import ingest

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def joined(xs: Column) -> Column:
    return F.array_join(xs, "|")


# The stand-ins.


def platform_of(event: Column) -> Column:
    return F.when(event == "view", "youtube").when(event == "click", "instagram").when(event == "purchase", "tiktok").when(event == "signup", "linkedin").otherwise("unknown")


def signals(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("creator"), "event_id", "ts", platform_of(F.col("event_type")).alias("platform"), F.floor(F.col("value") * 1000).cast("long").alias("followers"), F.col("value").alias("value"))


def measured(spark, d) -> DataFrame:
    """Platform metrics of each creator and platform, from events."""
    g = signals(spark, d).groupBy("creator", "platform").agg(F.max("followers").alias("followers"), F.count("*").alias("n"))
    return g.select("creator", "platform", F.col("followers").cast("double").alias("followers"), F.floor(F.col("followers") * 0.1 + F.col("n")).cast("double").alias("avg_views"), (F.col("n") * 0.003).alias("engagement_rate"), F.least(F.lit(0.95), 0.2 + F.col("n") * 0.05).alias("confidence"), F.col("n").cast("double").alias("sample_size"))


def bought(spark, d, key: str, known: DataFrame | None = None) -> DataFrame:
    """key, p_name, n: how often each part name was bought by a customer or nation. known: what customers bought, where that is stored."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    if known is not None:
        return known if key == "c_custkey" else known.join(c, "c_custkey").groupBy(key, "p_name").agg(F.sum("n").alias("n"))
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("o_custkey").alias("c_custkey"), "p_name")
    # A customer buys most names once: counting before rows are moved would spare none. Moved by customer, they are ranked where they are counted.
    rows = rows.join(c, "c_custkey") if key == "n_nationkey" else rows.repartition(key)
    return rows.groupBy(key, "p_name").agg(F.count("*").alias("n"))


def top_names(spark, d, key: str, k: int, known: DataFrame | None = None) -> DataFrame:
    best = ranking.top_k(bought(spark, d, key, known), [key], [F.desc("n"), F.col("p_name")], k)
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_name"))), lambda x: x["p_name"]).alias("topics"))


def creators(spark, d, known: DataFrame | None = None) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    m = measured(spark, d).groupBy("creator").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("platform"), F.struct("followers", "avg_views", "engagement_rate", "confidence", "sample_size"))))).alias("metrics"))
    rows = c.join(n, "c_nationkey").join(top_names(spark, d, "c_custkey", 6, known), "c_custkey", "left").join(m, c["c_custkey"] == m["creator"], "left")
    return rows.select(
        F.col("c_custkey").alias("creator_id"), F.lower("c_mktsegment").alias("niche"), "topics", F.array(F.lower("n_name"), F.lower("c_mktsegment")).alias("audience_types"),
        F.coalesce(F.array_sort(F.map_keys("metrics")), F.array().cast("array<string>")).alias("platforms"), "metrics", F.lit(None).cast("string").alias("primary_platform"), F.lit(0.5).alias("signal_confidence"),
        F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 50) / 1000.0).alias("estimated_engagement"),
    )


def brands(spark, d, known: DataFrame | None = None) -> DataFrame:
    c = table(spark, d, "customer")
    modal = ranking.latest(c.groupBy("c_nationkey", F.lower("c_mktsegment").alias("category")).agg(F.count("*").alias("n")), ["c_nationkey"], [F.desc("n"), F.col("category")]).select(F.col("c_nationkey").alias("n_nationkey"), "category")
    rows = table(spark, d, "nation").join(modal, "n_nationkey", "left").join(top_names(spark, d, "n_nationkey", 4, known), "n_nationkey", "left")
    k = F.col("n_nationkey")
    return rows.select(
        k.alias("brand_id"), "category", F.col("topics").alias("match_topics"), F.array(F.lower("n_name"), F.coalesce("category", F.lit(""))).alias("target_audience"),
        F.array(F.element_at(F.lit(["sales", "community", "ugc awareness", "lead demo pipeline"]), k % 4 + 1)).alias("goals"), F.array().cast("array<string>").alias("campaign_angles"),
        F.when(k % 3 == 0, F.lit(["youtube", "tiktok"])).when(k % 3 == 1, F.lit(["instagram"])).otherwise(F.lit(["linkedin", "youtube", "x"])).alias("preferred_platforms"),
        F.array("category").alias("priority_niches"), F.slice("topics", 1, 1).alias("priority_topics"),
    )


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """brands and creators, for which lineitem is joined once."""
    known = stored(bought(spark, d, "c_custkey"), "bought")
    return brands(spark, d, known), creators(spark, d, known)


def pairs(spark, d) -> DataFrame:
    return scoring.score_all(*sides(spark, d))


# Scoring.


@query
def score_niche_affinity(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.element_at(F.lit(["building", "auto mobile", "machinery tools", "household", "furniture shop", ""]), F.col("n_nationkey") % 6 + 1).alias("category"))
    c = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("niche"))
    m = scoring.niche_affinity(F.col("a"), F.col("b"))
    n, c = n.withColumn("a", scoring.term(text.phrase("category"))), c.withColumn("b", scoring.term(text.phrase("niche")))
    return c.crossJoin(F.broadcast(n)).select("n_nationkey", "c_custkey", m["score"].alias("score"), m["confidence"].alias("confidence"))  # 25 nations


@query
def score_topic_similarity(spark, d):
    p = pairs(spark, d)
    return p.select("brand_id", "creator_id", coerce.round_half_up("modules.topic.score", 6).alias("score"), coerce.round_half_up("modules.topic.confidence", 6).alias("confidence"))


@query
def score_audience_fit(spark, d):
    p = pairs(spark, d)
    return p.select("brand_id", "creator_id", coerce.round_half_up("modules.audience.score", 6).alias("score"), coerce.round_half_up("modules.audience.confidence", 6).alias("confidence"))


@query
def score_platform_alignment(spark, d):
    p = pairs(spark, d)
    return p.select("brand_id", "creator_id", coerce.round_half_up("modules.platform.score", 6).alias("score"), coerce.round_half_up("modules.platform.confidence", 6).alias("confidence"))


@query
def score_engagement_fit(spark, d):
    m = scoring.prepare_creators(creators(spark, d))
    return m.select("creator_id", coerce.round_half_up("__fit.score", 6).alias("score"), coerce.round_half_up("__fit.confidence", 6).alias("confidence"))


@query
def intent_vector(spark, d):
    docs = table(spark, d, "conversations")
    texts = coerce.distinct_texts(F.array(text.phrase(F.concat_ws(" ", F.lit("community lead sales"), "role", "text")), F.lit("brand awareness"), text.phrase(F.coalesce("text", F.lit("")))))
    v = docs.select("conv_id", "turn", scoring.intent_vector(texts).alias("v"))
    return v.select("conv_id", "turn", *[coerce.round_half_up(f"v.{k}", 6).alias(k) for k in rules.INTENT_KEYWORDS])


@query
def policy_blend_reweight(spark, d):
    b = scoring.prepare_brands(brands(spark, d)).select("brand_id", "__base")
    conf = {"niche": 0.95, "topic": 0.4, "platform": 0.675, "audience": 0.61, "engagement": 0.0}
    modules = F.struct(*[F.struct(F.lit(1.0).alias("score"), F.lit(conf[m]).alias("confidence")).alias(m) for m in rules.MODULES])
    w = b.withColumn("m", modules).withColumn("w", scoring.trusted_weights(F.col("__base"), F.col("m")))
    return w.select("brand_id", *[coerce.round_half_up(f"__base.{m}", 6).alias(f"base_{m}") for m in rules.MODULES], *[coerce.round_half_up(f"w.{m}", 6).alias(f"weight_{m}") for m in rules.MODULES])


@query
def priority_boost_top3(spark, d):
    p = dealt(table(spark, d, "part").select("p_partkey", text.phrase("p_name").alias("name"), text.phrase("p_type").alias("type")))
    wanted = spark.range(1).select(scoring.terms(F.lit(["small ring", "ring", "large bolt", "economy", "promo gear"])).alias("wanted"))  # one row
    likes = scoring.best_of(F.col("wanted"), scoring.terms(F.array("name", "type")), scoring.term_similarity)
    b = p.crossJoin(F.broadcast(wanted)).withColumn("b", scoring.priority_boost(F.col("wanted"), likes))
    return b.select("p_partkey", coerce.round_half_up("b.boost", 6).alias("boost"), joined(F.col("b.matched")).alias("matched"))


@query
def phrase_likeness(spark, d):
    """Part names against types with a name's first word, by all three measures: the pairs alike by 0.34 or more, out of joins."""
    p = table(spark, d, "part")
    kinds = F.explode(F.lit(list(likeness.MEASURES))).alias("kind")
    left, right = p.select(kinds, text.phrase("p_name").alias("phrase")), p.select(kinds, text.phrase(F.concat_ws(" ", F.split("p_name", " ")[0], "p_type")).alias("phrase"))
    found = likeness.alike_by(left, right, "kind", {m: m for m in likeness.MEASURES}, 0.34)
    return found.select("kind", "a", "b", coerce.round_half_up("likeness", 6).alias("likeness"))


@query
def match_total_top12(spark, d):
    p = matching.top_matches(*sides(spark, d), "brand_id", "creator_id", 12)
    return p.select("brand_id", "creator_id", F.col("rank").cast("long").alias("rank"), "total", joined(F.col("reasons")).alias("reasons"), "best_platform")


# Relational surface.


@query
def match_upsert_keeps_status(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_totalprice < 200000").select("o_orderkey", F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"))
    new = o.where("o_totalprice >= 100000").select("o_orderkey", (F.col("o_totalprice") * 2).alias("score"), F.lit("new").alias("status"))
    return upsert.upsert(old, new, ["o_orderkey"], keep=("status",))


@query
def pool_cascade(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("at"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("at"))
    best = c.agg(F.max("at").alias("m"))  # one row
    pools = [("pipeline", c.join(F.broadcast(best), F.col("at") > F.col("m")).drop("m")), ("identity", s.where("at < 0")), ("all", c)]
    order = [F.desc_nulls_last("at"), F.col("id")]
    fallen, asked = ranking.pool_cascade(pools, order), ranking.pool_cascade(pools, order, scope="all")
    return fallen.withColumn("run", F.lit("fallen")).unionByName(asked.withColumn("run", F.lit("asked"))).select("run", "pool", "id", "at")


@query
def unlinked_anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query
def not_exists_import(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").where(F.coalesce("c_acctbal", F.lit(0)) >= 0.35).select("c_custkey", "c_acctbal")


@query
def exists_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_mktsegment")


@query
def exists_mark_column(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("m")).distinct()
    return c.join(o, "c_custkey", "left").select("c_custkey", F.col("m").isNotNull().alias("already_imported"))


@query
def cross_platform_handle_candidate(spark, d):
    e = signals(spark, d)
    queued = e.where("event_id % 10 = 0").select(F.col("event_id").alias("account"), F.col("creator").alias("handle"), "platform")
    linked = e.where("event_id % 10 <> 0").select(F.col("creator").alias("handle"), "platform", F.col("event_id").alias("identity_id"), F.col("ts").alias("created_at"))
    return identity.candidate_identity(queued, linked).select("account", "handle", "platform", "candidate", "confidence")


@query
def import_agg_cte(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    lists = importer.linked_accounts(o, "o_custkey", {"statuses": "o_orderstatus", "priorities": "o_orderpriority"})
    m = importer.platform_metrics(measured(spark, d), "creator", "platform", ["followers", "sample_size"], "confidence")
    rows = c.join(lists, c["c_custkey"] == lists["o_custkey"], "left").join(m, c["c_custkey"] == m["creator"], "left")
    shown = F.transform(F.map_entries("metrics"), lambda e: F.concat_ws(":", e["key"], e["value"]["followers"].cast("long"), e["value"]["sample_size"].cast("long")))
    return rows.select("c_custkey", joined("statuses").alias("statuses"), joined("priorities").alias("priorities"), joined(shown).alias("metrics"), coerce.round_half_up("confidence", 6).alias("confidence"))


@query
def group_platform_signals(spark, d):
    return social.group_signals(signals(spark, d), ["creator"], "platform", "followers")


@query
def coverage_report(spark, d):
    p = table(spark, d, "pages").select(F.when(F.col("page_id") % 4 == 0, "TikTok").when(F.col("page_id") % 4 == 1, "youtube").when(F.col("page_id") % 4 == 2, "x").alias("platform"), F.when(F.col("url").contains("utm"), F.col("url")).alias("slug"))
    return explorer.coverage(p, "platform", F.col("slug"))


@query
def extraction_stats(spark, d):
    k = F.col("page_id")
    found = F.when(k % 4 == 0, F.concat(F.lit("see https://stan.store/Some.Page."), k)).when(k % 4 == 1, F.concat(F.lit("1,20"), k % 10, F.lit(" followers"))).when(k % 4 == 2, "nothing").otherwise("stan.store/Both, 12.5k subs")
    p = odd_urls(spark, d).withColumn("url", F.when(k % 11 == 0, F.lit("no url")).otherwise(F.col("url")))
    rows = discovery.normalize(p, "url", F.lit("t"), F.lit(None).cast("string"))
    return discovery.extraction_stats(p, discovery.extract(rows, found))


@query
def page_stats_global(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query
def explorer_union_priority(spark, d):
    c = table(spark, d, "customer").select(F.lit("real").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("at"), F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.lit("none")).alias("label"))
    s = table(spark, d, "supplier").select(F.lit("synthetic").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("at"), F.lit("supplier").alias("label"))
    return ranking.union_by_priority([s, c], [F.desc_nulls_last("at"), F.col("id")], 500)


@query
def explorer_search_filter(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.where(explorer.matches_search("BUILD", F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"), F.col("n_name"))).select("c_custkey", "c_name", "n_name")


@query
def niche_group_histogram(spark, d):
    names = F.element_at(F.lit(["fitness", "ai tools", "pets", "b2b saas", "travel", "skincare", "home & decor", "unheard of"]), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = table(spark, d, "part").select(explorer.niche_group(names).alias("niche_group"))
    return explorer.zero_filled(p, "niche_group", [g for g, _ in rules.NICHE_GROUPS])


@query
def available_platforms(spark, d):
    return explorer.zero_filled(signals(spark, d), "platform", ["instagram", "tiktok", "youtube", "x", "linkedin"]).where("n > 0").select("position", "platform")


@query
def est_price_budget_filter(spark, d):
    m = measured(spark, d).groupBy("creator").agg(F.collect_list("avg_views").alias("views"), F.collect_list("followers").alias("followers"))
    c = table(spark, d, "customer")
    niche = F.element_at(F.lit(["fitness", "personal finance", "b2b saas", "beauty", "ecommerce", "pets"]), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = c.join(m, c["c_custkey"] == m["creator"]).select("c_custkey", niche.alias("niche"), explorer.positive_mean(F.col("views")).alias("avg_views"), explorer.positive_total(F.col("followers")).alias("followers_total"))
    priced = rows.withColumn("price", explorer.price(F.col("niche"), F.col("avg_views")))
    return priced.where(explorer.within_budget(F.col("price"), 500)).select("c_custkey", "niche", F.col("avg_views").cast("long").alias("avg_views"), F.col("followers_total").cast("long").alias("followers_total"), "price")


# URLs and text.


def odd_urls(spark, d) -> DataFrame:
    """Page URLs, and profile URLs made from their parts."""
    p = table(spark, d, "pages")
    k = F.col("page_id") % 10
    forms = ["https://www.instagram.com/p/a%d", "https://www.tiktok.com/@a%d/video/1", "https://uk.linkedin.com/in/jo-%d", "https://twitter.com/Home", "https://x.com/u_%d?si=1", "https://youtu.be/v%d", "https://www.youtube.com/watch?v=q%d&t=3", "https://m.youtube.com/@c%d#about", "https://www.youtube.com/channel/UC%d"]
    made = None
    for i, f in enumerate(forms):
        value = F.concat(F.lit(f.split("%d")[0]), F.col("page_id"), F.lit(f.split("%d")[1])) if "%d" in f else F.lit(f)
        made = F.when(k == i, value) if made is None else made.when(k == i, value)
    return p.select("page_id", made.otherwise(F.col("url")).alias("url"), F.col("url").alias("page_url"))


@query
def url_platform_detect(spark, d):
    return odd_urls(spark, d).select("page_id", urls.host("url").alias("host"), urls.platform(urls.host("url")).alias("platform"))


@query
def url_normalize(spark, d):
    return odd_urls(spark, d).select("page_id", "url", urls.profile("url").alias("profile"))


@query
def url_handle(spark, d):
    return odd_urls(spark, d).withColumn("profile", urls.profile("url")).select("page_id", urls.handle("profile").alias("handle"))


@query
def url_canonicalize(spark, d):
    u = odd_urls(spark, d)
    return u.select("page_id", urls.canonical("url").alias("canonical"), urls.canonical(F.concat("page_url", F.lit("#top"))).alias("page_canonical"), urls.canonical("page_url", whole_utm=True).alias("page_stripped"))


@query
def url_brand_name(spark, d):
    return table(spark, d, "pages").select("page_id", urls.brand_name("url").alias("brand"), urls.is_page("url").alias("is_page"), urls.is_search_host("url").alias("is_search"))


@query
def serp_dedup_caps(spark, d):
    p = table(spark, d, "pages").withColumns({"agent": F.concat(F.lit("a"), F.col("page_id") % 3), "query": F.concat(F.lit("q"), F.col("page_id") % 7)})
    keep = discovery.fits_plan(F.col("url"), F.lower("url"), ("example.com", "example.org"), "", ("e",))
    kept = discovery.accept(p, "url", "agent", "query", "page_id", keep & urls.is_page("url"), 10, 20)
    return kept.select("page_id", "agent", "query", F.col("rank").cast("long").alias("rank"))


@query
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_title("html").alias("title"))


@query
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.html_to_text("html")).alias("text_md5"), F.length(text.html_to_text("html")).cast("long").alias("n"))


@query
def html_links_interesting(spark, d):
    k = F.col("page_id")
    own = F.when(k % 3 == 0, F.concat(F.lit('<a class=c href=\'/company?p='), k, F.lit("'>c</a>"))).when(k % 3 == 1, F.concat(F.lit('<a href="/pricing">again</a>'))).otherwise("")
    first = F.when(k % 3 != 2, F.lit("<a href='/pricing'>p</a>")).otherwise("")
    page = F.concat(first, F.when(k % 3 == 1, F.concat(F.lit('<a href="about-'), k, F.lit('">a</a>'))).otherwise(""), F.lit('<a href="/legal/about">l</a><a href="http://other.example.com/blog">o</a><a href="/blog#x">b</a>'), own, F.col("html"))
    return table(spark, d, "pages").select("page_id", joined(discovery.interesting_links(page, F.col("url"))).alias("links"))


@query
def bot_challenge_flag(spark, d):
    page = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("Attention Required! | Cloudflare"))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", discovery.looks_challenged(page).alias("challenged"))


@query
def text_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(F.array_sort(text.emails("text"))).alias("emails"))


@query
def text_money(spark, d):
    said = F.concat("text", F.lit(" $ 1,200.50 or $1,200.50 and $9"))
    return table(spark, d, "documents").select("doc_id", joined(F.array_sort(text.prices(said))).alias("prices"))


def talk(spark, d) -> DataFrame:
    """Conversations with a few words put before each text, so that the rules have something to find."""
    words = ["Book a call about coaching", "buy my course and template", "join the community newsletter", "DM me", "a guide for gym beginners", "ugc service, $1,500 per video", "nothing here", "cpm deal on tiktok and youtube for awareness"]
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.concat(F.element_at(F.lit(words), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")), F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))


@query
def cta_style(spark, d):
    return talk(spark, d).select("conv_id", "turn", text.cta_style("text").alias("baseline"), text.cta_style("text", "page").alias("page"))


@query
def product_types(spark, d):
    return talk(spark, d).select("conv_id", "turn", joined(text.product_types("text")).alias("baseline"), joined(text.product_types("text", "page")).alias("page"))


@query
def offer_candidates(spark, d):
    t = talk(spark, d)
    return t.select("conv_id", "turn", joined(text.offer_candidates(F.concat(F.lit('<a href="#">my <b>course</b></a>'), "text"), F.replace("text", F.lit(". "), F.lit("\n")))).alias("offers"))


@query
def bio_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.bio("text").alias("bio"))


@query
def follower_count_parse(spark, d):
    p = table(spark, d, "part")
    said = F.concat(F.col("p_name"), F.lit(" has "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".5k+ followers").when(F.col("p_partkey") % 3 == 1, ",200 subscribers").otherwise("m views"), F.lit(" and 3 subs"))
    return p.select("p_partkey", text.follower_count(said).alias("first"), text.most_followers(said).alias("most"))


@query
def keyword_rules_niche(spark, d):
    known = (F.size(text.prices("text")) > 0, F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 == 0)
    n = importer.compatibility(talk(spark, d).withColumn("cta", text.cta_style("text")), "text", "cta", *known)
    return n.select("conv_id", "turn", "niche", "niche_confidence", joined("topics").alias("topics"), joined("audiences").alias("audiences"), joined("products").alias("products"), joined("intents").alias("intents"), "selling_style", "content_style", "buying_intent")


@query
def store_confidence(spark, d):
    t = talk(spark, d)
    has = {"offers": F.size(text.offer_candidates(F.lit(""), F.col("text"))) > 0, "prices": F.size(text.prices("text")) > 0, "types": F.size(text.product_types("text")) > 0, "email": F.size(text.emails("text")) > 0, "socials": F.contains("text", F.lit("tiktok"))}
    return t.select("conv_id", "turn", importer.store_confidence("baseline", **has).alias("baseline"), importer.store_confidence("page", **has).alias("page"))


# Social, identity and the rest.


@query
def social_signal_estimate(spark, d):
    g = social.group_signals(signals(spark, d), ["creator"], "platform", "followers").where(social.enough_followers(F.col("followers"), 100))
    s = g.withColumn("s", social.social_signal(F.col("platform"), F.col("followers"), F.col("signal_count"), F.col("creator") % 2 == 0))
    return s.select("creator", "platform", "s.*")


@query
def weighted_engagement(spark, d):
    m = measured(spark, d)
    a = social.weighted_rate(m, ["creator"], "engagement_rate", "followers", "confidence", "enrich").withColumnRenamed("engagement", "enriched")
    return a.join(social.weighted_rate(m, ["creator"], "engagement_rate", "followers", "confidence", "import").withColumnRenamed("engagement", "imported"), "creator")


@query
def primary_platform_argmax(spark, d):
    return social.primary_platform(measured(spark, d), ["creator"], "platform", social.primary_score(F.col("avg_views"), F.col("followers"), F.col("confidence")))


def accounts(spark, d) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.when(F.col("page_id") % 3 != 0, F.get(urls.path_parts("url"), F.lit(1))).alias("slug"), F.when(F.col("page_id") % 5 != 0, identity.personal_domain(urls.host("url"))).alias("domain"))


@query
def identity_resolve_fast(spark, d):
    slug = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("s"), F.floor(F.col("page_id") / 2)))
    a = accounts(spark, d).select("page_id", slug.alias("slug"), "domain")
    return identity.resolve_fast(a, "page_id").select("page_id", "anchor", "first_account")


@query
def identity_resolve_fold(spark, d):
    return identity.resolve(accounts(spark, d), "page_id").select("page_id", "slug", "domain", "identity_id")


@query
def latest_per_key(spark, d):
    return ranking.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query
def first_wins_dedup(spark, d):
    return ranking.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query
def move_rows_between_tables(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    target = c.where("id % 4 = 0").withColumn("origin", F.lit("old"))
    left, right = upsert.move(c.withColumn("origin", F.lit(None).cast("string")), target, F.col("balance") < 0, "id", "origin", "migrated_from_creators")
    return left.withColumn("side", F.lit("source")).unionByName(right.withColumn("side", F.lit("target"))).select("side", "id", "balance", "origin")


@query
def brand_page_bundle(spark, d):
    b = brand.page_bundle(table(spark, d, "documents"), "source", "doc_id", "text", 8_000, 6)
    return b.select("source", F.md5("bundle").alias("bundle_md5"), F.length("bundle").cast("long").alias("n"))


@query
def brand_dossier_merge(spark, d):
    s = table(spark, d, "supplier")
    old = s.select(F.col("s_suppkey").alias("id"), F.array(F.lit("Sales"), F.col("s_name")).alias("goals"), F.concat(F.lit("About "), "s_name").alias("summary"))
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.array(F.lit("sales"), F.lit(" reach "), F.lit("")).alias("goals"))
    m = brand.merge_dossier(old, new, "id", ["goals"], "summary", "Supplier#000000001")
    return m.select("id", joined("goals").alias("goals"), "summary")


@query
def intent_parse_free_text(spark, d):
    i = brand.intent(talk(spark, d), "text")
    return i.select("conv_id", "turn", "partnership", "compensation", "unit", "amount", "open_budget", joined("goals").alias("goals"), joined("platforms").alias("platforms"))


@query
def coalesce_order_limit(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    last = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("a"))
    return c.join(last, "c_custkey", "left").withColumn("at", F.coalesce("a", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")))).orderBy(F.desc_nulls_first("at"), "c_custkey").limit(200).select("c_custkey", "at")


@query
def session_events(spark, d):
    return ingest.windowed_counts(table(spark, d, "events"), "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", coerce.round_half_up("total", 4).alias("total"))


"""Registered queries of the flows: ingest, extraction, resolution, enrichment, import, serving and chat.

The bindings stand in for the engine's own tables, as in queries.py.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import coerce, text, urls
from .operators import brand, crawl, discovery, enrich, explorer, harvest, identity, importer, paging, ranking, scoring, serving, upsert
from .plans import rules
from .queries import accounts, brands, creators, joined, measured, odd_urls, pairs, signals
from .sources import snapshots, tables
from .sources.shared import file_system, scratch
from .sources.tables import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def pick(number: Column, values: list[str | None]) -> Column:
    """The value at number modulo how many there are."""
    out = None
    for i, v in enumerate(values):
        held = number % len(values) == i
        out = F.when(held, F.lit(v)) if out is None else out.when(held, F.lit(v))
    return out


def arrays(number: Column, *values: Column) -> Column:
    out = None
    for i, v in enumerate(values):
        held = number % len(values) == i
        out = F.when(held, v) if out is None else out.when(held, v)
    return out


def listed(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]).cast("array<string>")


# Filters and joins of the pages.


@query
def filtered_accounts(spark, d):
    ids = [f" {i} " for i in range(40)] + ["5", "", "x"]
    return serving.filtered(signals(spark, d), {"platform": "instagram", "creator": None}, {"creator": ids, "event_id": None}, {"value": 12.349}).select("event_id", "creator", "value")


@query
def filtered_by_many_ids(spark, d):
    """More ids than a list in the filter should hold: they become a semi join."""
    ids = [f" {i}" for i in range(0, 900, 2)] + ["", "x", "4"]
    return serving.filtered(signals(spark, d), {"platform": "youtube"}, {"event_id": ids}).select("event_id", "creator", "value")


@query
def exists_either(spark, d):
    """Customers that one of two correlated subqueries knows."""
    c, o, e = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "events")
    urgent = o.where((F.col("o_custkey") == F.col("c_custkey").outer()) & (F.col("o_orderpriority") == "1-URGENT"))
    bought = e.where((F.col("user_id") == F.col("c_custkey").outer()) & (F.col("event_type") == "purchase"))
    return c.where(urgent.exists() | bought.exists()).select("c_custkey", "c_mktsegment")


def store_fetches(spark, d) -> tuple[DataFrame, DataFrame]:
    """Identities with slugs as people write them, and the fetches of their store pages, some of which have failed."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    ids = p.select(k.alias("identity_id"), F.when(k % 9 == 4, F.lit(" / ")).when(k % 2 == 0, F.concat(F.lit(" /Store-"), k, F.lit("/ "))).otherwise(F.concat(F.lit("store-"), k)).alias("slug"))
    failed = F.when(k % 7 == 0, F.lit("HTTP 404"))
    fetched = p.where(k % 11 > 0).select(F.concat(F.lit("store-"), k).alias("slug"), F.concat(F.lit("https://stan.store/store-"), k).alias("url"), F.when(failed.isNull(), F.coalesce("html", F.lit(""))).alias("html"), failed.alias("error"))
    return ids, fetched


@query
def store_enrich_results(spark, d):
    return enrich.store_results(*store_fetches(spark, d)).select("identity_id", "slug", "status", "reason")


@query
def store_enrich_stats(spark, d):
    return enrich.store_stats(enrich.store_results(*store_fetches(spark, d)))


@query
def pending_or_forced(spark, d):
    c, done = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return serving.pending(c, done, "c_custkey").withColumn("run", F.lit("plain")).unionByName(serving.pending(c, done, "c_custkey", force=True).withColumn("run", F.lit("forced")))


@query
def photo_fallback(spark, d):
    e = table(spark, d, "events")
    image = F.concat(F.lit('{"import_meta":{"stan_header_image_url":"img'), F.get_json_object("props", "$.k"), F.lit('"}}'))
    c = e.select("event_id", "user_id", arrays(F.col("event_id"), image, F.lit('{"import_meta":{"stan_header_image_url":""}}'), F.lit("{}")).alias("metrics"))
    profiles = e.where("user_id % 2 = 0").select("user_id").distinct().withColumn("image", F.concat(F.lit("p"), "user_id"))
    return serving.with_photo(c, profiles, "user_id").select("event_id", "photo")


def matched(spark, d) -> DataFrame:
    """Matches: an order is one, of a brand by the customer's number."""
    return table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("brand_id"), F.col("o_custkey").alias("creator_id"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("match_id"))


@query
def matches_page(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("creator_id"), "c_name", "c_mktsegment")
    return serving.matches_page(matched(spark, d), c, 3).select("match_id", "creator_id", "score", "c_name", "c_mktsegment")


@query
def dashboard_join(spark, d):
    b = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("brand_id"), F.col("n_name").alias("brand_name"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("creator_id"), F.col("c_name").alias("creator_name"))
    return serving.dashboard(matched(spark, d), b, c, 7)


@query
def linked_count(spark, d):
    e, c = table(spark, d, "events"), table(spark, d, "customer")
    return e.join(c, e["user_id"] == c["c_custkey"]).agg(F.count("*").alias("linked"))


@query
def brands_to_match(spark, d):
    b = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("brand_id"), (F.col("n_nationkey") % 5 == 0).alias("refresh"))
    m = table(spark, d, "customer").where("c_acctbal > 9700").select(F.col("c_nationkey").cast("long").alias("brand_id"), "c_custkey")
    kept = serving.without_refreshed(m, b).groupBy("brand_id").agg(F.count("*").alias("n"))
    return serving.to_match(b, m).select("brand_id", F.lit("match").alias("what"), F.lit(0).cast("long").alias("n")).unionByName(kept.select("brand_id", F.lit("kept").alias("what"), "n"))


@query
def reason_shapes(spark, d):
    k = F.get_json_object("props", "$.k")
    shape = arrays(F.col("event_id"), F.concat(F.lit('["a","b'), k, F.lit('"]')), F.concat(F.lit('{"reasons":["x","y"],"breakdown":{"n":'), k, F.lit("}}")), F.lit("not json"), F.lit('{"other":1}'), F.lit(None).cast("string"))
    e = table(spark, d, "events").select("event_id", serving.reasons_of(shape).alias("r"))
    return e.select("event_id", joined("r.reasons").alias("reasons"), F.get_json_object("r.breakdown", "$.n").alias("n"))


@query
def match_breakdown(spark, d):
    p = scoring.breakdown(pairs(spark, d))
    return p.select("brand_id", "creator_id", "breakdown.*")


@query
def match_spec(spark, d):
    s = scoring.match_spec(brands(spark, d))
    return s.select("brand_id", joined("topics").alias("topics"), joined("audiences").alias("audiences"), joined("priorities").alias("priorities"), coerce.round_half_up("evidence_confidence", 6).alias("evidence_confidence"), "specificity")


@query
def explorer_search(spark, d):
    p = table(spark, d, "part")
    rows = p.select(
        "p_partkey", "p_name", F.element_at(F.lit(["fitness", "ai tools", "pets", "b2b saas", "travel", "skincare", "home & decor", "unheard of"]), (F.col("p_partkey") % 8 + 1).cast("int")).alias("niche"),
        arrays(F.col("p_partkey"), listed("youtube"), listed("x", "youtube"), listed()).alias("platforms"), F.array("p_type", "p_brand").alias("topics"),
    )
    found = explorer.search(rows, "youtube", "Technology", " SMALL ", blob=("p_name", "niche", "platforms", "topics"))
    return found.select("p_partkey", "niche")


@query
def explorer_page(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return ranking.page_of(c, [F.desc("c_acctbal"), F.col("c_custkey")], page=3)


@query
def explorer_pages_by_range(spark, d):
    """The third page and the hundredth, from a table that is stored in ranges of its order."""
    c, order = table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")]
    path = scratch(spark, "ranges")
    paging.store_ranges(c, order, path, 8)
    pages = [paging.page_of_ranges(spark, path, order, n).withColumn("page", F.lit(n).cast("long")) for n in (3, 100)]
    return pages[0].unionByName(pages[1])


@query
def published_move(spark, d):
    """Both tables of a move, published at one point in time and read back."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    root = scratch(spark, "published")
    snapshots.publish(spark, root, {"source": c.withColumn("origin", F.lit(None).cast("string")), "target": c.where("id % 4 = 0").withColumn("origin", F.lit("old"))})
    left, right = upsert.move(snapshots.read(spark, root, "source"), snapshots.read(spark, root, "target"), F.col("balance") < 0, "id", "origin", "migrated_from_creators")
    snapshots.publish(spark, root, {"source": left, "target": right})
    sides = [snapshots.read(spark, root, side).select(F.lit(side).alias("side"), "id", "balance", "origin") for side in ("source", "target")]
    return sides[0].unionByName(sides[1])


@query
def budget_ranked(spark, d):
    p = table(spark, d, "part").where(explorer.within_budget(F.col("p_retailprice"), 950.0))
    return p.select("p_partkey", F.col("p_size").alias("score"), "p_retailprice").orderBy(F.desc("score"), "p_partkey").limit(60)


@query
def deck_selection(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", pick(F.col("n_nationkey"), ["what is your budget", "the best creators", "why these", "hello", "price?"]).alias("said"), arrays(F.col("n_nationkey"), F.lit(1000.0), F.lit(None).cast("double"), F.lit(-2000.0)).alias("budget"))
    ranked = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.col("c_acctbal").alias("price"))
    return ranking.decks(n, ranked, "n_nationkey", "said", "budget", [F.desc("price"), F.col("c_custkey")], "price").select("n_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query
def deck_history(spark, d):
    e = table(spark, d, "events").select("user_id", (F.floor("value") % 20).cast("long").alias("deck"), F.col("event_id").alias("at"))
    return ranking.deck_history(e, "user_id", "deck", "at").select("user_id", "deck", "at", F.col("place").cast("long").alias("place"))


@query
def ordered_merge(spark, d):
    """Two lists of URLs, the first list's rows going before the second's."""
    p = table(spark, d, "pages").select("page_id", urls.canonical("url").alias("url"))
    first, second = p.where("page_id % 3 = 0"), p.withColumn("url", F.when(F.col("page_id") % 4 == 0, F.lit("https://same.example.com/")).otherwise(F.col("url")))
    rows = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    return ranking.latest(rows, ["url"], [F.col("list"), F.col("page_id")]).select("url", "list", "page_id")


@query
def two_key_order(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey").limit(300).select("o_orderkey", "o_totalprice")


@query
def point_lookup(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("lookup_customer")
    return tables.query(spark, "SELECT c_custkey, c_name, c_nationkey FROM lookup_customer WHERE c_custkey = :id OR c_name = :name", id=17, name="Customer#000000023")


@query
def table_writes(spark, d):
    """Updates and deletes by a condition, and rows without a parent gone."""
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), table(spark, d, "nation").where("n_nationkey < 20")
    changed = upsert.update_where(c, F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lower("c_mktsegment")})
    return upsert.cascade(upsert.delete_where(changed, F.col("c_mktsegment") == "BUILDING"), n, "c_nationkey", "n_nationkey")


@query
def seed_upsert(spark, d):
    """Seeds of two files put into their target's table in the shared folder, and read back."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name", "s_acctbal")
    folder = scratch(spark, "seeds")
    tables.seed_sink(spark, folder, s.where("s_acctbal > 0"), "real")
    name = tables.seed_sink(spark, folder, s.where("s_acctbal < 5000").withColumn("s_name", F.concat(F.lit("new "), "s_name")), " Creators")
    return snapshots.read(spark, folder, name).withColumn("target", F.lit(name))


@query
def seed_scan(spark, d):
    """Two files of seeds, whose arrays nest, in the shared folder: the first file's row of an id counts, rows without a niche go."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 7 > 0, F.lit("pets")).alias("niche"), "s_acctbal")
    folder = scratch(spark, "seed-files")
    paths = []
    for name, rows, form in (("a", s.where("s_acctbal > 3000"), "[[%s]]"), ("b", s.withColumn("name", F.concat(F.lit("b "), "name")), "[%s, []]")):
        held = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name", "niche")))).alias("j"))
        held.select(F.format_string(form, F.col("j")).alias("value")).coalesce(1).write.text(f"{folder}/{name}")
        system, place = file_system(spark, f"{folder}/{name}")
        paths += [x.getPath().toString() for x in system.listStatus(place) if x.getPath().getName().startswith("part-")]
    return tables.seeds(spark, paths).select("id", "name", "niche")


# Discovery and extraction.


@query
def serp_ingest(spark, d):
    u = odd_urls(spark, d).withColumn("query", F.concat(F.lit("q"), F.col("page_id") % 7))
    href = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/url?q="), F.url_encode("url"), F.lit("&sa=U"))).when(F.col("page_id") % 9 == 1, F.lit("not a url")).otherwise(F.col("url"))
    one = F.struct(F.col("page_id"), F.struct(F.lit("t").alias("title"), F.lit(None).cast("string").alias("snippet"), href.alias("url"), F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("int") + 100).alias("position"), F.lit(None).cast("string").alias("raw")).alias("r"))
    payloads = u.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("results")).withColumn("run", F.lit("r"))
    empty = spark.createDataFrame([], "id string, run string, query string, url string, position int, platform string, profile_url string, handle string")
    return discovery.ingest(empty, payloads).select("id", "query", "url", "position", "platform", "profile_url", "handle")


@query
def plan_acceptance(spark, d):
    k = F.col("page_id")
    made = [F.concat(F.lit(f), k) for f in ("https://x.com/u", "https://www.instagram.com/u", "https://uk.linkedin.com/in/u", "https://linkedin.com/company/u", "https://www.tiktok.com/@u", "https://youtu.be/u", "https://example.com/u")]
    p = table(spark, d, "pages").select("page_id", pick(k, [x[0] for x in rules.PLANS]).alias("agent"), F.concat(F.lit("q"), k % 3).alias("query"), arrays(F.floor(k / 5).cast("long"), *made).alias("url"))
    blob = F.concat(F.lower("url"), F.when(k % 4 != 0, F.lit(" at stan.store/u")).otherwise(" elsewhere"))
    return discovery.accept_by_plan(p, "url", "agent", "query", "page_id", blob).select("page_id", "agent", "query", F.col("rank").cast("long").alias("rank"))


@query
def query_groups(spark, d):
    p = table(spark, d, "pages").withColumn("q", F.concat(F.lit(" "), F.when(F.col("page_id") % 6 > 0, F.concat(F.lit("q"), F.col("page_id") % 6)).otherwise(""), F.lit(" ")))
    return discovery.grouped_by_query(p.withColumn("u", F.get(F.split("url", "/"), F.lit(2))), "q", "u", "page_id")


@query
def crawl_summary(spark, d):
    p = table(spark, d, "pages").select(F.get(F.split("url", "/"), F.lit(2)).alias("u"), (F.col("page_id") % 5).alias("agent"), (F.col("page_id") % 12).alias("query"), (F.col("page_id") % 7 == 0).alias("blocked"))
    return discovery.crawl_summary(p, "u", "agent", "query", "blocked")


def said(number: Column) -> Column:
    """Texts of an account, of several kinds."""
    return arrays(
        number, listed("see https://stan.store/Some.Page. and stan.store/some.page", "12.5k followers, 3 subs and 1,200 Subscribers"), listed("Jo (@jo_1) on X", "x · other_h 2m subs"),
        listed("https://www.instagram.com/Reels/ https://instagram.com/Jo.B/ @jo.b", "https://youtube.com/channel/UC1 https://twitter.com/i/ https://www.twitter.com/Jo_T"), listed("linkedin.com/in/al-b and https://uk.linkedin.com/company/Co-1/", "nothing"),
        listed("https://www.tiktok.com/@tt.t instagram · ig_h", "a STAN.store/two, https://www.stan.store/three!"), listed(),
    )


@query
def text_store_links(spark, d):
    p = table(spark, d, "pages").select("page_id", harvest.store_slugs(said(F.col("page_id"))).alias("s"), harvest.follower_mentions(said(F.col("page_id"))).alias("m"))
    return p.select("page_id", joined("s").alias("slugs"), F.col("m.count").alias("followers"), F.size("m.mentions").cast("long").alias("mentions"))


@query
def text_profiles(spark, d):
    p = table(spark, d, "pages").select("page_id", said(F.col("page_id")).alias("t"))
    kinds = list(rules.PROFILE_LINKS)
    rows = p.select("page_id", "t", F.explode(listed(*kinds)).alias("kind"))
    return rows.select("page_id", "kind", harvest.profile_in(F.col("t"), F.col("kind")).alias("profile"), harvest.handle_in(F.col("t"), F.col("kind")).alias("handle"))


@query
def extraction_assembly(spark, d):
    k = F.col("page_id")
    texts = F.when(k % 2 == 0, listed("Jo (@jo_1) has 12.5k followers", F.concat(F.lit("https://stan.store/S"), k))).otherwise(listed("nothing"))
    rows = odd_urls(spark, d).select("page_id", "url", F.lit("x").alias("platform"), texts.alias("texts"))
    out = harvest.assemble(rows, "url", "platform", "texts")
    return out.select("page_id", "kind", "store_slug", "followers", "profile_url", "handle", "instagram_handle", joined("signals").alias("signals"), "confidence")


@query
def json_text_leaves(spark, d):
    raw = F.concat(F.lit('{"a": ["x \\"q\\"", {"b": 5}], "c": true, "n": null, "d": {"e": {"f": {"g": {"h": "too deep"}}}}, "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, d, "events").select("event_id", joined(harvest.texts_of(F.lit(" t "), F.col("event_type"), raw=F.when(F.col("event_id") % 5 > 0, raw).otherwise("no json"))).alias("texts"))


@query
def handles_from_mentions(spark, d):
    k = F.col("page_id")
    t = arrays(k, F.concat(F.lit("Jo (@jo_"), k, F.lit(") and @al")), F.concat(F.lit("instagram · ig."), k), F.lit("see linkedin.com/company/Co-1 or linkedin.com/in/al-b"), F.lit("youtube.com/@chan-1 @x"), F.lit("no handle"))
    raw = arrays(k, F.lit("@@ok_1"), F.lit("a b"), F.lit("way_too_long_for_a_handle_of_x"), F.lit(" "), F.lit("a.b-c"))
    p = table(spark, d, "pages")
    return p.select("page_id", *[urls.mentioned_handle(t, x).alias(x) for x in urls.HANDLE_FORMS], *[urls.clean_handle(raw, F.lit(x)).alias(f"clean_{x}") for x in ("x", "youtube", "unknown")])


@query
def site_challenge(spark, d):
    page = F.concat("html", pick(F.col("page_id"), ["Cloudflare and captcha", "captcha", "are you human? Cloudflare", "bot protection, access denied"]))
    return table(spark, d, "pages").select("page_id", discovery.looks_challenged(page, marks=rules.SITE_CHALLENGE_MARKS).alias("site"), discovery.looks_challenged(page).alias("route"))


@query
def crawl_pages(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("brand_id"), F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id").alias("url"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("title"), "text", "doc_id")
    saved = docs.where("doc_id % 5 = 0").select("brand_id", "url", "title", F.lit("kept").alias("text"), F.lit(4).cast("long").alias("n"))
    return crawl.brand_pages(saved, docs, "doc_id").select("brand_id", "url", "title", "n", F.md5("text").alias("text_md5"))


@query
def store_pages(spark, d):
    k = F.col("page_id")
    html = F.concat(
        F.lit("<title>Jo "), k, F.lit(" (@@jo"), k, F.lit(") | Stan</title>"), F.when(k % 3 == 0, "<meta property='og:description' content='About me'>").otherwise(""), F.when(k % 4 == 0, '<meta name=x><meta content="i.png" property="og:image">').otherwise(""),
        F.lit('<a href="https://www.google.com/x">g</a><a href=https://instagram.com/jo>i</a><a href="/pricing">p</a><a href="https://me.stan.store/jo">s</a><a href="https://jo.example.com/a">j</a>'),
        F.when(k % 2 == 0, "<p>my coaching course for $1,200.50</p><p>or a guide for $9</p><p>a membership bundle</p>").otherwise("<p>hello there</p>"), F.when(k % 5 == 0, "<p>mail a@b.co</p>").otherwise(""),
    )
    s = crawl.store_pages(table(spark, d, "pages").select("page_id", F.lit("https://stan.store/jo").alias("url"), html.alias("html")))
    return s.select("page_id", "profile_name", "handle", "bio", joined("outbound").alias("outbound"), joined("socials").alias("socials"), joined("emails").alias("emails"), joined("prices").alias("prices"), joined("product_types").alias("types"), "cta", "image", F.size("offers").cast("long").alias("offers"), "confidence")


# Identities, enrichment, import.


@query
def identity_run(spark, d):
    """Two runs: accounts up to page 100, then the others, which know the anchors that the first has opened."""
    k = F.col("page_id")
    reason = F.when(F.col("slug").isNotNull(), F.when(k % 4 == 1, "cross_link_stan_slug").otherwise("stan_slug")).when(F.col("domain").isNotNull(), F.when(k % 4 == 2, "cross_link_personal_domain").otherwise("personal_domain")).otherwise("queued")
    a = accounts(spark, d).withColumns({"account": k.cast("string"), "handle": F.concat(F.lit("h"), k % 9), "platform": pick(k, ["x", "tiktok"]), "reason": reason})
    linked = table(spark, d, "events").select(F.concat(F.lit("h"), F.col("user_id") % 7).alias("handle"), pick(F.col("event_id"), ["x", "youtube"]).alias("platform"), F.concat(F.lit("ci_"), "event_id").alias("identity_id"), F.col("ts").alias("created_at"))
    first = identity.resolve_run(a.where("page_id <= 100"), "page_id", None, linked)
    runs = {"first": first, "second": identity.resolve_run(a.where("page_id > 100"), "page_id", first["known"], linked)}
    parts = []
    for name, run in runs.items():
        parts.append(run["links"].select(F.lit(name).alias("run"), "account", F.col("identity_id").alias("found"), F.lit(1.0).alias("confidence"), F.lit(None).cast("long").alias("n")))
        parts.append(run["queue"].select(F.lit(name).alias("run"), "account", F.col("candidate").alias("found"), "confidence", F.lit(None).cast("long").alias("n")))
        counts = F.array(*[F.struct(F.lit(c).alias("account"), F.col(c).alias("n")) for c in ("processed", "merged_by_slug", "merged_by_domain", "merged_by_cross_link", "queued", "created")])
        parts.append(run["stats"].select(F.explode(counts).alias("e")).select(F.lit(name).alias("run"), "e.account", F.lit(None).cast("string").alias("found"), F.lit(None).cast("double").alias("confidence"), "e.n"))
    return reduce(DataFrame.unionByName, parts)


def social_accounts(spark, d) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    ids = c.select(k.alias("identity_id"), arrays(k, listed("https://instagram.com/u", "https://example.org/", "no url"), listed(), listed("https://youtu.be/x"), listed()).alias("outbound"), (k % 3 == 0).alias("has_social"))
    rows = signals(spark, d).select(F.col("creator").alias("identity_id"), F.when(F.col("platform") == "instagram", " Insta ").otherwise(F.col("platform")).alias("platform"), F.col("followers").cast("double").alias("followers"), F.lit(1).alias("signal_count"))
    return ids, rows


@query
def enrich_results(spark, d):
    ids, rows = social_accounts(spark, d)
    return enrich.results(ids, enrich.candidates(ids, rows), 30_000)


@query
def enrich_stats(spark, d):
    ids, rows = social_accounts(spark, d)
    return enrich.stats(enrich.results(ids, enrich.candidates(ids, rows), 30_000))


@query
def metric_sync(spark, d):
    ids, rows = social_accounts(spark, d)
    kept = enrich.signals(enrich.candidates(ids, rows), 0)
    kind = "map<string,struct<followers:double,avg_views:double,engagement_rate:double,confidence:double,sample_size:double>>"
    numbers = lambda n: F.struct(*[F.lit(float(n)).alias(x) for x in ("followers", "avg_views", "engagement_rate", "confidence", "sample_size")])
    before = F.create_map(F.lit("instagram"), numbers(9), F.lit("x"), numbers(7))  # new ones win over these
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("identity_id"), listed("Twitter", "unknown", "yt").alias("platforms"), F.when(F.col("c_custkey") % 2 == 0, before).cast(kind).alias("metrics"))
    s = enrich.sync(old, kept)
    shown = F.transform(F.map_entries("metrics"), lambda e: F.concat_ws(":", e["key"], e["value"]["followers"].cast("long")))
    return s.select("identity_id", joined("platforms").alias("platforms"), joined(F.array_sort(shown)).alias("measured"), F.col("engagement"), "avg_confidence", "n_signals")


@query
def metric_sanitation(spark, d):
    m = measured(spark, d)
    odd = F.when(F.col("platform") == "instagram", "Insta").when(F.col("platform") == "unknown", "bogus").when(F.col("platform") == "youtube", " YouTube ").otherwise(F.col("platform"))
    value = F.struct(F.when(F.col("sample_size") % 2 == 0, -F.col("followers")).otherwise(F.col("followers") + 0.5).alias("followers"), F.lit(None).cast("double").alias("avg_views"), (F.col("engagement_rate") * 20).alias("engagement_rate"), F.col("confidence"), F.lit(float("nan")).alias("sample_size"))
    rows = m.groupBy("creator").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(odd.alias("key"), value.alias("value"))))).alias("raw"))
    e = rows.select("creator", F.explode(importer.sane_metrics(F.col("raw"))).alias("platform", "v"))
    return e.select("creator", "platform", "v.followers", coerce.round_half_up("v.engagement_rate", 6).alias("engagement_rate"), coerce.round_half_up("v.confidence", 6).alias("confidence"), "v.sample_size")


def import_rows(spark, d) -> DataFrame:
    c, k = creators(spark, d), F.col("creator_id")
    words = ["Book a call about coaching", "buy my course and template", "join the community newsletter", "DM me", "a guide for gym beginners", "ugc service, $1,500 per video", "nothing here", "cpm deal on tiktok and youtube for awareness"]
    rows = c.select(
        F.concat(F.lit("ci_"), F.lpad(k.cast("string"), 12, "0")).alias("identity_id"), k, arrays(k, listed(F.concat(F.lit("@jo_b"), k), "x"), listed(), listed(" ")).alias("handles"), F.when(k % 4 == 0, F.concat(F.lit("store."), k)).alias("slug"),
        F.when(k % 5 != 0, F.concat(F.lit("https://stan.store/"), k)).alias("store_url"), listed(F.concat(F.lit("https://x.com/u"), k), F.concat(F.lit("HTTPS://X.COM/U"), k)).alias("profile_urls"), listed(F.concat(F.lit("https://a.com/"), k), None).alias("source_urls"),
        F.lit(None).cast("array<string>").alias("outbound"), "platforms", "metrics", F.when(k % 2 == 0, listed("$9")).otherwise(listed()).alias("prices"), F.element_at(F.lit(words), (k % 8 + 1).cast("int")).alias("corpus"),
        F.lit(0.5).alias("store_confidence"), ((k % 10) / 10.0).alias("social_confidence"), (k % 7 == 0).alias("already_imported"),
    )
    return rows.withColumn("cta", text.cta_style("corpus"))


@query
def import_assembly(spark, d):
    a = importer.assemble(import_rows(spark, d).drop("creator_id"))
    return a.select("creator_id", "status", "reason", "name", joined("links").alias("links"), "niche", "buying_intent", "primary_platform", "confidence")


@query
def import_stats(spark, d):
    return importer.import_stats(importer.assemble(import_rows(spark, d).drop("creator_id")))


# Chat and text.


@query
def chat_priorities(spark, d):
    """What each turn's whole text asks for; four in five turns end with a sentence that asks."""
    k = F.col("conv_id") + F.col("turn")
    asks = arrays(k, F.concat(F.lit("Looking for AI tools and pets "), "conv_id", F.lit(" creators.")), F.lit("we want the best fitness, travel / yoga influencers, covering money habits and travel."), F.lit("show me gaming creators"), F.concat(F.lit("topics around home decor audiences, item "), "turn"), F.lit(""))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(". "), asks).alias("t"))
    rows = rows.withColumn("n", brand.priority_niches("t"))
    return rows.select("conv_id", "turn", joined(F.col("n")).alias("niches"), joined(brand.priority_topics(F.col("t"), F.col("n"))).alias("topics"))


@query
def quick_replies(spark, d):
    k = F.col("conv_id")
    t = F.concat(F.lit("Choose:\nA) first "), k, F.lit("\n"), pick(k, ["", "b. second\nC: third\nD- fourth\nA) fifth", "E) no", "c)\nB)  two "]))
    return table(spark, d, "conversations").select("conv_id", "turn", joined(text.quick_replies(t)).alias("options"))


@query
def brand_searches(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), "s_suppkey", F.lit(".example.com")).alias("host"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("name"))
    site = brand.site_searches(s, "host", "name").select("s_suppkey", F.lit("site").alias("kind"), "place", "query")
    return site.unionByName(brand.web_searches(s, "host", "name").select("s_suppkey", F.lit("web").alias("kind"), "place", "query"))


@query
def shown_labels(spark, d):
    p = table(spark, d, "part")
    n, source = F.col("p_partkey") * F.col("p_partkey") * 3, pick(F.col("p_partkey"), ["synthetic_creators", "stan_pipeline", "hand_made", "", None])
    return p.select("p_partkey", text.compact_count(n).alias("count"), text.follower_band(n).alias("band"), text.percent(F.when(F.col("p_size") > 5, F.col("p_size") / 1000)).alias("share"), text.source_label(source).alias("source"))


@query
def url_inputs(spark, d):
    k = F.col("page_id")
    raw = arrays(k, F.concat(F.lit(" shop"), k, F.lit(".example.com/a#b ")), F.lit("localhost"), F.lit("nohost"), F.col("url"), F.concat(F.lit("HTTPS://www.YouTube.com/channel/UC-"), k), F.concat(F.lit("https://www.linkedin.com/in/Jo."), k, F.lit("!/x")), F.lit("https://www.tiktok.com/@TT_t"), F.lit("https://x.com"))
    p = table(spark, d, "pages").select("page_id", raw.alias("raw"))
    return p.select("page_id", urls.with_scheme("raw").alias("whole"), urls.favicon("raw").alias("icon"), urls.link_handle("raw").alias("handle"), urls.link_platform("raw").alias("platform"))


@query
def text_helpers(spark, d):
    k = F.col("conv_id")
    t = F.concat(F.lit("  a b \t\n\n\n\nc"), F.coalesce("text", F.lit("")), F.lit("\r "))
    j = arrays(k, F.concat(F.lit('say {"n": '), k, F.lit('} end')), F.lit("{x"), F.lit("none"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.clean_text(t)).alias("clean_md5"), F.get_json_object(text.first_json_object(j), "$.n").alias("n"))


@query
def intake_texts(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(k, pick(k, list(rules.PARTNERSHIPS)).alias("partnership"), pick(k, [*rules.COMPENSATIONS, None]).alias("compensation"), arrays(k, F.lit(20.4), F.lit(None).cast("double"), F.lit(0.0)).alias("amount"), pick(k, ["per_1k_views", None]).alias("unit"), listed("reach").alias("goals"), listed("x", "youtube").alias("platforms"))
    s = brand.intake_signals(rows)
    return s.select("n_nationkey", joined("goal_signals").alias("goal_signals"), joined("topic_signals").alias("topic_signals"), F.size("angle_signals").cast("long").alias("angles"))


@query
def analysis_sources(spark, d):
    k = F.col("page_id")
    there = lambda n: F.when(k % n == 0, F.concat(F.lit(f"{n} "), k)).otherwise(F.lit(" "))
    p = table(spark, d, "pages").select("page_id", there(11).alias("pages"), there(7).alias("fetched"), there(2).alias("searched"), there(3).alias("site"), there(5).alias("web"), (k % 4 == 0).alias("challenged"))
    return brand.analysis_source(p, "pages", "fetched", "searched", "site", "web", "challenged").select("page_id", "source", "context")


__all__ = ["QUERIES"]

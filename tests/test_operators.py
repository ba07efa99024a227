"""Operators of the engine on small tables: defined results for the hard cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from brandloom.functions import coerce, text, urls
from brandloom.operators import brand, discovery, explorer, identity, importer, ranking, social, upsert
from brandloom.plans import rules
from brandloom.sources import tables
from brandloom.streaming import ingest


def one(spark, expression, *values):
    """The value of a column expression over literals."""
    return spark.range(1).select(expression(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>") for v in values]).alias("x")).first()[0]


@pytest.mark.parametrize("said,count", [("12.5k followers", 12500), ("1,234 subscribers", 1234), ("3 followers … 2m subs", 3), ("no count", None), (None, None)])
def test_follower_counts(spark, said, count):
    assert one(spark, text.follower_count, said) == count


def test_most_followers(spark):
    assert one(spark, text.most_followers, "3 followers … 2m subs") == 2_000_000


@pytest.mark.parametrize("url,profile", [
    ("https://www.instagram.com/p/abc", None), ("https://www.tiktok.com/@a/video/1", "https://tiktok.com/@a"), ("https://uk.linkedin.com/in/jo-b", "https://uk.linkedin.com/in/jo-b"), ("https://x.com/Home", None),
    ("https://www.youtube.com/channel", None), ("https://www.youtube.com/watch?t=1&v=q", "https://youtube.com/watch?v=q"), ("not a url", None), (None, None), ("https://example.com/a", None),
])
def test_profiles(spark, url, profile):
    assert one(spark, urls.profile, url) == profile


def test_other_url_functions(spark):
    assert one(spark, urls.canonical, "https://a.com/p?utm_source=x&si=1#h") == "https://a.com/p?utm_source=x"
    assert one(spark, lambda u: urls.canonical(u, whole_utm=True), "https://a.com/p?utm_source=x&si=1") == "https://a.com/p"
    assert one(spark, lambda u: urls.handle(urls.profile(u)), "https://uk.linkedin.com/in/jo-b") == "jo-b"
    assert one(spark, lambda u: urls.platform(urls.host(u)), "https://mobile.twitter.com/a") == "x"
    assert one(spark, urls.unwrapped, "/url?q=https%3A%2F%2Fa.com%2F&x=1") == "https://a.com/"
    assert one(spark, urls.brand_name, "https://www.blue-river.com/x") == "Blue River"
    assert one(spark, urls.with_scheme, "a.com#x") == "https://a.com" and one(spark, urls.with_scheme, "nothing") is None
    assert one(spark, urls.store_slug, "my page: https://stan.store/Jo.B.") == "jo.b"
    assert one(spark, lambda t: urls.mentioned_handle(t, "x"), "Jo (@jo_b) on X") == "jo_b"
    assert one(spark, lambda t: urls.clean_handle(t, F.lit("x")), "@" + "a" * 16) is None
    assert [one(spark, lambda t, o=o: urls.normal_platform(t, o), "threads") for o in ("null", "same", "unknown")] == [None, "threads", None]


def test_coercions(spark):
    assert one(spark, coerce.string_list, '["a", "", "b"]') == ["a", "b"]
    assert [one(spark, lambda x, k=k: coerce.string_list(x, k), "a, b") for k in ("drop", "wrap", "csv")] == [[], ["a, b"], ["a", "b"]]
    assert one(spark, coerce.json_object, "[1]") == "{}" and one(spark, coerce.json_object, '{"a": 1}') == '{"a": 1}'
    assert one(spark, coerce.clamp, float("nan")) == 0 and one(spark, coerce.clamp, 7.0) == 1
    assert one(spark, lambda x: coerce.round_half_up(x, 2), 1.005) == 1.0
    assert one(spark, coerce.finite, "1e3") == 1000 and one(spark, coerce.finite, "x") is None
    assert one(spark, coerce.distinct_texts, [" A", "a", "", "b "]) == ["a", "b"]
    assert one(spark, lambda x: coerce.distinct_texts(x, fold=False), [" A", "a", "b"]) == ["A", "b"]
    assert [coerce.clamp_int(v, 1, 10, 5) for v in (3.6, 99, "x", None, float("nan"))] == [4, 10, 5, 5, 5]


def test_text_functions(spark):
    assert one(spark, text.cta_style, "Book a call or buy") == "consultative" and one(spark, text.cta_style, "café bookcase") == "generic"
    assert one(spark, lambda a, b: text.jaccard(text.tokens(a), text.tokens(b)), "weight loss tips", "weight loss transformations") == 0.5
    assert one(spark, lambda a, b: text.phrase_similarity(a, b), "gym", "gym routines") == 0.84
    assert one(spark, text.first_json_object, 'x {"a": 1} y') == '{"a": 1}' and one(spark, text.first_json_object, "{x") is None
    assert one(spark, text.json_strings, '{"k": ["a", {"z": "b"}], "n": 1}') == ["a", "b"]
    assert [one(spark, text.compact_count, n) for n in (812, 12_500, 2_000_000)] == ["812", "12.5K", "2.0M"]
    assert [one(spark, text.follower_band, n) for n in (0, 1_600, 25_000, 3_400_000)] == ["~1k", "~2k", "25k+", "3M+"]
    assert one(spark, text.links, "see https://a.com/x. and https://a.com/x") == ["https://a.com/x"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "kept"), (2, "b", "kept")], "id int, v string, status string")
    new = spark.createDataFrame([(2, "B", "new"), (2, "C", "new"), (3, "D", "new")], "id int, v string, status string")
    out = upsert.upsert(old, new, ["id"], [F.desc("v")], keep=("status",))
    want = [(1, "a", "kept"), (2, "C", "kept"), (3, "D", "new")]
    assert sorted(map(tuple, out.collect())) == want
    assert sorted(map(tuple, upsert.upsert(out, new, ["id"], [F.desc("v")], keep=("status",)).collect())) == want
    assert sorted(map(tuple, upsert.insert_absent(old, new.where("v <> 'C'"), ["id"]).collect())) == [(1, "a", "kept"), (2, "b", "kept"), (3, "D", "new")]
    assert upsert.delete_where(old, F.col("v") == "a").count() == 1 and upsert.cascade(old.withColumnRenamed("id", "p"), new, "p", "id").count() == 1
    assert upsert.update_where(old, F.col("id") == 1, {"v": F.lit("z")}).orderBy("id").first().v == "z"


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None)], "k string, v int")
    assert ranking.top_k(df, ["k"], [F.desc_nulls_last("v")], 2).count() == 3
    empty, full = df.limit(0), df
    assert {r.pool for r in ranking.pool_cascade([("one", empty), ("two", full)], [F.col("k")], 9).collect()} == {"two"}
    assert ranking.pool_cascade([("one", empty), ("two", full)], [F.col("k")], 9, scope="one").count() == 0
    asked = spark.createDataFrame([("a", "Best?", None), ("a", "why", 1.0), ("b", "hello", 1.0)], "k string, said string, budget double")
    assert ranking.decks(asked, df, "k", "said", "budget", [F.desc("v")], "v").count() == 4


def test_social_signal(spark):
    s = one(spark, lambda p, f, n, o: social.social_signal(p, f, n, o), "instagram", 10_000, 2, True)
    assert (s.avg_views, s.engagement_rate, s.confidence) == (1166, 0.037, 0.95)
    assert one(spark, lambda p, f, n, o: social.social_signal(p, f, n, o), "x", None, 0, False).quality == "sparse"
    assert [one(spark, lambda f: social.enough_followers(f, 100), f) for f in (None, 0, 50, 200)] == [True, True, False, True]


def test_explorer(spark):
    assert one(spark, explorer.niche_group, "AI  tools") == "Technology" and one(spark, explorer.niche_group, None) == "Business"
    assert one(spark, explorer.price, "fitness", 90_000) == 2250 and one(spark, explorer.price, "fitness", None) is None


def test_rules(spark):
    df = spark.createDataFrame([("Gym workout coach, buy my course", "generic"), (None, None)], "t string, cta string")
    r = importer.compatibility(df, "t", "cta").collect()
    assert r[0].niche == "fitness coaching" and r[0].intents == ["direct_purchase", "digital_product"] and r[0].selling_style == "direct_response"
    assert r[1].niche == rules.DEFAULT_NICHE
    assert one(spark, importer.display_name, "jo_b", None, "ci_12345678") == "Jo B" and one(spark, importer.display_name, " ", None, "ci_abcdefghij") == "Creator abcdefgh"
    assert abs(sum(sum(p) for p in rules.POLICIES.values()) - 4) < 1e-9


def test_brand(spark):
    df = spark.createDataFrame([("UGC deal, $1,500 per video on TikTok for awareness",), ("no fixed budget",), (None,)], "t string")
    r = brand.intent(df, "t").collect()
    assert (r[0].partnership, r[0].amount, r[0].unit, r[0].platforms) == ("ugc", 1500, "per_video", ["tiktok"]) and "brand awareness" in r[0].goals
    assert r[1].open_budget and r[1].amount is None and r[2].goals == []
    forms = spark.createDataFrame([("ugc", "cpm", 20.4, "per_1k_views", ["reach"], ["x"]), (None, None, None, None, [], [])], "partnership string, compensation string, amount double, unit string, goals array<string>, platforms array<string>")
    s = brand.intake_signals(forms).collect()
    assert s[0].goal_signals == ["source UGC creative", "performance-priced creator deals", "reach"] and "target payout: $20 per 1k views" in s[0].angle_signals and s[1].topic_signals == []


def fold(accounts):
    """One account after the other."""
    slugs, domains, out = {}, {}, []
    for i, (slug, domain) in enumerate(accounts):
        if slug is not None:
            if slug not in slugs:
                if domain is None or domain not in domains:
                    slugs[slug] = i
                    if domain is not None:
                        domains[domain] = i
                    out.append(i)
                else:
                    out.append(domains[domain])
            else:
                out.append(slugs[slug])
        elif domain is not None:
            out.append(domains.setdefault(domain, i))
        else:
            out.append(None)
    return out


def test_identities_follow_the_order_of_accounts(spark):
    r = random.Random(8)
    accounts = [(r.choice([None, *[f"s{k}" for k in range(9)]]), r.choice([None, *[f"d{k}.com" for k in range(9)]])) for _ in range(60)]
    df = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(accounts)], "n long, slug string, domain string").repartition(3)
    got = {x.n: x.identity_id for x in identity.resolve(df, "n").collect()}
    want = fold(accounts)
    # In three runs, each given what those before it opened.
    known, parts = None, {}
    for low in (0, 20, 40):
        rows, opened = identity.resolve_known(df.where(f"n between {low} and {low + 19}"), "n", known)
        known = opened if known is None else known.unionByName(opened)
        parts |= {x.n: x.identity_id for x in rows.collect()}
    assert parts == got
    pairs = {(got[i], want[i]) for i in range(60)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((got[i] is None) == (want[i] is None) for i in range(60))


def test_a_run_queues_what_has_no_anchor(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(0, "a", "jo", "x", "s1", None, "stan_slug"), (1, "b", "jo", "tiktok", None, None, "queued"), (2, "c", "al", "x", None, "d.com", "cross_link_personal_domain"), (3, "d", None, None, None, None, "queued")]
    accounts = spark.createDataFrame(rows, "n long, account string, handle string, platform string, slug string, domain string, reason string")
    linked = spark.createDataFrame([("jo", "x", "ci_1", at), ("jo", "tiktok", "ci_2", at + datetime.timedelta(days=1)), ("jo", "x", "ci_0", at - datetime.timedelta(days=1))], "handle string, platform string, identity_id string, created_at timestamp")
    run = identity.resolve_run(accounts, "n", None, linked)
    assert sorted((r.account, r.linkage_reason) for r in run["links"].collect()) == [("a", "stan_slug"), ("c", "cross_link_personal_domain")]
    assert sorted((r.account, r.candidate, r.confidence) for r in run["queue"].collect()) == [("b", "ci_1", 0.55), ("d", None, 0.3)]
    s = run["stats"].first()
    assert (s.processed, s.merged_by_slug, s.merged_by_domain, s.merged_by_cross_link, s.queued, s.created) == (4, 1, 0, 1, 2, 2)


def test_ids_are_lossless(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("a", "", "b"), ("1:a", None, "b"), ("a-", None, "b")], "x string, y string, z string")
    ids = [r[0] for r in df.select(upsert.stable_id("t", "x", "y", "z")).collect()]
    assert len(set(ids)) == len(ids) and all(len(i) == 66 for i in ids)


def test_links_are_resolved(spark):
    page = """<a href="/pricing">p</a><a class=x href='about/us'>a</a><a href=blog/>b</a><a href="//shop.co/product">h</a><a href="../stories">s</a><a href="/legal/about">l</a><a href="mailto:a@b.co">m</a><a href="https://shop.co/case#top">c</a><link href="/company">"""
    assert one(spark, lambda p, b: discovery.interesting_links(p, b), page, "https://www.shop.co/en/home?x=1") == [
        "https://www.shop.co/pricing", "https://www.shop.co/en/about/us", "https://www.shop.co/en/blog/", "https://shop.co/product", "https://www.shop.co/stories", "https://shop.co/case#top",
    ]
    assert [one(spark, urls.resolved, h, "http://a.b") for h in ("x", "?q=1", "#t", "https://c.d/e")] == ["http://a.b/x", "http://a.b?q=1", "http://a.b#t", "https://c.d/e"]


def test_keywords(spark):
    words = ["9-5", "ai", "real estate", "c_d"]
    assert one(spark, lambda t: text.keywords_in(t, words), "the 9-5 of ai") == ["ai", "9-5"]
    assert one(spark, lambda t: text.keywords_in(t, words), "19-50 aid unreal estates c_de") == ["real estate"]
    assert [one(spark, lambda t: text.has_keyword(t, k), "a 9-5, ai real estates c_d") for k in words] == [True] * 4
    assert one(spark, text.title_case, "@jo_b.c") == "Jo B C"


def test_anchors(spark):
    df = spark.createDataFrame([("https://www.jo.com/a", "t"), ("https://m.youtube.com/@a", "at https://stan.store/Jo"), ("https://x.com/a", "see jo.dev now"), ("https://x.com/a", "nothing")], "url string, t string")
    r = identity.anchors(df, F.lit(None).cast("string"), F.col("url"), F.col("t")).collect()
    assert [(x.slug, x.domain, x.reason) for x in r] == [(None, "jo.com", "personal_domain"), ("jo", "m.youtube.com", "cross_link_stan_slug"), (None, "jo.dev", "cross_link_personal_domain"), (None, None, "queued")]


def test_discovery(spark):
    payload = spark.createDataFrame([("r", [("https://x.com/jo", "Jo", None), ("bad url", "t", 7)])], "run string, results array<struct<url:string,title:string,position:int>>")
    rows = discovery.explode_results(payload).collect()
    assert [r.position for r in rows] == [1, 7]
    df = spark.createDataFrame([("https://x.com/jo", "Jo stan.store/jo 2k followers"), ("bad", "x")], "url string, title string")
    n = discovery.extract(discovery.normalize(df, "url", F.col("title"), F.lit(None).cast("string")), F.col("title")).collect()
    assert len(n) == 1 and (n[0].handle, n[0].store_slug, n[0].followers, n[0].confidence) == ("jo", "jo", 2000, 0.94)


def test_seeds(spark, tmp_path):
    (tmp_path / "a.json").write_text('[[{"id": "1", "name": "A", "niche": "n", "platforms": ["x"]}], {"id": "2", "name": "B"}]')
    (tmp_path / "b.json").write_text('[{"id": "1", "name": "Z", "niche": "n"}, [[{"id": "3", "name": "C", "niche": "n"}]]]')
    rows = {r.id: r.name for r in tables.seeds(spark, [f"file:{tmp_path}/a.json", f"file:{tmp_path}/b.json"]).collect()}
    assert rows == {"1": "A", "3": "C"}
    assert tables.invented_creators(spark, 20).collect() == tables.invented_creators(spark, 20).collect()
    assert tables.query(spark, "SELECT :a AS a", a="it's").first().a == "it's"


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, at + datetime.timedelta(minutes=7 * i), "view", 1.0) for i in range(20)], "id int, ts timestamp, kind string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), events.schema)
    q = ingest.windowed_counts(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, ingest.windowed_counts(events, "ts", "kind").collect()))
    sink = ingest.upsert_sink(str(tmp_path / "out"), ["id"], lambda: [F.desc("ts")], buckets=4)
    sink(events, 0)
    again = ingest.upsert_sink(str(tmp_path / "out"), ["id"], lambda: [F.desc("ts")], buckets=4)  # as after a restart
    for _ in range(2):
        again(events.where("id < 5").withColumn("value", F.lit(9.0)), 1)
    out = ingest.read_upserted(spark, str(tmp_path / "out"))
    assert out.count() == 20 and out.where("value = 9").count() == 5
    for epoch in range(2, 6):
        again(events.where("id = 7").withColumn("value", F.lit(epoch * 1.0)), epoch)
    out = ingest.read_upserted(spark, str(tmp_path / "out"))
    assert out.count() == 20 and out.where("id = 7").first().value == 5.0
    assert len(list((tmp_path / "out").glob("v*/bucket=*"))) < 4 + 4 + 4
    seen = ingest.first_seen(events.unionByName(events.withColumn("ts", F.col("ts") - F.expr("interval 1 day"))), ["id"], "ts")
    assert seen.count() == 20 and seen.agg(F.max("ts")).first()[0] < at + datetime.timedelta(hours=1)

"""Flows on nulls, empty tables and what their SQL doesn't reach."""

import pytest
from pyspark.sql import functions as F

from brandloom.functions import text, urls
from brandloom.operators import brand, crawl, discovery, enrich, explorer, graph, harvest, importer, ranking, serving
from brandloom.sources import shared, tables


def first(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_filters(spark):
    assert serving.id_list([" a ", "a", "", None, "b"], most=1) == ["a"]
    df = spark.createDataFrame([("1", 0.345), ("2", None), (None, 0.9)], "id string, c double")
    assert serving.filtered(df).count() == 3 and serving.filtered(df, least={"c": 0.346}).count() == 1 and serving.filtered(df, least={"c": 0.344}).count() == 2
    assert serving.in_ids(df, "id", [str(i) for i in range(300)]).count() == 2 and serving.in_ids(df, "id", []).count() == 0
    assert df.where(serving.at_least("c")).count() == 1
    assert serving.pending(df, df.where("id = '1'"), "id").count() == 2 and serving.pending(df, df, "id", force=True).count() == 3


def test_reasons(spark):
    shapes = ['["a"]', '{"reasons": ["b"], "breakdown": {"n": 1}}', '{"reasons": "no list"}', "[1", "", None, '"text"']
    df = spark.createDataFrame([(s,) for s in shapes], "s string").select(serving.reasons_of("s").alias("r"))
    assert [(r.r.reasons, r.r.breakdown) for r in df.collect()] == [(["a"], None), (["b"], '{"n":1}'), ([], None), ([], None), ([], None), ([], None), ([], None)]


def test_texts_of_accounts(spark):
    t = harvest.texts_of(F.lit(" a "), F.lit(None).cast("string"), F.lit("a"), raw=F.lit('{"x": [1, {"y": "b"}], "z": null}'))
    assert first(spark, t).asDict().popitem()[1] == ["a", "1", "b"]
    none = F.array().cast("array<string>")
    m = first(spark, harvest.follower_mentions(none).alias("m"), harvest.store_slugs(none).alias("s"), harvest.profile_in(none, F.lit("x")).alias("p"), harvest.handle_in(none, F.lit("tiktok")).alias("h"), harvest.profile_in(none, F.lit("unknown")).alias("u"))
    assert (m.m.count, m.s, m.p, m.h, m.u) == (m.m.count, [], None, None, None) and m.m["count"] is None
    deep = '{"a": {"b": {"c": {"d": "in", "e": {"f": "out"}}}}}'
    assert first(spark, harvest.json_leaves(F.lit(deep))).asDict().popitem()[1] == ["in"]


def test_a_channel_gives_way_to_a_handle(spark):
    rows = spark.createDataFrame([("https://www.youtube.com/channel/UC1", "youtube", ["at @real.name"]), ("https://www.youtube.com/channel/UC1", "youtube", []), (None, None, ["x"]), ("no url", "instagram", ["(@jo.b) and 0 followers"])], "url string, platform string, texts array<string>")
    r = harvest.assemble(rows, "url", "platform", "texts").collect()
    assert (r[0].profile_url, r[0].handle) == ("https://youtube.com/@real.name", "real.name") and r[1].profile_url.endswith("/channel/UC1")
    assert (r[2].kind, r[2].profile_url, r[2].confidence) == ("unknown", None, 0.1)
    assert (r[3].profile_url, r[3].instagram_handle, r[3].followers, r[3].signals) == ("https://instagram.com/jo.b", "jo.b", 0, ["instagram_profile_url", "instagram_handle", "instagram_profile_url", "instagram_handle"])


def test_enrichment(spark):
    ids = spark.createDataFrame([(1, ["https://www.instagram.com/a"], False), (2, [], True), (3, None, True), (4, [], False), (None, [], False)], "identity_id long, outbound array<string>, has_social boolean")
    accounts = spark.createDataFrame([(1, "Insta", 500.0, 1), (1, "instagram", 900.0, 2), (2, "yt", 50.0, 1), (3, "x", None, 0), (4, None, 10_000.0, 3)], "identity_id long, platform string, followers double, signal_count int")
    found = enrich.candidates(ids, accounts)
    rows = {r.identity_id: (r.status, r.reason, r.platforms) for r in enrich.results(ids, found, 100).collect()}
    assert rows == {1: ("enriched", None, 1), 2: ("skipped", enrich.ALL_LOW, 0), 3: ("skipped", enrich.TOO_FEW, 0), 4: ("enriched", None, 1), None: ("failed", "no identity", 0)}
    s = enrich.stats(enrich.results(ids, found, 100)).first()
    assert (s.selected, s.enriched, s.updated, s.skipped_low_followers, s.failed) == (5, 2, 0, 2, 1)
    kind = "map<string,struct<followers:double,avg_views:double,engagement_rate:double,confidence:double,sample_size:double>>"
    creators = spark.createDataFrame([(1, ["TikTok"]), (4, None)], "identity_id long, platforms array<string>").withColumn("metrics", F.lit(None).cast(kind))
    synced = {r.identity_id: (r.platforms, sorted(r.metrics)) for r in enrich.sync(creators.fillna({}), enrich.signals(found)).where("platforms is not null").collect()}
    assert synced[1] == (["tiktok", "instagram"], ["instagram"])
    assert enrich.results(ids.limit(0), found).count() == 0 and enrich.stats(enrich.results(ids.limit(0), found)).first().selected == 0


def test_imports(spark):
    raw = F.create_map(F.lit("Insta"), F.struct(F.lit(-1.0).alias("followers"), F.lit(None).cast("double").alias("avg_views"), F.lit(3.0).alias("engagement_rate"), F.lit(None).cast("double").alias("confidence"), F.lit(1.4).alias("sample_size")))
    m = first(spark, importer.sane_metrics(raw).alias("m")).m
    assert {k: tuple(v) for k, v in m.items()} == {"instagram": (0.0, None, 1.0, None, 1.0)}
    assert first(spark, importer.sample_links(F.array(F.lit("A"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("b"))).alias("l")).l == ["A", "b"]
    assert importer.import_stats(spark.createDataFrame([], "status string, reason string")).first().selected == 0


def test_pages(spark):
    saved = spark.createDataFrame([], "brand_id long, url string, title string, text string, n long")
    pages = spark.createDataFrame([(1, f"u{i}", "", "x" * (300 + 100 * i), i) for i in range(8)] + [(1, "u7", "", "y" * 500, 9), (2, "v", "t", None, 0)], "brand_id long, url string, title string, text string, place int")
    got = crawl.brand_pages(saved, pages, "place")
    assert sorted((r.url, r.title, r.n) for r in got.collect()) == [(f"u{i}", None, 300 + 100 * i) for i in range(1, 6)]
    stores = crawl.store_pages(spark.createDataFrame([(None, "https://stan.store/a"), ("", None)], "html string, url string")).collect()
    assert [(r.profile_name, r.confidence) for r in stores] == [(None, 0.25), (None, 0.25)]


def test_serving_tables(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(30)], "id int, k string")
    assert [r.id for r in ranking.page_of(rows, [F.col("id")], 3).collect()] == list(range(24, 30))
    assert explorer.search(rows.withColumn("platforms", F.array(F.lit("x"))), "all", "all", "  ").count() == 30
    assert discovery.grouped_by_query(spark.createDataFrame([(" ", "u", 1), (None, "u", 2), ("q ", "u", 3)], "q string, u string, p int"), "q", "u", "p").count() == 1


def test_chat(spark):
    assert first(spark, text.quick_replies(F.lit("A) one")).alias("x")).x is None
    assert first(spark, brand.priority_niches(F.lit("top creators, find me gaming influencers")).alias("x")).x == []
    assert [first(spark, text.percent(F.lit(v).cast("double")).alias("x")).x for v in (0.0321, None)] == ["3.2%", "—"]
    assert first(spark, text.profile_name(F.lit(None).cast("string")).alias("x"), text.title_handle(F.lit("no")).alias("y")).asDict() == {"x": None, "y": None}
    assert first(spark, urls.link_handle(F.lit("https://x.com/")).alias("x"), urls.favicon(F.lit("nohost")).alias("y")).asDict() == {"x": None, "y": None}


def test_shared_tables(spark, tmp_path):
    df = shared.stored(spark.range(3), "test")
    path = df._stored_at
    assert df.count() == 3
    shared.drop_stored(df)
    system, place = shared.file_system(spark, path)
    assert not system.exists(place)
    with pytest.raises(ValueError, match="seed target"):
        tables.target_table("elsewhere")
    assert [tables.target_table(x) for x in (None, "real", " Synthetic ")] == ["synthetic_creators", "creators", "synthetic_creators"]
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "u string, v string")
    assert {(r.node, r.root) for r in graph.components(links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}

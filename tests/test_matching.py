"""Likeness joins, top matches by bounds, identities by rounds and as a stream, published versions, pages by range."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brandloom import queries
from brandloom.functions.text import tokens
from brandloom.operators import identity, likeness, matching, paging, ranking, scoring
from brandloom.sources import shared, snapshots
from brandloom.streaming import decks, identities
from tests.test_operators import fold

WORDS = ["art", "smart", "a", "ai", "ring", "red", "b2b", "é", "ringer", "in", "starting"]


def phrases(spark, seed):
    r = random.Random(seed)
    made = {" ".join(r.choice(WORDS) for _ in range(r.randint(0, 4))) for _ in range(60)}
    return spark.createDataFrame([(x,) for x in sorted({*made, "éé", "é", ""})] + [(None,)], "phrase string")


@pytest.mark.parametrize("kind", likeness.MEASURES)
@pytest.mark.parametrize("least", [0.0, 0.34, 0.8])
def test_likeness_is_that_of_all_pairs(spark, kind, least):
    a, b = phrases(spark, 1), phrases(spark, 2)
    got = {(x.a, x.b): round(x.likeness, 9) for x in likeness.alike(a, b, kind, least).collect()}
    pairs = a.select(F.col("phrase").alias("a")).crossJoin(b.select(F.col("phrase").alias("b")))
    value = likeness.measure(kind, F.col("a"), F.col("b"), tokens("a"), tokens("b"))
    assert got == {(x.a, x.b): round(x.v, 9) for x in pairs.select("a", "b", value.alias("v")).where(f"v > 0 and v >= {least}").collect()}
    met = {tuple(x) for x in likeness.candidates(a, b, kind, least).collect()}
    assert met >= set(got) and (least < 0.8 or len(met) < 0.5 * a.count() * b.count())
    assert likeness.alike(a.limit(0), b, kind, least).count() == 0


BRAND = "brand_id long, category string, match_topics array<string>, target_audience array<string>, goals array<string>, campaign_angles array<string>, preferred_platforms array<string>, priority_niches array<string>, priority_topics array<string>"
CREATOR = "creator_id long, niche string, topics array<string>, audience_types array<string>, platforms array<string>, metrics map<string,struct<followers:double,avg_views:double,engagement_rate:double,confidence:double,sample_size:double>>, primary_platform string, signal_confidence double, estimated_engagement double"


def some_of(r, values, most):
    return r.choice([None, [], *[r.sample(values, r.randint(1, most)) for _ in range(4)]])


def market(spark, seed, n_brands, n_creators):
    r = random.Random(seed)
    topics = [f"{a} {b}" for a in ("red", "cold", "smart", "ai") for b in ("ring", "gear", "art")] + ["ai", "é", "ai tools"]
    niches, people = ["pets", "pet care", "ai tools", "ai", "", None], ["founders", "young founders", "students", "pets"]
    sites = ["youtube", "x", "tiktok"]
    brands = [(i, r.choice(niches), some_of(r, topics, 4), some_of(r, people, 2), some_of(r, ["sales", "community", "lead demo"], 1), None, some_of(r, sites, 2), some_of(r, niches[:4], 2), some_of(r, topics, 2)) for i in range(n_brands)]
    number = lambda: r.choice([None, 0.0, r.random() * 1e5])
    metrics = lambda: r.choice([None, {s: (number(), number(), r.choice([None, 0.02, 0.08]), r.choice([None, 0.9]), 3.0) for s in r.sample(sites, 2)}])
    creators = [(i, r.choice(niches), some_of(r, topics, 6), some_of(r, people, 2), some_of(r, sites, 2), metrics(), r.choice([None, "x"]), r.choice([None, 0.0, 0.5, 2.0]), r.choice([None, 0.01, 0.05])) for i in range(n_creators)]
    return spark.createDataFrame(brands, BRAND), spark.createDataFrame(creators, CREATOR)


@pytest.mark.parametrize(("seed", "n_brands", "n_creators", "k"), [(1, 12, 150, 3), (2, 6, 5, 12), (3, 8, 60, 1)])
def test_top_matches_are_those_of_all_pairs(spark, seed, n_brands, n_creators, k):
    """Lists that are null or empty, ties, and a pool that is smaller than k."""
    brands, creators = market(spark, seed, n_brands, n_creators)
    order = [F.desc("total"), F.col("creator_id")]
    want = ranking.top_k(scoring.score_all(brands, creators), ["brand_id"], order, k)
    got = matching.top_matches(brands, creators, "brand_id", "creator_id", k)
    columns = ["brand_id", "creator_id", "rank", "total", "boost", "reasons", "best_platform"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    assert matching.top_matches(brands, creators.limit(0), "brand_id", "creator_id", k).count() == 0
    assert matching.top_matches(brands.limit(0), creators, "brand_id", "creator_id", k).count() == 0


def test_few_pairs_are_scored(spark):
    r = random.Random(5)
    creators = spark.createDataFrame([(i, f"n{i % 40}", [f"ta{i % 40}", f"tb{i % 50}", f"tc{i % 7}"], [f"p{i % 40}"], ["x"], None, None, 0.5, r.random() * 0.06) for i in range(1_500)], CREATOR)
    brands = spark.createDataFrame([(i, f"n{i}", [f"ta{i}", f"tb{i}"], [f"p{i}"], None, None, ["x"], [f"n{i}"], None) for i in range(10)], BRAND)
    b = scoring.prepare_brands(brands).withColumn("__b", F.col("brand_id"))
    c = scoring.prepare_creators(creators).withColumn("__c", F.col("creator_id"))
    pairs, thresholds = matching._candidates(shared.stored(b, "b"), shared.stored(c, "c"), 12, matching._score_columns())
    assert thresholds.where("reached").count() == 0 and 120 <= pairs.count() < 1_500
    plan = matching.top_matches(brands, creators, "brand_id", "creator_id", 12)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def same_groups(got, want):
    pairs = set(zip(got, want, strict=True))
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and all((a is None) == (b is None) for a, b in pairs)


CHAINS = {
    "each waits for the last": [(f"s{(i + 1) // 2}", f"d{i // 2}") for i in range(90)],
    "broken": [(f"s{(i + 1) // 2}" if i % 7 else None, f"d{i // 2}" if i % 11 else None) for i in range(90)],
    "one slug": [("s", f"d{i % 30}") for i in range(60)] + [(f"s{i}", "d3") for i in range(30)],
    "backward": [(f"s{(i + 1) // 2}", f"d{i // 2}") for i in reversed(range(60))],
}


@pytest.mark.parametrize("name", CHAINS)
def test_identities_of_chains(spark, name):
    rows = CHAINS[name]
    df = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(rows)], "n long, slug string, domain string").repartition(3)
    got = {x.n: x.identity_id for x in identity.resolve(df, "n").collect()}
    assert same_groups([got[i] for i in range(len(rows))], fold(rows))
    assert identity.resolve(df.limit(0), "n").count() == 0


def test_a_stream_of_accounts_gives_the_identities_of_one_run(spark, tmp_path):
    r = random.Random(11)
    rows = [(r.choice([None, *[f"s{k}" for k in range(12)]]), r.choice([None, *[f"d{k}.com" for k in range(12)]])) for _ in range(90)]
    df = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(rows)], "n long, slug string, domain string")
    cuts = [0, *sorted(r.sample(range(1, 90), 4)), 90]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.where(f"n >= {low} and n < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    out = f"{tmp_path}/out"

    def run(batches):  # each call is a stream that is started anew on the same checkpoint
        for k in batches:
            (source,) = (tmp_path / f"in/part{k}").glob("*.parquet")
            (tmp_path / "arrived").mkdir(exist_ok=True)
            (tmp_path / f"arrived/{k}.parquet").write_bytes(source.read_bytes())
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/arrived")
            stream.writeStream.foreachBatch(identities.identity_sink(out, "n")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    run(range(3))
    identities.identity_sink(out, "n")(df.where(f"n >= {cuts[2]} and n < {cuts[3]}"), 2)  # the last batch once more
    run(range(3, 5))
    got = {x.n: x.identity_id for x in identities.read_links(spark, out).collect()}
    once = {x.n: x.identity_id for x in identity.resolve(df, "n").collect()}
    assert got == once and same_groups([got[i] for i in range(90)], fold(rows))


def test_pairs_stay_with_their_creator(spark, monkeypatch):
    """No exchange by pair while bounds are worked out; before, all postings were moved. Creators carry no tokens until a pair of theirs is scored."""
    plans, columns = {}, {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        columns[label] = dict(df.dtypes)
        return shared.stored(df, label)

    monkeypatch.setattr(matching, "stored", seen)
    matching.top_matches(*market(spark, 5, 4, 40), "brand_id", "creator_id", 3)
    assert re.search(r"hashpartitioning\(__c#\d+L, \d", plans["candidates"]) and not re.search(r"hashpartitioning\(__b#\d+L, __c#", plans["candidates"])
    assert columns["creators"]["__offered"] == "array<struct<p:string>>"


def test_lineitem_is_joined_once(spark):
    sides = queries.sides(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in side._jdf.queryExecution().executedPlan().toString() for side in sides)
    alone = queries.brands(spark, "/root/testdata/sf0.001"), queries.creators(spark, "/root/testdata/sf0.001")
    assert all(sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) for a, b in zip(sides, alone, strict=True))


def test_versions_are_published_whole(spark, tmp_path, monkeypatch):
    root, df = f"{tmp_path}/tables", spark.range(5)
    assert snapshots.read(spark, root, "a") is None
    snapshots.publish(spark, root, {"a": df, "b": df})
    broken = df.select(F.raise_error(F.lit("dies")).alias("id"))
    with pytest.raises(Exception, match="dies"):
        snapshots.publish(spark, root, {"a": df.where("id > 3"), "b": broken})  # after a, before b
    assert (snapshots.read(spark, root, "a").count(), snapshots.read(spark, root, "b").count()) == (5, 5)
    assert all(not p.name.startswith("_") for p in (tmp_path / "tables").iterdir())
    for low in range(3):
        snapshots.publish(spark, root, {"a": snapshots.read(spark, root, "a").where(f"id > {low}")})
    assert (snapshots.read(spark, root, "a").count(), snapshots.read(spark, root, "b").count()) == (2, 5)
    assert len(snapshots.versions(spark, root, "a")) == 2 and len(snapshots.versions(spark, root, "b")) == 1
    monkeypatch.setattr(snapshots, "versions", lambda *a, known=snapshots.versions(spark, root)[:-1]: known)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, {"a": df})


def test_pages_by_range(spark, tmp_path):
    rows = spark.createDataFrame([(i, [None, 1, 2, 5][i % 4]) for i in range(157)], "id long, at long")
    order = [F.desc_nulls_last("at"), F.col("id")]
    path = f"{tmp_path}/ranges"
    paging.store_ranges(rows, order, path, 6)
    for page in (1, 2, 7, 13, 14, 15):
        assert paging.page_of_ranges(spark, path, order, page).collect() == ranking.page_of(rows, order, page).collect()
    assert "PartitionFilters: [range" in paging.page_of_ranges(spark, path, order, 7)._jdf.queryExecution().toString()


def test_stored_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    out = shared.stored(spark.range(1000).repartition(3, "id"), "t")
    assert out.count() == 1000 and spark.conf.get(key, None) == before
    made = []
    for _ in range(2):
        assert shared.kept(spark, f"kept-{id(made)}", lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    shared._delete(spark, f"{shared.shared_dir(spark)}/brandloom-kept-{id(made)}")


def test_decks_as_state_are_those_of_a_batch(spark, tmp_path):
    r = random.Random(13)
    rows = [(r.randrange(6), r.choice([None, *"abcdefghij"]), r.randrange(400)) for _ in range(300)]
    df = spark.createDataFrame(rows, "user_id long, deck string, at long")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", decks.PROVIDER)
    seen = {}

    def run(k, low, high):  # a stream that is started anew on the same checkpoint
        spark.createDataFrame(rows[low:high], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
        out = decks.deck_stream(stream, "user_id", "deck", "at", most=4)
        out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, _: seen.update({x.user_id: list(zip(x.decks, x["at"], strict=True)) for x in b.collect()})).trigger(availableNow=True).start().awaitTermination()

    try:
        cuts = [0, *sorted(r.sample(range(1, 300), 3)), 300]
        for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            run(k, low, high)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {}
    for x in sorted(ranking.deck_history(df.where("deck is not null"), "user_id", "deck", "at", 4).collect(), key=lambda x: x.place):
        want.setdefault(x.user_id, []).append((x.deck, x["at"]))
    assert seen == want

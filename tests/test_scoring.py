"""Compatibility scores of hand-derived cases, and their invariants."""

import json

import pytest
from pyspark.sql import functions as F

from brandloom import queries
from brandloom.functions import coerce
from brandloom.operators import scoring

LISTS = ("target_audience", "goals", "campaign_angles", "match_topics", "preferred_platforms", "priority_niches", "priority_topics", "platforms", "audience_types", "topics")
METRICS = "map<string,struct<followers:double,avg_views:double,engagement_rate:double,confidence:double,sample_size:double>>"

CASES = [
    ("1A", 0.7903, dict(category="fitness coaching", preferred_platforms=["instagram", "tiktok"], target_audience=["weight loss", "gym beginners"], goals=["sales"], campaign_angles=["weight loss tips", "nutrition routine"], match_topics=["gym routines", "weight loss transformations", "nutrition for fat loss"], niche="fitness coaching", platforms=["instagram", "tiktok"], audience_types=["weight loss", "gym beginners"], estimated_engagement=0.058, topics=["gym routines", "weight loss transformations"])),
    ("2A", 0.8195, dict(category="personal finance", preferred_platforms=["youtube", "x"], target_audience=["young professionals"], goals=["signups"], campaign_angles=["money habits", "debt payoff"], match_topics=["budgeting", "saving", "debt payoff"], niche="personal finance", platforms=["youtube", "x"], audience_types=["young professionals"], estimated_engagement=0.04, topics=["budgeting", "saving", "debt payoff"])),
    ("3A", 0.7940, dict(category="life coaching", preferred_platforms=["linkedin"], target_audience=["young adults", "self-improvement"], goals=["community"], campaign_angles=["confidence growth"], match_topics=["confidence", "habits"], niche="life coaching", platforms=["youtube"], audience_types=["young adults", "self-improvement"], estimated_engagement=0.03, topics=["confidence", "habits"])),
    ("3B", 0.3886, dict(category="life coaching", preferred_platforms=["linkedin"], target_audience=["young adults", "self-improvement"], goals=["community"], campaign_angles=["confidence growth"], match_topics=["confidence", "habits"], niche="life coaching", platforms=["linkedin"], audience_types=["enterprise founders"], estimated_engagement=0.02, topics=["leadership"])),
]


@pytest.fixture(scope="module")
def scored(spark):
    schema = "name string, category string, niche string, estimated_engagement double, signal_confidence double, primary_platform string, " + ", ".join(f"{c} array<string>" for c in LISTS) + f", metrics {METRICS}"
    rows = [json.dumps({"name": n, **c}) for n, _, c in CASES] + [json.dumps({"name": "empty"})]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    return {r["name"]: r for r in scoring.score_pairs(df).collect()}


@pytest.mark.parametrize("name,total", [(n, t) for n, t, _ in CASES])
def test_totals(scored, name, total):
    assert scored[name]["total"] == pytest.approx(total, abs=2e-4)


def test_invariants(scored):
    for row in scored.values():
        assert 0 <= row["total"] <= 1
        assert sum(row["weights"].asDict().values()) == pytest.approx(1)
        assert all(0 <= m["score"] <= 1 and 0 <= m["confidence"] <= 1 for m in row["modules"])


def test_parts_are_boosted_on_all_cores(spark):
    """A part costs far more than its bytes say; a small file would be one task."""
    assert queries.priority_boost_top3(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_boost_of_known_likenesses(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], [0.2, 0.5, 1.0, 0.5, 0.5]), ([], []), (["a"], [0.1])], "p array<string>, likes array<double>")
    got = df.select(scoring.priority_boost(scoring.terms(F.col("p")), F.col("likes")).alias("b")).collect()
    assert [(round(x.b.boost, 9), x.b.matched) for x in got] == [(0.16, ["c", "b", "d"]), (0.0, []), (0.0, [])]


def test_clamp_names_its_argument_once(spark):
    """Lambdas work out all that is written: clamps within clamps did three times as much at each level."""
    assert str(coerce.clamp(F.col("argument"))._jc.toString()).count("argument") == 1
    rows = spark.createDataFrame([(None,), (float("nan"),), (-2.0,), (0.25,), (7.0,), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in rows.select(coerce.clamp("x")).collect()] == [0.0, 0.0, 0.0, 0.25, 1.0, 1.0, 0.0]

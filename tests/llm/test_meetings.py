"""Meetings of near copies: the offsets of all, by few rows."""

import numpy as np
from pyspark.sql import functions as F

from brandloom.llm import audio
from brandloom.llm.common import stored


def near_copies(spark):
    r = np.random.default_rng(4)
    v, w = r.normal(size=64) / 8, r.normal(size=64) / 8
    rows = [(i * 10, (v + r.normal(size=64) / 200).tolist()) for i in range(60)] + [(601 + i, (w + r.normal(size=64) / 200).tolist()) for i in range(10)]
    asked = F.col("vec_id") % 50 == 0
    prints = stored(audio.fingerprints(audio.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asked), "vec_id", "wav"), "prints")
    return audio.classes(prints, "vec_id", (F.col("vec_id") >= 0) & asked)


def test_a_pair_meets_once_or_twice_an_offset(spark):
    met = audio._meetings(near_copies(spark)).where(audio._near()).select("q", "n", (F.col("_at") - F.col("q_at")).alias("offset"), (~audio._met_before()).alias("kept")).toPandas()
    key = ["q", "n", "offset"]
    all_of, kept = met[key].drop_duplicates(), met[met.kept][key]
    assert len(met) > 6 * len(met[["q", "n"]].drop_duplicates()) and len(kept) < 2 * len(all_of)
    assert set(map(tuple, all_of.values)) == set(map(tuple, kept.values))


def test_neighbouring_is_neighbours(spark):
    r = np.random.default_rng(5)
    a = [int(x) for x in r.integers(0, 1 << 32, 30, dtype=np.uint64)]
    pairs = [(x, int(y)) for x in a for y in r.choice(audio.neighbours(x), 20)] + [(x, x ^ (1 << i) ^ (1 << j)) for x in a for i in range(32) for j in range(0, 32, 3)] + [(a[0], a[1])]
    signed = [tuple(int(v) for v in np.array(p, dtype=np.uint32).view(np.int32)) for p in pairs]
    got = [x.v for x in spark.createDataFrame(signed, "a int, b int").coalesce(1).select(audio._neighbouring(F.col("a"), F.col("b")).alias("v")).collect()]
    want = [y in set(audio.neighbours(x).tolist()) for x, y in pairs]
    assert got == want and any(want) and not all(want)


def test_only_known_integers_leave_their_task(spark, monkeypatch):
    """Before, all some 300 neighbours of each integer were moved to a join that kept few; a table too full only lets more pass."""
    found, looked_up = near_copies(spark), {}

    def seen(df, label):
        looked_up[label] = stored(df, label)
        return looked_up[label]

    monkeypatch.setattr(audio, "stored", seen)
    met = [sorted(map(repr, audio.aligned(found).collect()))]
    known = {x.key for x in looked_up["keys"].collect()}
    hits = [x.key for x in looked_up["hits"].collect()]
    asked = sum(len(x.prints) for x in found.where("asked").collect())
    assert set(hits) & known and sum(x in known for x in hits) > 0.5 * len(hits) and len(hits) < 100 * asked
    monkeypatch.setattr(audio, "LEAST_BITS", 64)
    monkeypatch.setattr(audio, "MOST_BITS", 64)
    met.append(sorted(map(repr, audio.aligned(found).collect())))
    assert met[0] == met[1] and met[0] and looked_up["hits"].count() > 2 * len(hits)

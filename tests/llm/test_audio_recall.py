"""Recordings: the search against brute force over Spark, sampling rates, and damaged recordings."""

import io
import random
import wave

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brandloom.llm import audio, queries
from brandloom.llm.common import stored


def prints(samples, rate):
    return audio.integers(audio.chroma(samples, rate))


def brute_error(a_at, a, b_at, b):
    """The least share of differing bits over all offsets at which enough positions overlap; positions may have gaps."""
    judged = [audio.bit_error(a_at, a, b_at, b, s) for s in range(-70, 71)]
    return min((e for n, e in judged if n >= audio.OVERLAP), default=1)


def test_search_against_brute_force(spark):
    """Recall of the whole search over noisy, later and resampled copies, up to the accepted error."""
    r = np.random.default_rng(1)
    base = r.normal(size=(6, 64)) / 8
    rows = [(50 * i, v.tolist()) for i, v in enumerate(base)]
    for level in (160, 60, 40, 32, 26, 22):
        rows += [(len(rows) * 50 + 7 + len(rows), (v + r.normal(size=64) / level).tolist()) for v in base]
    asked = F.col("vec_id") % 50 == 0
    vectors = spark.createDataFrame([x for x in rows if x[0] % 50 or x[0] < 300], "vec_id long, embedding array<double>")
    held = stored(audio.fingerprints(audio.recordings(vectors, asked), "vec_id", "wav"), "prints")
    found = audio.classes(held, "vec_id", (F.col("vec_id") >= 0) & asked)
    got = {(x.q, x.n) for x in audio.aligned(found).collect() if x.q != x.n}
    parts = [(x.n, x.asked, np.array(x["at"], dtype=np.int32), np.array(x.prints, dtype=np.int32).view(np.uint32)) for x in found.collect()]
    errors = {(q, n): brute_error(a_at, a, b_at, b) for q, is_asked, a_at, a in parts if is_asked for n, _, b_at, b in parts if n != q}
    true = {k for k, e in errors.items() if e <= audio.ERROR}
    assert got <= true and len(true) > 25 and sum(errors[k] > 0.11 for k in true) >= 5
    assert len(got) >= 0.9 * len(true)


def test_edge_cases(spark):
    v = [float(x) for x in np.random.default_rng(2).normal(size=64) / 8]
    rows = [(50, v, 1), (51, v, 1), (52, v, 1), (52, v, 1), (100, v, 1), (100, v, 1), (150, None, 1), (151, [], 1), (152, [0.0] * 64, 1), (None, v, 1), (154, [x * -1 for x in v], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, prints int")
    played = vectors.select("vec_id", F.expr("transform(embedding, x -> x)").alias("embedding"), F.lit(0).alias("prints"))
    asked = F.col("vec_id") % 50 == 0
    held = stored(audio.fingerprints(audio.recordings(played, asked).where("not copy").drop("copy"), "vec_id", "wav"), "prints")
    got = sorted((x.vec_id or 0, x.is_query, x.n_matches, x.best_match) for x in audio.summary(held, asked, "vec_id").collect())
    # Ids 52 and 100 begin at once, 50 and 154 two steps later, and 51 three: four classes of the same sound at most.
    assert got == [(0, None, None, None), (50, True, 5, 51), (51, False, None, None), (52, False, None, None), (52, False, None, None), (100, True, 4, 50), (100, True, 4, 50), (150, True, 0, None), (151, False, None, None), (152, False, None, None), (154, False, None, None)]
    assert audio.summary(held.limit(0), asked, "vec_id").count() == 0


def test_every_query_of_the_table_finds_its_copy(spark):
    rows = queries.op8_audio(spark, "/root/testdata/sf0.01").where("is_query").collect()
    assert len(rows) == 10 and all(x.n_matches >= 1 for x in rows)
    vectors, asked = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), F.col("vec_id") % 50 == 0
    apart = audio.fingerprints(audio.recordings(vectors, asked), "vec_id", "wav")
    assert sorted(map(repr, audio.played_fingerprints(vectors, asked).collect())) == sorted(map(repr, apart.collect()))


def wav_of(samples, rate=8_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((samples * 32767).astype("<i2").tobytes())
    return out.getvalue()


WAV = audio.play([0.1] * 64, 1)


def test_cut_recordings_are_read_as_far_as_they_go():
    whole = audio.read_wav(WAV)
    for cut in (1, 2, 3, 45, 1001, len(WAV) - 30, len(WAV)):
        samples = audio.read_wav(WAV[: len(WAV) - cut])
        assert len(samples) <= len(whole) and (samples == whole[: len(samples)]).all()
    assert len(audio.read_wav(WAV[:-3])) == len(whole) - 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 255)), min_size=1, max_size=6))
def test_damaged_headers_are_read(damage):
    data = bytearray(WAV[:4000])
    for at, value in damage:
        data[at] = value
    samples, rate = audio.read_recording(bytes(data))
    assert audio.RATES[0] <= rate <= audio.RATES[1] and samples.ndim == 1


def test_rates_give_like_prints():
    def sound(rate):
        t = np.arange(4 * rate) / rate
        tones = [440, 494, 587, 659, 784, 880, 988, 523]
        return sum(np.sin(2 * np.pi * f * t) * (0.05 + 0.04 * np.sin(2 * np.pi * t * (k + 2) / 5)) for k, f in enumerate(tones))

    low, high = (prints(*audio.read_recording(wav_of(sound(rate), rate))) for rate in (8_000, 44_100))
    assert abs(len(low[0]) - len(high[0])) <= 1
    assert audio.bit_error(*low, *high, 0)[1] < 0.1
    both = np.repeat(sound(8_000), 2)
    assert (audio.read_wav(wav_of(both, 8_000, 2)) == audio.read_wav(wav_of(sound(8_000)))).all()


def test_neighbours_move_one_or_two_filters_by_a_level():
    r = random.Random(2)
    for _ in range(5):
        x = r.randrange(1 << 32)
        level = lambda y: [audio.GRAY.index(y >> (2 * k) & 3) for k in range(16)]
        got = audio.neighbours(x).tolist()
        assert len(set(got)) == len(got) and x in got
        for y in got:
            moved = [abs(a - b) for a, b in zip(level(x), level(y), strict=True) if a != b]
            assert moved in ([], [1], [1, 1])
        ways = [len([1 for b in (a - 1, a + 1) if 0 <= b < 4]) for a in level(x)]
        assert len(got) == 1 + sum(ways) + sum(ways[i] * ways[j] for i in range(16) for j in range(i))


def test_a_steady_tone_is_found(spark):
    """All positions of a steady tone have one integer: they meet at every offset, of which the least error counts."""
    t = np.arange(6 * audio.RATE) / audio.RATE
    tone = lambda n, f: sum(np.sin(2 * np.pi * f * k * t[: n * audio.RATE]) for k in (1, 1.26, 1.5)) * 0.2
    rows = [(0, bytearray(wav_of(tone(4, 440), audio.RATE))), (1, bytearray(wav_of(tone(6, 440), audio.RATE))), (2, bytearray(wav_of(tone(5, 311), audio.RATE)))]
    held = stored(audio.fingerprints(spark.createDataFrame(rows, "vec_id long, wav binary"), "vec_id", "wav"), "prints")
    got = {x.vec_id: x for x in audio.summary(held, F.col("vec_id") == 0, "vec_id").collect()}
    assert (got[0].n_matches, got[0].best_match) == (1, 1)

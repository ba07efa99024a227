"""Chroma audio fingerprints of a media column.

A recording (WAV, 16-bit PCM) becomes frames of twelve pitch-class energies, each scaled to length one. Over the integral
image of the frames, sixteen filters compare two regions of a window of SPAN frames; each value is cut into four levels,
written as two bits of a Gray code, so that one position gives one 32-bit integer. Windows that touch silence give none.
Frames and hops are as long in seconds at every sampling rate.

Recordings are found by an inverted index and aligned by histograms of offsets. Recordings of equal integers are one class
from the start. Each integer of a class that holds a query is looked up as it is, and with every one or two of its bits
changed that a move to a neighbouring level of one or two filters changes; the join with the integers of all classes, at
every STEP-th position of each, is Spark's. A meeting must hold around it as well (a share of NEAR differing bits over the
integers at the steps in AROUND, in the join itself), and then stands for the offset between its two positions. The join gives
a meeting only if the two recordings don't meet at the same offset LAGS positions before, as then it tells nothing new. At each
offset that has a meeting the differing bits of all positions decide: a pair matches at the offset with the least share of them,
if OVERLAP positions or more overlap there and the share is ERROR or less. The work follows the recordings and the pairs that
meet. A query in a group of near copies meets all of the group, mostly once an offset, however many positions they share.

Edge cases: a null, empty, unreadable, cut-off or silent recording has the integers of what can be read of it, and without
any matches nothing. Channels are averaged. Sampling rates outside RATES count as unreadable. Repeated rows are recordings
of their own with the same id. A query doesn't match rows of its own id. Null ids take no part in matching. An empty table
gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import functools
import io
import itertools
import struct
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RATE = 8_000
FRAME, HOP = 2_048, 500
SPAN = 8
QUIET = 1e-4
LEVEL = 0.1
#: Positions that must overlap, and the share of differing bits up to which recordings are alike: as far as the index finds nine in ten.
OVERLAP, ERROR = 16, 0.17
AROUND, NEAR = (-16, -12, -8, -4, 4, 8, 12, 16), 0.25
STEP = 3
#: How much earlier a meeting makes a later one needless: multiples of STEP, as positions are indexed so. SIDES is what that is judged by.
LAGS = (3, 6, 9, 12)
SIDES = tuple(s for s in range(min(AROUND) - max(LAGS), max(AROUND) + 1) if s)
RATES = (1_000, 400_000)
#: Of the bit table of the index's integers: bits for each, and the least and most in all (64 MB).
SPARSE, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 29

GRAY = (0, 1, 3, 2)
#: (kind, lowest pitch class, pitch classes, frames) of each filter; kind 0 halves by pitch, 1 by time, 2 is a chequerboard.
FILTERS = tuple((k % 3, (5 * k) % (13 - h), h, 4 if k % 2 else 8) for k, h in enumerate((2, 4, 6, 4, 2, 6, 8, 4, 2, 6, 4, 2, 8, 6, 4, 2)))


def read_wav(data: bytes | None) -> np.ndarray:
    """Samples from -1 to 1, channels averaged, at the recording's own rate."""
    return read_recording(data)[0]


def read_recording(data: bytes | None) -> tuple[np.ndarray, int]:
    """(samples as read_wav gives them, their rate)."""
    if not data:
        return np.zeros(0), RATE
    try:
        with wave.open(io.BytesIO(data)) as w:
            channels, rate = w.getnchannels(), w.getframerate()
            if w.getsampwidth() != 2 or not RATES[0] <= rate <= RATES[1]:
                return np.zeros(0), RATE
            held = w.readframes(min(w.getnframes(), len(data)))
            samples = np.frombuffer(held[: len(held) // 2 * 2], dtype="<i2") / 32768
            return samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1), rate
    except (wave.Error, EOFError, ValueError, RuntimeError, OverflowError, ZeroDivisionError, struct.error):  # damaged in one way or another
        return np.zeros(0), RATE


def _frame(rate: int) -> int:
    return max(1, round(FRAME * rate / RATE))


@functools.lru_cache(maxsize=4)
def _pitch_classes(rate: int) -> np.ndarray:
    """(bins, 12): which pitch class each frequency from 200 to 3500 Hz belongs to."""
    hz = np.fft.rfftfreq(_frame(rate), 1 / rate)
    out = np.zeros((len(hz), 12), dtype=np.float32)
    for k in np.flatnonzero((hz >= 200) & (hz <= 3500)):
        out[k, int(round(12 * np.log2(hz[k] / 440))) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) of unit length; zeros where it is silent."""
    frame = _frame(rate)
    if len(samples) < frame:
        return np.zeros((0, 12))
    starts = np.arange((len(samples) - frame) * RATE // (HOP * rate) + 1) * rate * HOP // RATE
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), frame)[starts] * np.hanning(frame).astype(np.float32)
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).astype(np.float32) @ _pitch_classes(rate)
    energy /= frame * frame / FRAME
    size = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(size > QUIET, energy / np.maximum(size, 1e-12), 0)


def integers(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, 32-bit integer) of each window of SPAN frames without silence."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0, t1, p0, p1):
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    for k, (kind, low, high, width) in enumerate(FILTERS):
        t, p = width // 2, low + high // 2
        if kind == 0:
            a, b = area(0, width, low, p), area(0, width, p, low + high)
        elif kind == 1:
            a, b = area(0, t, low, low + high), area(t, width, low, low + high)
        else:
            a, b = area(0, t, low, p) + area(t, width, p, low + high), area(t, width, low, p) + area(0, t, p, low + high)
        value = np.log1p(a) - np.log1p(b)
        level = (value > -LEVEL).astype(int) + (value > 0) + (value > LEVEL)
        out |= np.array(GRAY, dtype=np.uint32)[level] << np.uint32(2 * k)
    loud = np.concatenate(([0], np.cumsum(frames.any(axis=1))))
    whole = np.flatnonzero(loud[SPAN:] - loud[:-SPAN] == SPAN)
    return whole.astype(np.int32), out[whole]


PRINTS = "at array<int>, prints array<int>"


def _prints(rows, kind, id_col: str) -> pa.RecordBatch:
    """A batch of id, positions and integers of rows (id, recording)."""
    ids, at, prints = [], [], []
    for i, wav in rows:
        places, found = integers(chroma(*read_recording(wav)))
        ids.append(i)
        at.append(places)
        prints.append(found.view(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(at, pa.list_(pa.int32())), pa.array(prints, pa.list_(pa.int32()))], [id_col, "at", "prints"])


def fingerprints(media: DataFrame, id_col: str, wav_col: str) -> DataFrame:
    """id_col, at (positions) and prints (32-bit integers, signed) of every row."""

    def run(batches):
        for batch in batches:
            yield _prints(((i.as_py(), w.as_py()) for i, w in zip(batch.column(0), batch.column(1), strict=True)), batch.schema.field(0).type, id_col)

    return media.select(id_col, wav_col).mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, {PRINTS}")


def bit_error(a_at, a, b_at, b, offset: int) -> tuple[int, float]:
    """(overlap, share of differing bits) of two recordings when b lies `offset` positions later."""
    _, i, j = np.intersect1d(a_at + offset, b_at, assume_unique=True, return_indices=True)
    return (len(i), float(np.bitwise_count(a[i] ^ b[j]).mean() / 32)) if len(i) else (0, 1.0)


def _moves() -> list[list[int]]:
    """For each level of a filter the changes of its two bits that take it to a neighbouring level."""
    return [[GRAY[k] ^ GRAY[n] for n in (k - 1, k + 1) if 0 <= n < 4] for k in range(4)]


@functools.lru_cache(maxsize=1)
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """Changes of up to two bits, and for each the bits that say which integers it suits: (change, integer's bits that must be 1).

    A filter at an outer level has one neighbour, one at an inner level two.
    """
    single = [(change << (2 * k), GRAY[level] << (2 * k), 3 << (2 * k)) for k in range(len(FILTERS)) for level, changes in enumerate(_moves()) for change in changes]
    both = [(a | b, x | y, m | n) for (a, x, m), (b, y, n) in itertools.combinations(single, 2) if m != n]
    table = np.array([(0, 0, 0), *single, *both], dtype=np.uint32)
    return table[:, 0], table[:, 1:]


def neighbours(print_: int) -> np.ndarray:
    """The integer itself, and with one or two filters moved to a neighbouring level."""
    change, suits = _masks()
    x = np.uint32(print_)
    return x ^ change[(x & suits[:, 1]) == suits[:, 0]]


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where a bit table of so many bits (a power of two) has the keys."""
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1))


def _table(keys: DataFrame):
    """A broadcast bit table of the different keys there are: SPARSE bits a key, MOST_BITS at most, so that its size is bounded.

    What it holds by chance finds nothing in the join that follows; no key is missing.
    """
    spark = keys.sparkSession
    bits, most = LEAST_BITS, SPARSE * keys.count()
    while bits < min(MOST_BITS, most):
        bits *= 2

    def places(batches):
        for batch in batches:
            at = _place(batch.column(0).to_numpy().view(np.uint32), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "set"])

    words = keys.mapInArrow(places, "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()  # bits / 64 rows at most
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["word"].to_numpy()] = words["set"].to_numpy()
    return spark.sparkContext.broadcast(table.tobytes())


def _held(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the keys the bit table (as 64-bit words) has."""
    at = _place(keys, 64 * len(table))
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _probe(known):
    """key and the other columns: an entry of a query's class (whose first column is its integer) for each of the integer's neighbours that the bit table has."""

    def run(batches):
        table = np.frombuffer(known.value, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [neighbours(x) for x in part.column(0).to_numpy().view(np.uint32)]
                keys, rows = np.concatenate(found), np.repeat(np.arange(len(found)), [len(k) for k in found])
                held = _held(keys, table)
                yield pa.RecordBatch.from_arrays([pa.array(keys[held].view(np.int32)), *(c.take(pa.array(rows[held])) for c in part.columns[1:])], batch.schema.names)

    return run


def _judge(batches):
    """q, n, offset, overlap, error of each voted offset at which two recordings are alike."""
    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for q, n, offsets, a_at, a, b_at, b in zip(*columns, strict=True):
            a_at, b_at = np.array(a_at, dtype=np.int32), np.array(b_at, dtype=np.int32)
            a, b = np.array(a, dtype=np.int32).view(np.uint32), np.array(b, dtype=np.int32).view(np.uint32)
            for offset in offsets:
                overlap, error = bit_error(a_at, a, b_at, b, offset)
                if overlap >= OVERLAP and error <= ERROR:
                    out.append((q, n, offset, overlap, error))
        found = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["q", "n", "offset", "overlap", "error"])


def classes(prints: DataFrame, id_col: str, is_query) -> DataFrame:
    """A stored table of the different recordings: n, at, prints, copies, least and most (ids), and whether a query is among them."""
    rows = prints.where(F.col(id_col).isNotNull() & (F.size("prints") > 0))
    held = rows.groupBy("at", "prints").agg(F.count("*").alias("copies"), F.min(id_col).alias("least"), F.max(id_col).alias("most"), F.bool_or(F.coalesce(is_query, F.lit(False))).alias("asked"))
    return stored(held.withColumn("n", F.monotonically_increasing_id()), "classes")


def _side(step: int) -> str:
    return f"c{step}".replace("-", "_")


def _with_sides(rows: DataFrame, found: DataFrame, prefix: str = "") -> DataFrame:
    """rows (key, n and k, the place in its lists) with the position, its own integer and those at SIDES."""
    k = F.col("k")
    place = F.get("at", k)
    side = lambda step: F.when(F.get("at", k + step) == place + step, F.get("prints", k + step))
    both = rows.join(found.select("n", "at", "prints"), "n")
    return both.select("key", F.col("n").alias(prefix or "n"), place.alias(f"{prefix}_at"), F.get("prints", k).alias(f"{prefix}_own"), *[side(step).alias(f"{prefix}_{_side(step)}") for step in SIDES])


def _meetings(found: DataFrame) -> DataFrame:
    """q, q_at, n, _at and so on of positions of different classes that meet; what is looked up is held against a bit table of the index before it leaves its task."""
    entries = found.select("n", "asked", "at", F.posexplode("prints").alias("k", "key"))
    index = entries.where(F.get("at", F.col("k")) % STEP == 0).select("key", "n", "k")
    table = _table(stored(index.select("key").distinct(), "keys"))
    hits = stored(entries.where("asked").select("key", "n", "k").mapInArrow(_probe(table), "key int, n long, k int"), "hits")
    known = index.join(hits.select("key").distinct(), "key", "left_semi")
    return _with_sides(hits, found, "q").join(_with_sides(known, found), "key").where(F.col("q") != F.col("n"))


def _sides(step: int) -> tuple[Column, Column]:
    """The integers of a meeting's two recordings so many positions on, null where there are none."""
    name = f"_{_side(step)}" if step else "_own"
    return F.col(f"q{name}"), F.col(name)


def _near(shift: int = 0) -> Column:
    """Whether the meeting so many positions on holds around it."""
    differ = [F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) for a, b in (_sides(step + shift) for step in AROUND)]
    return sum((F.coalesce(x, F.lit(0)) for x in differ), F.lit(0)) <= sum((x.isNotNull().cast("int") for x in differ), F.lit(0)) * F.lit(32 * NEAR)


def _neighbouring(a: Column, b: Column) -> Column:
    """Whether b is among neighbours(a); of a filter's two bits the higher moves by a level only beside a lower one."""
    low = 0x55555555
    a, change = a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftright(change, 1).bitwiseAND(F.lit(low))
    return (F.bit_count(change) <= 2) & (high.bitwiseAND(change) == 0) & (high.bitwiseAND(F.bitwise_not(a)) == 0)


def _met_before() -> Column:
    """Whether the two recordings meet at one of LAGS before, at the same offset."""
    return functools.reduce(Column.__or__, [F.coalesce(_neighbouring(*_sides(-lag)) & _near(-lag), F.lit(False)) for lag in LAGS])


def aligned(found: DataFrame) -> DataFrame:
    """q, n, offset, overlap, error for each class q with a query and each class n that it matches; q itself is one, if it is long enough."""
    met = _meetings(found).where(_near() & ~_met_before())
    offsets = met.groupBy("q", "n").agg(F.array_sort(F.collect_set(F.col("_at") - F.col("q_at"))).alias("offsets"))  # two recordings have as many as they have positions
    a, b = (found.select(F.col("n").alias(k), F.col("at").alias(f"{k}_at"), F.col("prints").alias(f"{k}_prints")) for k in ("q", "n"))
    judged = offsets.join(a, "q").join(b, "n").select("q", "n", "offsets", "q_at", "q_prints", "n_at", "n_prints").mapInArrow(_judge, "q long, n long, offset int, overlap int, error double")
    best = judged.groupBy("q", "n").agg(F.min(F.struct("error", (-F.col("overlap")).alias("o"), "offset")).alias("b")).select("q", "n", "b.offset", (-F.col("b.o")).alias("overlap"), "b.error")
    own = found.where(F.col("asked") & (F.size("prints") >= OVERLAP)).select(F.col("n").alias("q"), "n", F.lit(0).alias("offset"), F.size("prints").alias("overlap"), F.lit(0.0).alias("error"))
    return best.unionByName(own)


# Recordings for tables that have none.

_STEPS, _STEP = 16, 2_000
#: What the altered copies take in turn.
COPY_PARTS, COPY_RATES = (160, 80, 40, 30, 25), (8_000, 11_025, 16_000)


@functools.lru_cache(maxsize=1)
def _tones() -> np.ndarray:
    t = np.arange(_STEPS * _STEP) / RATE
    return np.stack([np.sin(2 * np.pi * 440 * 2 ** (c / 12) * t) for c in range(12)]).reshape(12, _STEPS, _STEP).astype(np.float32)


def play(vector: list[float] | None, rests: int) -> bytes | None:
    """A WAV recording of a vector: `rests` silent steps, then sixteen chords whose loudness its numbers give."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([x or 0 for x in vector], dtype=np.float32))
    loud = np.clip(v[(np.arange(_STEPS)[:, None] * 5 + np.arange(12)[None, :] * 7) % len(v)] * 0.6, 0, 0.08)
    sound = np.concatenate([np.zeros(rests * _STEP), np.einsum("sc,cst->st", loud, _tones()).ravel()])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.clip(sound, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def altered(vector: list[float] | None, rests: int) -> bytes | None:
    """A copy that a search has to find: the vector with noise in its numbers, played at another rate with noise in the sound.

    What is done depends on the vector alone, so that equal vectors have equal copies.
    """
    if not vector:
        return None
    seed = zlib.crc32(np.array([x or 0 for x in vector], dtype="<f8").tobytes())
    parts, rate, r = COPY_PARTS[seed % len(COPY_PARTS)], COPY_RATES[seed // 7 % len(COPY_RATES)], np.random.default_rng(seed)
    samples, own = read_recording(play([(x or 0) + n for x, n in zip(vector, r.normal(0, 1 / parts, len(vector)), strict=True)], rests))
    sound = np.interp(np.arange(len(samples) * rate // own) * (own / rate), np.arange(len(samples)), samples)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(sound + r.normal(0, 0.002, len(sound)), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _played(rows):
    """(id, whether it is an altered copy, recording) of rows (id, vector, whether a query)."""
    for i, v, asked in rows:
        yield i, False, play(v, (i or 0) % 4)
        if asked and i is not None:
            yield -1 - i, True, altered(v, (i + 1) % 4)


def _dealt(vectors: DataFrame, is_query, id_col: str, vector_col: str) -> DataFrame:
    """id, vector and whether a query, dealt to all cores, as a recording is much more work than its row is long."""
    spark = vectors.sparkSession
    rows = vectors.select(id_col, vector_col, F.coalesce(is_query, F.lit(False)).alias("asked"))
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def recordings(vectors: DataFrame, is_query, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """id_col, copy and wav: a recording of each vector, begun a little later for some ids than for others.

    For each vector of a query there is an altered copy besides (copy is true, the id -1 - id): later, noisy, at another rate.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):  # a recording is some 70 kB
                made = list(_played(zip(*(batch.column(k).slice(at, 100).to_pylist() for k in range(3)), strict=True)))
                ids, copies, wavs = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(copies, pa.bool_()), pa.array(wavs, pa.binary())], [id_col, "copy", "wav"])

    return _dealt(vectors, is_query, id_col, vector_col).mapInArrow(run, f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, copy boolean, wav binary")


def played_fingerprints(vectors: DataFrame, is_query, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """fingerprints of recordings, in one pass, so that no recording leaves the task that plays it."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                made = _played(zip(*(batch.column(k).slice(at, 500).to_pylist() for k in range(3)), strict=True))
                yield _prints(((i, wav) for i, _, wav in made), batch.schema.field(0).type, id_col)

    return _dealt(vectors, is_query, id_col, vector_col).mapInArrow(run, f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, {PRINTS}")


def summary(prints: DataFrame, is_query, id_col: str) -> DataFrame:
    """The op8 query's row for each recording: its fingerprint, and for queries how many others it aligns with, and the best.

    prints: a stored table of fingerprints. A class of equal recordings is named by its least id; for that id itself by its greatest.
    """
    found = classes(prints, id_col, is_query)
    pairs = stored(aligned(found), "pairs")
    asked = prints.where(is_query & F.col(id_col).isNotNull() & (F.size("prints") > 0)).groupBy(F.col(id_col).alias("id"), "at", "prints").count()
    asked = stored(asked.join(found.select("n", "at", "prints"), ["at", "prints"]).select("id", F.col("n").alias("q"), "count"), "asked")
    own = asked.select("id", F.col("q").alias("n"), F.col("count").alias("own"))
    named = F.when(F.col("least") != F.col("id"), F.col("least")).when(F.col("most") != F.col("id"), F.col("most"))
    met = asked.select("id", "q").join(pairs, "q").join(found.select("n", "copies", "least", "most"), "n").join(own, ["id", "n"], "left")
    best = met.groupBy("id", "q").agg(F.sum(F.col("copies") - F.coalesce("own", F.lit(0))).alias("n_of"), F.min(F.when(named.isNotNull(), F.struct("error", named.alias("match"), "offset"))).alias("b"))
    best = best.join(found.select(F.col("n").alias("q"), F.col("at").alias("__at"), F.col("prints").alias("__prints")), "q")
    rows = prints.join(best, (prints[id_col] == best["id"]) & (prints["at"] == best["__at"]) & (prints["prints"] == best["__prints"]), "left")
    return rows.select(
        id_col, F.size("prints").cast("long").alias("n_prints"), F.sha2(F.array_join("prints", ","), 256).alias("prints_sha256"), is_query.alias("is_query"),
        F.when(is_query, F.coalesce("n_of", F.lit(0))).cast("long").alias("n_matches"), F.col("b.match").alias("best_match"), F.col("b.offset").alias("best_offset"), F.col("b.error").alias("best_error"),
    )

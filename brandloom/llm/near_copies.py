"""Near copies: SimHash fingerprints and anchor-point covering at a similarity of 0.8 over 5-word shingles.

Texts are lower-cased (A-Z) and split at white space; texts of equal words are one from the start. Two texts are linked if
their sets of shingles have a Jaccard similarity of `least` (0.8) or more. A text of fewer words than a shingle is one
shingle; texts without words are equal.

Texts that are so alike differ in about 10 of 64 SimHash bits, too many for one covering code. So a text has SUBS
fingerprints of 31 bits, and one of 64 bits as its signature. For each of the 31-bit ones the anchors are the code words of
the Hamming code of length 31, perfect with covering radius 1: a fingerprint is replicated to the (at most 16) anchors
within covering radius plus half the threshold of 2, so that fingerprints within 2 always meet, and some within 4. Texts
that meet at an anchor are compared by signature (FAR bits at most) and give the links of a spanning forest. At a
similarity of exactly 0.8 two texts miss each other at all anchors once in 35 times, at 0.85 once in 300.

The components of these links hold more than is alike enough, so that the sets themselves decide in them: what a component
holds is compared in one task by an index of its shingles, breadth first, up to WEIGHT shingles; a larger component is dealt
to blocks of half of that, and every two blocks are a task of their own, which costs more but leaves no pair out.

Edge cases: a null text is as an empty one. Rows with a null id take no part and stay. Rows that share an id but not their
words are documents of their own. An empty table gives an empty result. Very long texts are sketched in pieces. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import components
from .common import blobs, drop_stored, stored
from .simhash import LOWER, anchors

SHINGLE = 5
LEAST = 0.8
SEED = 42
SUBS, LENGTH = 16, 31
FAR = 18
WEIGHT = 2_000_000
#: Links that a task holds before it gives out what connects as much.
PENDING = 1_000_000
#: Rows of an anchor that are compared each with each; more go breadth first.
FEW = 8

_MIX = np.random.default_rng(20).integers(0, 1 << 64, size=(SUBS // 2 + 1, 1), dtype=np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.translate(LOWER).split()))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    begins = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)], dtype=np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SUBS / 2 words of two 31-bit fingerprints each (bits 1 to 31 and 33 to 63), then the signature."""
    votes = np.zeros(len(_MIX) * 64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so that a byte holds a count
        h = hashes[at : at + 255][None, :] + _MIX
        h = (h ^ (h >> np.uint64(30))) * _C1
        h = (h ^ (h >> np.uint64(27))) * _C2
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(np.ascontiguousarray(h.T).view(np.uint8).reshape(h.shape[1], -1), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)


def sub_anchors(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, anchor) for each anchor of each of the SUBS fingerprints; sketches: one row a text."""
    rows, found = [], []
    for k in range(SUBS):
        own = sketches[:, k // 2] >> np.uint64(32 * (k % 2)) & np.uint64((1 << 32) - 2)
        row, anchor = anchors(own, LENGTH)
        rows.append(row)
        found.append(anchor | np.uint64(k << 32))
    return np.concatenate(rows), np.concatenate(found)


def near_within(signatures: np.ndarray, far: int = FAR) -> list[tuple[int, int]]:
    """Links of a spanning forest over numbers of signatures, of which those within far are linked."""
    left, links = np.arange(len(signatures)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(signatures[left] ^ signatures[x]) <= far
            if near.any():
                links += [(x, y) for y in left[near].tolist()]
                queue += left[near].tolist()
                left = left[~near]
    return links


def alike_within(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links of a spanning forest over numbers of sets, of which those with a Jaccard similarity of least or more are linked."""
    size = np.array([len(s) for s in sets])
    left, links = np.ones(len(sets), dtype=bool), []
    index: list = []

    def rebuild():
        own = np.flatnonzero(left)
        owner = np.repeat(own, size[own])
        values = np.concatenate([sets[i] for i in own]) if len(own) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(values, kind="stable")
        index[:] = [values[order], owner[order], len(own)]

    def near(x):
        values, owner, _ = index
        low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        return np.flatnonzero(left & (shared >= least * (size + size[x] - shared) - 1e-9) & ((shared > 0) | (size + size[x] == 0)))

    rebuild()
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue and left.any():
            if 2 * left.sum() < index[2]:
                rebuild()
            x = queue.pop()
            found = near(x)
            left[found] = False
            links += [(x, y) for y in found.tolist()]
            queue += found.tolist()
    return links


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _digests(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([words_digest(t) for t in blobs(batch.column(1))], pa.binary())], [*batch.schema.names, "key"])


def _replicate(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), blobs(batch.column(1))
        for at in range(0, len(texts), 500):
            sets = [shingles(t) for t in texts[at : at + 500]]
            sketches = np.array([sketch(s) for s in sets], dtype=np.uint64).reshape(len(sets), len(_MIX))
            row, anchor = sub_anchors(sketches)
            yield pa.RecordBatch.from_arrays([_signed(anchor), pa.array(ids[at : at + 500][row]), _signed(sketches[row, -1])], ["anchor", "n", "signature"])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (u, v) connect: each number with the least of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _compare(batches):
    """(u, v) within the runs of equal anchors of a partition that is sorted by anchor, as stars, so that partitions give like links."""
    held: list = []
    pending, n_pending = [], 0

    def links(anchor, n, signature):
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.concatenate((first, [len(anchor)])))
        run = np.repeat(np.arange(len(first)), size)
        u, v = [], []
        for lag in range(1, FEW):
            i = np.flatnonzero((run[lag:] == run[:-lag]) & (size[run[lag:]] <= FEW))
            i = i[np.bitwise_count(signature[i] ^ signature[i + lag]) <= FAR]
            u.append(n[i])
            v.append(n[i + lag])
        for k in np.flatnonzero(size > FEW):
            own = slice(first[k], first[k] + size[k])
            found = np.array(near_within(signature[own]), dtype=np.int64).reshape(-1, 2)
            u.append(n[own][found[:, 0]])
            v.append(n[own][found[:, 1]])
        return stars(np.concatenate(u), np.concatenate(v))

    def joined():
        return pa.RecordBatch.from_arrays(list(map(pa.array, stars(*(np.concatenate(c) for c in zip(*pending, strict=True))))), ["u", "v"])

    for batch in batches:
        columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        held = [np.concatenate(c) for c in zip(held, columns, strict=True)] if held else columns
        last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last run may go on in the next batch
        if last:
            pending.append(links(*(c[:last] for c in held)))
            held = [c[last:] for c in held]
            n_pending += len(pending[-1][0])
            if n_pending > PENDING:
                yield joined()
                pending, n_pending = [], 0
    if held and len(held[0]):
        pending.append(links(*held))
    if pending:
        yield joined()


def _decide(least: float):
    """(u, v) within each run of equal units of a partition that is sorted by unit; rows: unit (long, int, int), n, text."""

    def run(batches):
        unit, ids, sets = None, [], []

        def links():
            found = np.array(alike_within(sets, least), dtype=np.int64).reshape(-1, 2)
            own = np.array(ids, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[found[:, 0]]), pa.array(own[found[:, 1]])], ["u", "v"])

        for batch in batches:
            for key, n, text in zip(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), batch.column(3).to_pylist(), blobs(batch.column(4)), strict=True):
                if key != unit:
                    if len(ids) > 1:
                        yield links()
                    unit, ids, sets = key, [], []
                ids.append(n)
                sets.append(shingles(text))
        if len(ids) > 1:
            yield links()

    return run


def links_of(texts: DataFrame, least: float = LEAST, weight: int | None = None) -> DataFrame:
    """(u, v): enough links to connect the texts that are alike. texts: a stored table of n (long) and text, each text once."""
    weight = weight or WEIGHT
    spread = texts.select("n", "text").mapInArrow(_replicate, "anchor long, n long, signature long")
    near = spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "u long, v long").distinct()
    groups = components(near)  # stores the links first: the anchors' shuffle, as large as the documents, goes with that
    # Words bound shingles from above.
    members = stored(texts.join(groups, texts["n"] == groups["node"]).select("n", "text", "root", (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\S", "")) + 1).alias("w")), "members")
    heavy = members.groupBy("root").agg(F.ceil(F.sum("w") * 2 / weight).cast("int").alias("blocks")).where("blocks > 2")
    dealt = members.join(heavy, "root", "left").withColumn("own", F.pmod(F.xxhash64("n"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))))
    units = dealt.select("root", "n", "text", "own", other.alias("other")).select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "n", "text")
    found = stored(units.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(_decide(least), "u long, v long").distinct(), "alike")
    drop_stored(members)
    return found


def _grouped(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """id, key (of the words) and the component's least (id, key), once for each id and key."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keys = stored(rows.mapInArrow(_digests, f"id {kind}, text string, key binary").groupBy("id", "key").agg(F.count("*").alias("copies")), "keys")
    distinct = stored(keys.groupBy("key").agg(F.min("id").alias("first")).withColumn("n", F.monotonically_increasing_id()), "distinct")
    digested = rows.mapInArrow(_digests, f"id {kind}, text string, key binary")
    chosen = digested.join(distinct.withColumnRenamed("key", "k"), (F.col("id") == F.col("first")) & (F.col("key") == F.col("k")))
    texts = stored(chosen.groupBy("n").agg(F.min("text").alias("text")), "texts")
    found = components(links_of(texts, least))
    drop_stored(texts)
    rooted = distinct.join(found, distinct["n"] == found["node"], "left").select("key", F.struct(F.col("first").alias("id"), F.col("key").alias("key")).alias("first"), F.coalesce("root", "n").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root").select("key", "least")
    return keys.join(named, "key")


def near_copies(docs: DataFrame, id_col="doc_id", text_col="text", least: float = LEAST) -> DataFrame:
    """id_col and component_id (the least id reachable over links), once for each id and its different texts."""
    return _grouped(docs, id_col, text_col, least).select(F.col("id").alias(id_col), F.col("least.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", least: float = LEAST) -> DataFrame:
    """docs with all their columns, less all but one document of each component: that of the least id.

    Of rows with this id and the same words the first by all columns stays. Rows with a null id stay.
    """
    kind = StructType().add("id", docs.schema[id_col].dataType).add("text", "string").add("row", docs.schema).add("key", "binary")
    named = docs.where(F.col(id_col).isNotNull())
    groups = _grouped(named, id_col, text_col, least)
    kept = stored(groups.where((F.col("id") == F.col("least.id")) & (F.col("key") == F.col("least.key"))).select(F.col("id").alias("__id"), F.col("key").alias("__key"), "copies"), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    digested = named.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.alias("row")).mapInArrow(_digests, kind)
    first = digested.join(kept, (F.col("id") == F.col("__id")) & (F.col("key") == F.col("__key"))).select("id", "key", "copies", "row")
    once = first.where("copies = 1").select("row")
    repeated = first.where("copies > 1").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(repeated).select("row.*").unionByName(docs.where(F.col(id_col).isNull()))

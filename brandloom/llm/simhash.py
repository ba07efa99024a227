"""SimHash near-duplicates, searched by anchor-point covering.

Fingerprints: 64 bits from the 3-word shingles of a text, each hashed by XXH64 (seed 42). A bit is set if it is set in
over half of the shingles' hashes.

Search: the anchors are the code words of the Hamming code of length 63 (bits 1 to 63 of a fingerprint; bit 0 is left
out). The code is perfect with covering radius 1, so any fingerprint is within 1 of an anchor. Two fingerprints within 2
of each other have a point within 1 of both, and the anchor that covers this point is within 2 of both: replicating each
fingerprint to every anchor within RADIUS + THRESHOLD / 2 = 2 of it (at most 32) makes every linked pair meet. Equal
fingerprints are one row, so an anchor gets at most 2 * (1 + 63 + 63 * 31) of them, whatever the table holds. Each anchor
returns the links of a spanning forest of what it holds; the components of all links are found by large-star and
small-star steps over tables, and never on the driver.

Edge cases: a text without words, or null, has fingerprint zero and is linked like any other. Repeated rows are each
returned. Rows with a null id take part; a component of such rows alone has a null component_id. Other columns play no
part. The threshold is 0, 1 or 2 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import blobs, stored

SHINGLE = 3
SEED = 42
THRESHOLD = 2
PIECE = 50_000

#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    view, digest = joined, xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begins[at : at + PIECE], ends[at : at + PIECE], strict=True)], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed([fingerprint(t) for t in blobs(batch.column(1))])], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


_BIT = np.array([np.uint64(1) << np.uint64(i) for i in range(64)], dtype=np.uint64)


def anchors(fps: np.ndarray, length: int = 63) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint's number, anchor) for every anchor within 2 of bits 1 to length (2**k - 1) of each fingerprint."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=length + 1)
    syndrome = np.bitwise_xor.reduce(np.where(bits == 1, np.arange(length + 1, dtype=np.uint8), 0), axis=1)
    points = fps & np.uint64((1 << length + 1) - 2)
    rows, found = [], []
    for s in np.unique(syndrome):
        own = np.flatnonzero(syndrome == s)
        flips = np.zeros(1, dtype=np.uint64)  # a code word is its only anchor within 2: others differ from it in 3 bits or more
        if s:
            i = np.arange(1, length + 1, dtype=np.uint8)
            i = i[(i ^ s) > i]
            flips = np.concatenate(([_BIT[s]], _BIT[i] | _BIT[i ^ s]))
        rows.append(np.repeat(own, len(flips)))
        found.append((points[own][:, None] ^ flips[None, :]).ravel())
    return np.concatenate(rows), np.concatenate(found)


def _replicate(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), PIECE // 8):
            part = fps[at : at + PIECE // 8]
            rows, found = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(part[rows].view(np.int64))], ["anchor", "fp"])


def forest(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over fingerprints of which those within threshold are linked."""
    left, links = fps, []
    while len(left) > 1:  # one component at a time, breadth first
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= threshold
            for y in left[near]:
                links.append((int(x), int(y)))
                queue.append(y)
            left = left[~near]
    return links


def _compare(threshold: int):
    """Links within each run of equal anchors of a partition that is sorted by anchor."""

    def run(batches):
        held = None
        for batch in batches:
            pair = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            held = pair if held is None else np.concatenate([held, pair], axis=1)
            last = np.searchsorted(held[0], held[0][-1]) if held.shape[1] else 0  # the last run may go on in the next batch
            yield from links(held[:, :last])
            held = held[:, last:]
        if held is not None:
            yield from links(held)

    def links(pair):
        if pair.shape[1] < 2:
            return
        edge = np.flatnonzero(np.concatenate(([True], pair[0][1:] != pair[0][:-1], [True])))
        found = []
        for k in np.flatnonzero(np.diff(edge) > 1):
            found += forest(pair[1][edge[k] : edge[k + 1]].view(np.uint64), threshold)
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([_signed(u), _signed(v)], ["u", "v"])

    return run


def linked(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): enough links between distinct fingerprints (column fp) to connect what is within threshold."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover thresholds of 0 to 2 bits")
    spread = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(threshold), "u long, v long").where("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold: int = THRESHOLD) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id (the least id reachable over links) for every row."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    found = components(linked(distinct, threshold))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

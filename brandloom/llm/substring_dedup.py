"""Exact removal of long repeated spans, by De Bruijn compaction.

Token k-mers are the edges of a De Bruijn graph over the whole corpus. Every window of `span` words contains `span`-k+1
of them, and is assigned to the one with the least hash (the leftmost on ties), which depends on its words alone. So
equal windows of different documents meet at equal k-mers, and only about one k-mer in twenty has to be moved. Windows
that follow each other and share a k-mer form a path of the graph, written once with its source coordinates
(document, first window, number of windows) and two hashes of all words along it, one summed over the words' hashes and
one over the words themselves (64 bits each); a path that a document repeats is one row. Paths are alike if both agree.

1. Paths are grouped by k-mer in Spark. A k-mer met in one document only is dropped.
2. The others are the edges of the graph. Where all paths through a k-mer are alike, its ends are nodes with an in-degree and
   an out-degree: how many k-mers come before it, and after it, in the documents that have it (the ends of documents count).
   Where one k-mer always leads to one other, and this always comes from it, both become one path: runs of such k-mers are
   compacted by pointer-doubling joins, each to its first k-mer and a distance from there. A compacted path has one source,
   its smallest document; the words at the source's coordinates go to every later document, which loses the path if it has
   the same words at its own.
3. Where the paths through a k-mer differ, one source of each distinct path is looked up at its coordinates, and each of its
   windows is digested (128 bits, over the words themselves); windows meet by digest, which gives the smallest document of
   each. All sources of a path then lose the windows whose smallest document comes before them.

Windows are judged on the input, so the order of removal plays no part. No step gathers a k-mer's or a digest's rows in
one task: they are aggregated before the shuffle, and joined by joins that AQE can split.

Edge cases: null and empty texts, and texts of fewer than `span` words, lose nothing. Rows with a null id are returned
unchanged and remove nothing elsewhere. Rows that share an id don't remove each other's words. Repeated rows are each
returned. Texts and words of any length are read whole. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blobs, drop_stored, stored

SPAN = 50
EDGE = 12
CHUNK_WORDS = 150_000
#: Words whose hashes a task keeps, and the longest of them, so that its memory is bounded.
KNOWN_WORDS, LONGEST_WORD = 400_000, 64

_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ROOT = 0xD1342543DE82EF95
_BACK = pow(_ROOT, -1, 1 << 64)


class WordHash(dict):
    """word -> XXH64; forgotten when there are KNOWN_WORDS of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C2
    return x ^ (x >> np.uint64(29))


def edge_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each position on, by doubling."""
    known, size, out, done = tokens, 1, None, 0
    while size <= k:
        if k & size:
            out = known if out is None else _mix(out[: len(known) - done]) * _C1 + known[done : done + len(out)][: len(known) - done]
            done += size
        if size * 2 <= k:
            known = _mix(known[:-size]) * _C1 + known[size:]
        size *= 2
    return _mix(out * _C3)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each `width` values in a row, by doubling."""
    at = np.arange(len(values), dtype=np.int32)
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = values[:-step], values[step:]
        at = np.where(right < left, at[step:], at[:-step])
        values = np.minimum(left, right)
        size += step
    return at


def paths(words_of_docs: list[list[bytes]], known: WordHash, span: int = SPAN, k: int = EDGE):
    """(document's number, k-mer's hash, path's hash, first window, windows) as arrays, for all paths of the documents."""
    sizes = np.array([len(w) for w in words_of_docs], dtype=np.int64)
    total = int(sizes.sum())
    if total < span:
        return None
    tokens = np.fromiter((known[w] for words in words_of_docs for w in words), dtype=np.uint64, count=total)
    first = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    starts = np.flatnonzero(doc[: total - span + 1] == doc[span - 1 :])
    if not len(starts):
        return None
    edges = edge_hashes(tokens, k)
    chosen = leftmost_least(edges, span - k + 1)[starts]
    run = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[starts[1:]] != doc[starts[:-1]]))))
    begin = starts[run]
    windows = np.diff(np.concatenate((run, [len(starts)])))
    end = begin + windows + span - 1
    powers = np.full(total + 1, _BACK, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mix(tokens * _C3) * powers[:-1])))
    lift = np.full(total + 1, _ROOT, dtype=np.uint64)
    lift[0] = 1
    np.multiply.accumulate(lift, out=lift)
    whole = _mix((sums[end] - sums[begin]) * lift[begin] + windows.astype(np.uint64) * _C1)
    return doc[begin], edges[chosen[run]].view(np.int64), whole.view(np.int64), (begin - first[doc[begin]]).astype(np.int32), windows.astype(np.int32)


def once_a_document(found):
    """paths' arrays with one entry for each document and path: its first place, and a list of its other places or None.

    A line that a document repeats has the same few paths over and over; they are one row each.
    """
    order = np.lexsort((found[3], *found[5:], *found[2::-1]))
    doc, edges, whole, first, windows, *proof = (x[order] for x in found)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (edges[1:] != edges[:-1]) | (whole[1:] != whole[:-1])))
    for p in proof:
        new[1:] |= p[1:] != p[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((heads, [len(doc)])))
    others = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes - 1))).astype(np.int32)), pa.array(first[~new]), mask=pa.array(sizes == 1))
    return doc[heads], edges[heads], whole[heads], first[heads], windows[heads], others, *(p[heads] for p in proof)


def proofs(words_of_docs: list[list[bytes]], found, span: int = SPAN) -> np.ndarray:
    """Hash of the words themselves along each path of paths' arrays."""
    doc, _, _, first, windows = (x.tolist() for x in found)
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(words_of_docs[d][f : f + w + span - 1])) for d, f, w in zip(doc, first, windows, strict=True)], dtype=np.uint64).view(np.int64)


def _find_paths(span: int):
    def run(batches):
        known = WordHash()
        for batch in batches:
            texts = blobs(batch.column(2))
            at = 0
            while at < len(texts):
                held, n, begin = [], 0, at
                while at < len(texts) and (not held or n < CHUNK_WORDS):
                    words = texts[at].split()
                    n += len(words)
                    held.append(words)
                    at += 1
                if (found := paths(held, known, span)) is not None:
                    found = once_a_document((*found, proofs(held, found, span)))
                    rows = pa.array(found[0] + begin)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, found[1:5]), found[5], pa.array(found[6])], ["id", "body", "edge", "path", "first", "windows", "others", "proof"])

    return run


def _digest_windows(span: int):
    def run(batches):
        for batch in batches:
            ids, edges, whole, proof, offsets, digests = [], [], [], [], [], []
            for i, (text, sources) in enumerate(zip(blobs(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                words = text.split()
                for s in sources:
                    for o in range(s["windows"]):
                        ids.append(i)
                        edges.append(s["edge"])
                        whole.append(s["path"])
                        proof.append(s["proof"])
                        offsets.append(o)
                        digests.append(hashlib.blake2b(b" ".join(words[s["first"] + o : s["first"] + o + span]), digest_size=16).digest())
                if len(ids) > 50_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(edges, pa.int64()), pa.array(whole, pa.int64()), pa.array(proof, pa.int64()), pa.array(offsets, pa.int32()), pa.array(digests, pa.binary())], ["id", "edge", "path", "proof", "offset", "digest"])
                    ids, edges, whole, proof, offsets, digests = [], [], [], [], [], []

    return run


def _words_at(span: int):
    """path and its words, for the paths (path, first, windows) whose source a document is."""

    def run(batches):
        for batch in batches:
            names, said = [], []
            for text, sources in zip(blobs(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                names += [s["path"] for s in sources]
                said += [b" ".join(words[s["first"] : s["first"] + s["windows"] + span - 1]) for s in sources]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(said, pa.binary())], ["path", "said"])

    return run


def _cut(span: int):
    """The documents without the spans; a span that tells its words is cut only where the document has them."""

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(blobs(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                total = len(words)
                if spans:
                    edge = np.zeros(total + 1, dtype=np.int32)
                    for s in spans:
                        n, said = s["windows"] + span - 1, s["said"]
                        for f in (s["first"], *(s["others"] or ())):
                            if said is None or b" ".join(words[f : f + n]) == said:
                                edge[f] += 1
                                edge[f + n] -= 1
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                n_words.append(total)
                n_removed.append(total - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def degrees(straight: DataFrame) -> DataFrame:
    """edge, windows, and the one k-mer that always follows it (next) or precedes it (prev), null if the end of the edge branches.

    straight: the paths of k-mers all of whose paths are alike. A k-mer that a document has more than once branches.
    """
    place = Window.partitionBy("id", "body").orderBy("first", "edge")
    once = F.col("others").isNull()
    rows = straight.select("id", "body", "edge", "first", "windows", once.alias("once"))
    for name, step in (("next", F.lead), ("prev", F.lag)):
        there = F.struct(*[step(c).over(place).alias(c) for c in ("edge", "first", "windows", "once")])
        rows = rows.withColumn(f"__{name}", there)
    follows = F.col("once") & F.col("__next.once") & (F.col("__next.first") == F.col("first") + F.col("windows"))
    preceded = F.col("once") & F.col("__prev.once") & (F.col("first") == F.col("__prev.first") + F.col("__prev.windows"))
    rows = rows.select("edge", "windows", F.when(follows, F.col("__next.edge")).alias("next"), F.when(preceded, F.col("__prev.edge")).alias("prev"))
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c)  # noqa: E731  degree one
    return rows.groupBy("edge").agg(F.max("windows").alias("windows"), only("next"), only("prev"))


def compacted(nodes: DataFrame) -> DataFrame:
    """edge and path for every k-mer of degrees: the first k-mer of the nonbranching run that it is in."""
    before = nodes.select(F.col("edge").alias("prev"), F.col("next").alias("__next"))
    linked = nodes.where("prev is not null").join(before, "prev").where(F.col("__next") == F.col("edge")).select("edge", F.col("prev").alias("path"))
    state = stored(nodes.select("edge").join(linked, "edge", "left").select("edge", F.coalesce("path", "edge").alias("path")), "compacted")
    while True:  # as often as the longest run's length can be halved
        far = state.select(F.col("edge").alias("path"), F.col("path").alias("__far"))
        new = stored(state.join(far, "path").select("edge", F.col("__far").alias("path"), (F.col("__far") != F.col("path")).alias("moved")), "compacted")
        moved = new.where("moved").limit(1).count()
        drop_stored(state)
        state = new
        if not moved:
            return state.select("edge", "path")


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", span: int = SPAN) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, and kept: the words that stay, joined by one space."""
    body = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"), F.col(text_col).alias("text"))
    named = rows.where(F.col("id").isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()

    found = stored(named.mapInArrow(_find_paths(span), f"id {kind}, body long, edge long, path long, first int, windows int, others array<int>, proof long"), "paths")
    met = found.groupBy("edge").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("path").alias("p0"), F.max("path").alias("p1"), F.min("proof").alias("q0"), F.max("proof").alias("q1"))
    # As a table of its own, so that the join deals both sides anew and AQE can split a k-mer that is met very often.
    met = stored(met.where("least < most").select("edge", "least", ((F.col("p0") != F.col("p1")) | (F.col("q0") != F.col("q1"))).alias("branches")), "met")
    repeated = stored(found.join(met, "edge"), "repeated")
    drop_stored(found, met)

    straight = repeated.where(~F.col("branches"))
    paths_of = compacted(stored(degrees(straight), "nodes"))
    # A document has every k-mer of a compacted path, one after the other; repeated rows have them twice.
    held = stored(straight.drop("path").join(paths_of, "edge").groupBy("id", "body", "path").agg(F.min("first").alias("first"), (F.max(F.col("first") + F.col("windows")) - F.min("first")).alias("windows"), F.min("least").alias("least"), F.max("others").alias("others")), "held")
    source = held.where("id = least").groupBy("path").agg(F.min(F.struct("id", "body", "first", "windows")).alias("s"))
    source = source.groupBy(F.col("s.id").alias("id"), F.col("s.body").alias("body")).agg(F.collect_list(F.struct("path", "s.first", "s.windows")).alias("sources"))
    said = named.join(source, ["id", "body"]).select("id", "text", "sources").mapInArrow(_words_at(span), "path long, said binary")
    whole = held.where("id > least").join(said, "path").select("id", "body", F.struct("first", "windows", "others", "said").alias("at"))
    branching = repeated.where("branches")
    sources = branching.groupBy("edge", "path", "proof").agg(F.min(F.struct("id", "body", "first", "windows")).alias("s"))
    sources = sources.groupBy(F.col("s.id").alias("id"), F.col("s.body").alias("body")).agg(F.collect_list(F.struct("edge", "path", "proof", "s.first", "s.windows")).alias("sources"))
    windows = named.join(sources, ["id", "body"]).select("id", "text", "sources").mapInArrow(_digest_windows(span), f"id {kind}, edge long, path long, proof long, offset int, digest binary")
    earliest = windows.groupBy("digest").agg(F.min("id").alias("least"))
    judged = windows.select("edge", "path", "proof", "offset", "digest").join(earliest, "digest").groupBy("edge", "path", "proof").agg(F.collect_set(F.struct("offset", "least")).alias("judged"))
    bent = (
        branching.select("edge", "path", "proof", "id", "body", "first", "others")
        .join(judged, ["edge", "path", "proof"])
        .select("id", "body", F.explode(F.expr("transform(filter(judged, j -> j.least < id), j -> struct(first + j.offset as first, 1 as windows, transform(others, o -> o + j.offset) as others, cast(null as binary) as said))")).alias("at"))
    )
    spans = whole.unionByName(bent).groupBy("id", "body").agg(F.collect_set("at").alias("spans"))
    out = f"id {kind}, n_words long, n_removed long, kept string"
    cut = named.join(spans, ["id", "body"], "left").select("id", "text", "spans").mapInArrow(_cut(span), out)
    unnamed = rows.where(F.col("id").isNull()).select("id", "text", F.lit(None).cast("array<struct<first:int,windows:int,others:array<int>,said:binary>>").alias("spans")).mapInArrow(_cut(span), out)
    return cut.unionByName(unnamed).withColumnRenamed("id", id_col)


def digest(kept: DataFrame, id_col="doc_id") -> DataFrame:
    """The columns of the op3 query."""
    return kept.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))

"""Paths whose summed hashes collide are told apart by their words."""

import random

import numpy as np
import pyarrow as pa

from brandloom.llm import substring_dedup
from brandloom.llm.common import stored


def test_colliding_paths_are_told_apart(monkeypatch):
    class Colliding(substring_dedup.WordHash):
        def __missing__(self, word):
            return super().__missing__(b"same" if word in (b"red", b"blue") else word)

    monkeypatch.setattr(substring_dedup, "WordHash", Colliding)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:30], w, *words[30:]]) for w in ("red", "blue", "red")]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array(texts)], ["id", "body", "text"])
    (out,) = substring_dedup._find_paths(50)(iter([batch]))
    rows = out.to_pylist()
    alike = {i: {(r["edge"], r["path"]) for r in rows if r["id"] == i} for i in (1, 2, 3)}
    told = {i: {(r["edge"], r["path"], r["proof"]) for r in rows if r["id"] == i} for i in (1, 2, 3)}
    assert alike[1] == alike[2] == alike[3] and told[1] == told[3] and not told[1] & told[2]


def brute_runs(documents):
    """k-mer -> the first k-mer of its nonbranching run, from what follows and precedes it in each document."""
    nexts, prevs = {}, {}
    for doc in documents:
        for i, e in enumerate(doc):
            alone = doc.count(e) == 1
            nexts.setdefault(e, set()).add(doc[i + 1] if alone and i + 1 < len(doc) and doc.count(doc[i + 1]) == 1 else None)
            prevs.setdefault(e, set()).add(doc[i - 1] if alone and i and doc.count(doc[i - 1]) == 1 else None)
    out = {}
    for e in nexts:
        head = e
        while len(prevs[head]) == 1 and None not in prevs[head] and nexts[next(iter(prevs[head]))] == {head}:
            head = next(iter(prevs[head]))
        out[e] = head
    return out


def test_degrees_and_compaction_against_brute_force(spark):
    r = random.Random(7)
    documents = [list(range(100, 160))]
    for _ in range(25):
        doc = []
        for _ in range(r.randrange(1, 4)):
            a = r.randrange(100, 155)
            doc += range(a, r.randrange(a + 1, 161))
        documents.append(doc)
    rows = []
    for i, doc in enumerate(documents):
        for e in set(doc):
            places = [k for k, x in enumerate(doc) if x == e]
            rows.append((i, 0, e, places[0] * 5, 5, [p * 5 for p in places[1:]] or None))
    df = spark.createDataFrame(rows, "id long, body long, edge long, first int, windows int, others array<int>").repartition(4)
    nodes = stored(substring_dedup.degrees(df), "nodes")
    assert {x.edge: x.path for x in substring_dedup.compacted(nodes).collect()} == brute_runs(documents)


def test_words_decide_when_all_hashes_are_the_same(spark, monkeypatch):
    """With every hash of a path forced to be equal, only texts of the same words lose anything."""
    monkeypatch.setattr(substring_dedup, "proofs", lambda words, found, span=50: np.zeros(len(found[0]), dtype=np.int64))
    monkeypatch.setattr(substring_dedup, "_mix", lambda x: x & np.uint64(0))
    red, blue = (" ".join(f"{c}{i}" for i in range(80)) for c in "rb")
    docs = spark.createDataFrame([(1, red), (2, blue), (3, red), (4, blue + " x")], "doc_id long, text string").coalesce(1)
    kept = {x.doc_id: x.n_removed for x in substring_dedup.remove_repeats(docs).collect()}
    assert kept[1] == kept[2] == 0 and set(kept.values()) <= {0, 80}


def test_very_long_texts_and_words(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    docs = spark.createDataFrame([(1, passage), (2, "w" * 500_000 + " " + " ".join(f"v{i}" for i in range(300_000)) + f" {passage} " + "z" * 500_000)], "doc_id long, text string")
    rows = {x.doc_id: x for x in substring_dedup.remove_repeats(docs).collect()}
    assert (rows[1].n_removed, rows[2].n_removed, rows[2].n_words) == (0, 70, 300_072)

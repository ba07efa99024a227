"""Near copies of the pipeline, against brute force over all pairs."""

import random

import numpy as np
import pytest

from brandloom.llm import near_copies, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stars_connect_what_links_connect():
    r = random.Random(3)
    for n, m in ((1, 1), (5, 3), (40, 30), (60, 200), (300, 290)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if n < 300 else [(i, i + 1) for i in r.sample(range(m), m)]
        u, v = (np.array(x, dtype=np.int64) for x in zip(*links, strict=True))
        got = near_copies.stars(u, v)
        least = {i: i for x in links for i in x}
        while True:
            new = {i: min([least[i], *(least[a] for a, b in links if b == i), *(least[b] for a, b in links if a == i)]) for i in least}
            if new == least:
                break
            least = new
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted((v, k) for k, v in least.items() if k != v)
    assert [len(x) for x in near_copies.stars(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] == [0, 0]


def test_sets_against_brute_force(spark, monkeypatch):
    """Components of exact links, with a component in one task, and dealt to blocks."""
    r = random.Random(5)
    texts = []
    for _ in range(3):
        own = [f"w{r.randrange(3000)}" for _ in range(60)]
        for _ in range(25):
            for i in r.sample(range(60), r.choice([0, 1, 1, 2])):
                own[i] = f"c{r.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for weight in (2_000_000, 1_000):
        monkeypatch.setattr(near_copies, "WEIGHT", weight)
        assert {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()} == dict(enumerate(root)), weight


def test_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(300_000)) + "y" * 1_000_000
    rows = [(3, "one text of five words", 1), (3, "quite another text of words", 2), (3, "one text of five words", 0), (4, "ONE text of five  words", 5), (5, long, 1), (6, f"{long} z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(4)
    kept = sorted((x.doc_id, x.text[:20], x.key) for x in near_copies.one_of_each(docs).collect())
    assert kept == [(3, "one text of five wor", 0), (3, "quite another text o", 2), (5, "w0 w1 w2 w3 w4 w5 w6", 1)]


def test_near_copies_against_brute_force(spark):
    r = random.Random(4)
    texts = ["", None, "One two", "one  TWO", "one two three"]
    for k in range(20):
        own = [f"w{r.randrange(3000)}" for _ in range(120)]
        texts.append(" ".join(own))
        for changes in (1, 2, 3, 4, 6):
            copy = list(own)
            for i in r.sample(range(120), changes):
                copy[i] = f"c{k}"
            texts.append(" ".join(copy))
    sets = [brute_set(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    apart = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                low, high = sorted((find(i), find(j)))
                root[high] = low
                apart += (simhash.fingerprint((texts[i] or "").encode()) ^ simhash.fingerprint((texts[j] or "").encode())).bit_count() > simhash.THRESHOLD
    assert apart > 20  # copies that the op5 threshold doesn't link
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[5], 2)], "doc_id long, text string, size int").repartition(3)
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(docs.where("doc_id is not null")).collect()} == {i: find(i) for i in range(len(texts))}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in kept.collect()) == [-1, *sorted({find(i) for i in range(len(texts))})]
    assert near_copies.near_copies(docs.limit(0)).count() == 0

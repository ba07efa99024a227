"""The operators over Spark: edge cases, brute force, and the pipeline on the smallest table."""

import hashlib
import importlib.util

import pytest
from pyspark.sql import functions as F

from brandloom.llm import bpe, chat, decontamination, html_text, pii, sharding, simhash, substring_dedup, toxicity
from tests.llm.test_text_operators import brute_hits, brute_print, brute_removed, brute_spans

DOCS = "doc_id long, text string, n_words string, size int"  # two columns whose names clash with results

LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(3_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, f"one two {PASSAGE} three", "x", 1), (2, f"{PASSAGE}", "x", 1), (3, f"four {PASSAGE} five six", None, None), (4, None, "x", 1), (5, "", "x", 1), (6, LONG, "x", 1), (7, LONG, "x", 1),
    (7, LONG, "x", 1), (8, f"{LONG} end", "x", 1), (None, PASSAGE, "x", 1), (9, "ok " * 120, "x", 1), (10, "ok " * 150, "x", 1), (11, "mail jo@x.org or +1 (243) 555-7962", "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(10, " ".join(f"P{i}" for i in range(5, 30)), 1), (9, "four", 1), (9, "four", 1), (None, "six", 1), (3, None, 1), (4, "", 1)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int")


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_decontamination(docs, empty, benchmark, monkeypatch, bits):
    """With 64 bits in all nearly every window is nominated by chance, and only its words decide."""
    monkeypatch.setattr(decontamination, "LEAST_BITS", bits)
    monkeypatch.setattr(decontamination, "MOST_BITS", bits)
    rows = decontamination.digest(decontamination.find_passages(docs, benchmark)).collect()
    assert len(rows) == len(ROWS)
    items = [("10", " ".join(f"p{i}" for i in range(5, 30))), ("9", "four"), ("none", "six")]
    want = []
    for doc_id, text, *_ in ROWS:
        hit, found = brute_hits(text or "", items)
        found.discard("none")
        n = len((text or "").split())
        n = n if doc_id != 11 else 9
        want.append((doc_id, n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= n))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert decontamination.find_passages(empty, benchmark).count() == 0
    assert decontamination.find_passages(docs, benchmark.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, benchmark, remove="spans").collect()}
    assert "p5" not in cut[2].split() and "p4" in cut[2].split() and "four" not in cut[3] and cut[4] is None


def test_very_long_texts_are_scanned_whole(spark):
    text = "word " * 300_000 + " ".join(f"p{i}" for i in range(13)) + " x" * 100_000 + "y" * 1_000_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = decontamination.find_passages(docs, spark.createDataFrame([(1, " ".join(f"P{i}" for i in range(13)))], "item_id long, text string")).first()
    assert (row.n_words, row.n_hit, row.hit_words, row.item_ids, row.contaminated) == (400_013, 13, list(range(300_000, 300_013)), ["1"], False)


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, shards=3).collect()
    assert len(rows) == len(ROWS)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    shard_of = {}
    for r in rows:
        assert shard_of.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    assert {r.doc_id: r["size"] for r in rows}[4] == 16 and {r.doc_id: r.text_crc32 for r in rows}[4] == 0
    assert sharding.shard_documents(empty).count() == 0


def test_placement_against_brute_force(spark):
    """Every row goes where scheduling all groups and bundles on their own puts it, and slots are gapless."""
    rows = [(i, ("x" * (i * 37 % 900)) + str(i % 90)) for i in range(600)] + [(1000 + i, "same text " * 40) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in sharding.shard_documents(docs, shards=5).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    for t, ids in groups.items():
        assert len({got[i].shard for i in ids}) == 1 and all(got[i].size == len(t.encode()) + 16 for i in ids)
    loads = [sum(x.size for x in got.values() if x.shard == k) for k in range(5)]
    exact = sharding.schedule({t: len(ids) * (len(t.encode()) + 16) for t, ids in groups.items()}, 5)
    best = [sum(len(ids) * (len(t.encode()) + 16) for t, ids in groups.items() if exact[t] == k) for k in range(5)]
    assert sum(loads) == sum(best) and max(loads) - min(loads) <= max(best) - min(best) + 0.02 * sum(loads) / 5
    for k in range(5):
        assert sorted(x.slot for x in got.values() if x.shard == k) == list(range(sum(x.shard == k for x in got.values())))


def test_shards_are_near_equal(spark):
    many = spark.range(4_000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("x"), F.col("id")), (F.col("id") % 50).cast("int")).alias("text"))
    loads = [r[1] for r in sharding.shard_documents(many, shards=7).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 7 and max(loads) - min(loads) <= max(50 * 6, max(loads) * 0.01)


def test_substring_dedup(docs, empty):
    rows = substring_dedup.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    want = brute_removed([(d, t or "") for d, t, *_ in ROWS if d is not None], 50)
    for r in rows:
        assert r.kept == (PASSAGE if r.doc_id is None else want[r.doc_id])
        assert r.n_words - r.n_removed == len(r.kept.split())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", "z"), (2, None, None, "z"), (2, "u", "", None), (None, "u", "<p", "z")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, "a", 1), (2, "", 0), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_simhash(spark, docs, empty):
    near = spark.createDataFrame([(100 + i, " ".join(f"n{j}" for j in range(400)) + f" tail{i}", "x", 1) for i in range(6)], DOCS)
    rows = simhash.near_duplicates(docs.unionByName(near)).collect()
    texts = [(d, t) for d, t, *_ in ROWS] + [(100 + i, " ".join(f"n{j}" for j in range(400)) + f" tail{i}") for i in range(6)]
    assert len(rows) == len(texts)
    fps = [(d, brute_print(t or "")) for d, t in texts]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j, (_, b) in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d or -1, f"{fp:016x}", least.get(find(i), -1)) for i, (d, fp) in enumerate(fps))
    assert sorted((r.doc_id or -1, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in rows) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "u long, v long")
    assert {(r.node, r.root) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_chat(spark):
    said = r"\ [INST] </s> \[INST\] <s> [/INST] \\"
    turns = [(1, 0, "system", "s", 9), (1, 1, "user", said, 9), (1, 2, "assistant", said, 9), (1, 3, "user", None, 9), (2, 0, "user", "only", 9), (None, 0, "assistant", "", 9), (3, 1, None, "b", 9), (3, 1, "assistant", "a", 9), (3, 1, "assistant", "a", 9), (3, 2, "assistant", said * 2_000, 9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chars int")
    rows = {r.conv_id: r for r in chat.digest(chat.examples(df)).collect()}
    assert len(rows) == 4
    for conv, r in rows.items():
        own = sorted((t, role or "", text or "") for c, t, role, text, _ in turns if c == conv)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = chat.examples(df).where("conv_id = 3").orderBy("example").collect()
    assert [r.mask_chars > 0 for r in shown] == [True, True, True] and shown[1].text.startswith(shown[0].text[: shown[0].mask_start])
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


def test_pii(docs, empty):
    rows = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    spans = brute_spans(ROWS[-1][1])
    listed = ",".join(f"{k}:{b}:{e}" for b, e, k in spans)
    assert rows[11].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and rows[11].spans == listed and (rows[11].n_email, rows[11].n_phone) == (1, 1)
    assert rows[4].spans == "" and rows[6].spans == ""
    assert {r.doc_id: r.text for r in pii.mask(docs).collect()}[11] == "mail [EMAIL] or [PHONE]"
    assert pii.find(empty).count() == 0


def test_the_network_adds_and_spares():
    net = pii.trained()
    x, y = pii.labelled_windows(300, seed=77)
    tags = net.marginals(x).argmax(axis=2)
    inside = (x != pii.PAD) & (y > 0)
    assert (tags == y)[inside].mean() > 0.95
    found = pii.added_spans(["call (243) 555-7962 now", "Version 2.0, 2024-10-12, $300.50", ""], [[], [], []], net)
    assert found == [[(5, 19, "phone")], [], []]


def test_bpe(docs, empty):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    for r, (_, text, *_) in zip(sorted(bpe.encode(docs, path).collect(), key=lambda r: (r.doc_id or 0, r.decoded)), sorted(ROWS, key=lambda r: (r[0] or 0, r[1] or "")), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0


def test_toxicity(spark, docs, empty):
    texts = ["calm and kind words " + f"day{i % 9}" if i % 3 else f"you idiot{'en' * (i % 2)} of day{i % 9}" for i in range(300)]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(300)] + [(5, 0, "x"), (None, 1, "x"), (6, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(rows, labels)
    scored = toxicity.score(rows, model).collect()
    held = [r for r in scored if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    kept = toxicity.without_toxic(rows, model)
    assert kept.columns == rows.columns and kept.count() == 200
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == len(ROWS) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(empty, model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.train(rows, few)).collect()} <= {0.5} or few.count()


def test_scores_against_brute_force(spark, docs):
    """score is sigmoid(bias + weights + every pair's product), over each distinct bucket of the whole text."""
    import math

    import numpy as np

    r = np.random.default_rng(4)
    terms = toxicity.Terms()
    chosen = sorted({b for _, t, *_ in ROWS for b in toxicity.buckets(t or "", terms)})[::2]
    model = toxicity.FactorizationMachine(-0.3, np.array(chosen), r.normal(0, 0.05, len(chosen)), r.normal(0, 0.05, (len(chosen), toxicity.RANK)))
    want = []
    for doc_id, text, *_ in ROWS:
        rows = [chosen.index(b) for b in toxicity.buckets(text or "", terms) if b in chosen]
        z = -0.3 + sum(model.weights[i] for i in rows) + sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(rows) for j in rows[:n])
        want.append((doc_id or 0, round(1 / (1 + math.exp(-z)), 6)))
    got = toxicity.score(docs, model).collect()
    assert sorted((x.doc_id or 0, round(x.score, 6)) for x in got) == sorted(want)
    assert all(x.predicted == (x.score >= 0.7) and x.held_out == (__import__("zlib").crc32(str(x.doc_id if x.doc_id is not None else "").encode()) % 3 == 1) for x in got)


def test_repeated_ids_count_once_in_the_sample(spark):
    rows = spark.createDataFrame([(2, f"text number {i}") for i in range(500)] + [(3, "you idiot"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.train(rows, labels, sample=10)
    assert all(0 <= x.score <= 1 for x in toxicity.score(rows, model).collect())


def test_a_pair_that_adds_more_than_its_parts():
    import numpy as np

    rows = [np.array(x) for x in ([0], [1], [0, 1], [2]) for _ in range(40)]
    labels = np.array([float(len(x) == 2) for x in rows])
    bias, weights, factors = toxicity.fit(rows, labels, 3)
    fm = toxicity.FactorizationMachine(bias, np.arange(3), weights, factors)
    assert fm.score({0, 1}) > 0.8 and max(fm.score({0}), fm.score({1}), fm.score({2}), fm.score(set())) < 0.2


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    (d := tmp_path / "in").mkdir()
    rows = [(i, f"{'you idiot' if i % 4 == 0 else 'plain words'} number {i} " + " ".join(f"v{i * 31 + j}" for j in range(40)), "en", "src", 9) for i in range(80)]
    rows += [(200, rows[1][1], "en", "src", 9), (201, " ".join(f"b{j}" for j in range(20)), "en", "src", 9), (202, "write to jo@x.org " + " ".join(f"z{j}" for j in range(30)), "en", "src", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"b{j}" for j in range(20)))], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(d)).collect()}
    assert set(out) == {i for i in range(80) if i % 4} | {202}
    assert out[202].decoded.startswith("write</w> to</w> [</w> email</w>")


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls in any column, empty and long texts, ids that rows share, extra columns whose names clash, and empty tables."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, n_words string, nominees int, whole string"
    plain = " ".join(f"v{j}" for j in range(40))
    rows = [
        (1, None, None, None, None, 1, "k", None, 1, "w"), (2, "", "en", None, 0, 1, "k", None, 1, "w"), (3, plain, "en", "s", 9, 1, "k", None, 1, "w"), (3, plain + " and one more", "en", "s", 9, 2, None, "x", None, None),
        (3, "quite another text than that", None, None, None, 3, None, None, 1, "w"), (None, plain, "en", "s", 9, 1, "k", None, 1, "w"), (None, None, None, None, None, None, None, None, None, None),
        (4, "w " * 60_000 + "y" * 200_000, "en", "s", 9, 1, "k", None, 1, "w"), (5, plain, "en", "s", 9, 1, "k", None, 1, "w"), (5, plain, "en", "s", 9, 1, "k", None, 1, "w"),
    ]
    for name, own in (("some", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(own, schema).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(3, 1, None), (None, 1, 1), (3, 0, 0)] if own else [], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([(None, None), (1, "")] if own else [], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        held = spark.read.parquet(str(d / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, held, str(d))
            assert kept.columns == held.columns and kept.dtypes == held.dtypes
        out = sorted((x.doc_id or 0, x.n_tokens) for x in corpus_pipeline.run(spark, str(d)).collect())
        # Texts of equal words are one group (1 and 2 have none); of near ones the least id stays; rows without an id stay.
        assert [x[0] for x in out] == ([0, 0, 1, 3, 3, 4] if own else [])


def test_long_texts_and_runs(spark):
    """A text of 300,000 words, and one run of a million characters, through every operator on documents."""
    words, run = " ".join(f"w{i * 7919 % 5000}" for i in range(300_000)), "y" * 1_000_000
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, run), (4, "idiot " + run)], DOCS.split(",")[0] + ", text string")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    assert {x.doc_id: x.n_tokens for x in bpe.encode(docs, path).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in ((x.doc_id, x.text) for x in docs.collect())}
    prints = {x.doc_id: x.fingerprint for x in simhash.near_duplicates(docs).collect()}
    assert prints == {x.doc_id: f"{brute_print(x.text):016x}" for x in docs.collect()}
    assert {x.doc_id: x.size for x in sharding.shard_documents(docs, shards=2).collect()} == {x.doc_id: len(x.text) + 16 for x in docs.collect()}
    labels = spark.createDataFrame([(i, 1, int(i == 4)) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 4
    assert pii.find(docs).where("size(spans) > 0").count() == 0

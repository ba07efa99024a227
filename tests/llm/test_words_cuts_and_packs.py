"""Spelling variants, fill-in-middle and packing: against brute force, the library, and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brandloom.llm import fill_middle, packing, spelling

DOCS = "doc_id long, text string, word string, n string, ids int, open int"  # the others clash with columns of results
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, 1, None) for i, t in rows], DOCS)


# Spelling variants.


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_words(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(rows):
    words, out = brute_words(rows), {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (n, len(near), best if best and words[best] >= 2 * n else None)
    found = []
    for w, (n, near, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        found.append((w, n, near, form, words[form] if form else None, root))
    return sorted(found, key=repr)


def scrawled(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Àbcdef", "àbcdef"]
    words = []
    for _ in range(n):
        w = stems[min(int(rng.expovariate(0.08)), len(stems) - 1)]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÉ") + w[k:], w[:k] + rng.choice("abcD") + w[k + 1 :]])
        words.append(w)
    return [(i % 40 if i % 40 else None, " ".join(words[i : i + 7]) + "-9_ß×") for i in range(0, n, 7)]


def test_automaton_numbers_and_one_error():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    automaton = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = automaton.walk(automaton.start, 0, w)
        assert automaton.ends[state] and number == k
        for half in range(len(w) + 1):
            assert automaton.one_error(w, half) == {i for i, v in enumerate(words) if one_apart(w, v) and v[:half] == w[:half]}
    suffixes = {(tuple(sorted(v[len(p) :] for v in words if v.startswith(p)))) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(automaton.ends) == len(suffixes)  # minimal: a state for each different set of endings
    assert spelling.Automaton([]).one_error("a", 0) == set()


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_variants_against_brute_force(spark, block):
    """Blocks of 4 words cut nearly every bucket."""
    rows = scrawled(block, 9_000)
    words = spark.createDataFrame(list(brute_words(rows).items()), "word string, n long")
    near = {r.word: (r.n_near, r.near_n, r.near) for r in spelling.near_words(words, block=block).collect()}
    known = brute_words(rows)
    for w in known:
        own = [v for v in known if one_apart(w, v)]
        best = min(own, key=lambda v: (-known[v], v), default=None)
        assert near.get(w) == ((len(own), known[best], best) if own else None)


def test_spelling_query(spark):
    rows = [*scrawled(1, 9_000), (7, None), (8, ""), (9, "long" * 50_000 + " " + "Words " * 30_000), (9, "words words word's"), (9, "words words word's")]
    docs = frame(spark, rows).repartition(3)
    found = spelling.digest(spelling.variants(docs)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute_variants(rows)
    assert sorted(map(tuple, found), key=repr) == want
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[2] and not r[3] for r in want)
    assert spelling.variants(docs.limit(0)).count() == 0 and spelling.variants(docs.where("text = ''")).count() == 0


def test_words_are_given_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = scrawled(5, 2_000)
    assert {r.word: r.n for r in spelling.count_words(frame(spark, rows)).collect()} == brute_words(rows)


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"w{i}": "w21" for i in range(21)} | {"x": "w21"}
    assert spelling.roots(forms.limit(0)).count() == 0


# Fill-in-middle.

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_cut(key, text):
    units = UNITS.findall(text)
    x = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab <PSM>\n\té漢🙂\x85 ") for _ in range(rng.choice([0, 1, 3, 20, 300]))) for _ in range(n)]


@pytest.mark.parametrize(("slab", "lanes"), [(1 << 22, 4096), (997, 16), (64, 64)])
def test_scan_against_patterns(monkeypatch, slab, lanes):
    """Lanes and slabs as short as they come give what one scan gives."""
    monkeypatch.setattr(fill_middle, "SLAB", slab)
    monkeypatch.setattr(fill_middle, "LANES", lanes)
    texts = [*odd_texts(400), "", " ", "🙂" * 700, "<P", ">", "<P<P>", "<<M>>", "<P >"]
    got = fill_middle.cut(list(range(len(texts))), [t.encode() for t in texts], 50, 80, 42)
    assert [(n, form, p, m, out.decode()) for n, form, p, m, out in got] == [brute_cut(i, t) for i, t in enumerate(texts)]


def test_fill_middle_query(spark):
    texts = [*odd_texts(300, 2), "word 🙂 " * 100_000, "x" * 500_000, "<P" * 3]
    rows = [*enumerate(texts), (None, "a b c d"), (5, None), (6, "twice it"), (6, "twice it")]
    docs = frame(spark, rows).repartition(3)
    formed = fill_middle.transform(docs)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in formed.collect()), key=repr)
    assert got == sorted(((i, *brute_cut(i, t or "")) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    text = formed.join(docs.select(F.col("doc_id").alias("id"), "text"), F.col("id") == F.col("doc_id")).where("doc_id < 300 and doc_id not in (5, 6)")
    assert text.where(fill_middle.restored() != F.col("text")).count() == 0 and text.count() == 298
    sums = fill_middle.digest(formed).where("doc_id = 300").first()
    assert sums.restored_sha256 == hashlib.sha256(texts[300].encode()).hexdigest()
    assert fill_middle.transform(docs.limit(0)).count() == 0


# Packing.


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_both_libraries_have_the_same_classes():
    """Every code point, in each class of the splitting pattern."""
    import tiktoken
    from tokenizers import Regex, pre_tokenizers

    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for own in (r"\p{L}", r"\p{N}", r"\s"):
        mine = tiktoken.Encoding("class", pat_str=own, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(points)
        theirs = pre_tokenizers.Split(Regex(own), "removed", invert=True).pre_tokenize_str(points)
        assert bytes(mine).decode() == "".join(x for x, _ in theirs)


def test_ids_are_the_librarys(library):
    encode = packing.encoder(*packing.ranks_of(VOCABULARY))
    rng = random.Random(9)
    pool = "ab'sSt  \n\t é漢字🙂١２³\x85　́\U0001d7ce.,!?-_<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(4_000)]
    texts += ["a<|endoftext|> b<|endoftext|><|endof", "it's we'll I'M", " " * 3_000 + "a", "ab" * 5_000, "\n\n x \n"]
    assert [encode(t).tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def check_packed(rows, docs, library, window=2048):
    """Each id lies in one piece, pieces are gapless in their sequence, and sequences hold a window at most."""
    want = sorted(((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in docs), key=repr)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i in {i for i, _ in want}:
        texts = [ids for k, ids in want if k == i]
        assert sum(len(t) for t in texts) == sum(r.length for r in by_doc[i])
        for r in by_doc[i]:
            ids = tuple(np.frombuffer(r.ids, dtype="<u4").tolist())
            assert any(t[r.start : r.start + r.length] == ids and len(t) == r.doc_tokens for t in texts)
        if len(texts) == 1:
            own = sorted(by_doc[i], key=lambda r: r.start)
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
    padding = 0
    for own in by_sequence.values():
        own = sorted(own, key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        size = sum(r.length for r in own)
        assert size <= window
        padding += 0 if size & (size - 1) == 0 else window - size
    return padding


@pytest.mark.parametrize(("merge", "most"), [(4096, 64), (6, 2)])
def test_packing(spark, library, merge, most):
    """With 6 windows a task the open windows are merged in rounds."""
    rng = random.Random(merge)
    texts = [" ".join(rng.choice(["one", "two's", "naïve", "漢", "<|endoftext|>"]) for _ in range(int(rng.expovariate(0.004)))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no id"), (1000, None), (1001, ""), (1002, "same text"), (1002, "same text"), (1003, "long " * 60_000)]
    docs = frame(spark, rows).repartition(7)
    got = packing.pack(docs, VOCABULARY, merge=merge, most=most).collect()
    padding = check_packed(got, rows, library)
    assert padding <= 0.002 * sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= sum(r.length for r in got) // 2048 + 30


def test_packing_of_little(spark, library):
    docs = frame(spark, [(1, "a b c"), (2, None)])
    got = packing.pack(docs, VOCABULARY).collect()
    assert check_packed(got, [(1, "a b c"), (2, None)], library) == 0
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
    shown = packing.digest(packing.pack(docs, VOCABULARY))
    assert shown.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert shown.where("doc_id = 2").first().ids_crc32 == zlib.crc32(b"\1\0\0\0")


def test_packer_is_bounded_and_best_fit():
    packer = packing.Packer(window=10, most=2, gap=2)
    ids = lambda n: np.zeros(n, dtype=np.uint32)
    assert [len(list(packer.add(i, i, ids(n)))) for i, n in enumerate([6, 7, 3])] == [0, 0, 1]  # 3 goes beside 7, not 6
    assert [[len(p[4]) for p in w] for w in packer.left()] == [[6]]
    assert list(packer.add(3, 3, ids(5))) == [] and len(packer.left()) == 2
    gone = list(packer.add(4, 4, ids(9)))  # fits none: the fullest has a gap of 4, which its head fills; then the next
    assert [sum(len(p[4]) for p in w) for w in gone] == [10, 10] and packer.left() == []
    assert [w[0][2:4] for w in packing.Packer(10).add(1, 1, ids(25))] == [(0, 25), (10, 25)]

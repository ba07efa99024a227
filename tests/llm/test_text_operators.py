"""Python cores of the operators, against brute force."""

import html
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from brandloom.llm import audio, bpe, decontamination, html_text, pii, sharding, simhash, substring_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")


# op1


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hit, found = set(), set()
    for item_id, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower())
        size = min(13, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for s in range(len(words) - size + 1 if w else 0):
            if tuple(words[s : s + size]) in grams:
                hit.update(range(s, s + size))
                found.add(item_id)
    return hit, found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c é1 D".split()), max_size=60), st.lists(st.lists(st.sampled_from("a b c é1 d".split()), max_size=20), min_size=1, max_size=4), st.sampled_from([64, 1 << 16]))
def test_windows_against_brute_force(doc, items, bits):
    items = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    lists = [decontamination.words_of(t.encode()) for _, t in items]
    places = {h & (bits - 1) for words in lists for h in decontamination.hashes_of(words)}
    table = decontamination.BitTable(bits, np.arange(bits // 64), np.array([sum(1 << p % 64 for p in places if p // 64 == k) for k in range(bits // 64)], dtype=np.uint64), sorted({min(13, len(w)) for w in lists if w}))
    owners = {}
    for (i, _), words in zip(items, lists, strict=True):
        for w in decontamination.windows_of(words):
            owners.setdefault((min(13, len(words)), w), set()).add(i)
    text = ", ".join(doc)
    hit, found = set(), set()
    for (size, w), starts in table.nominate(decontamination.words_of(text.encode())).items():
        if (size, w) in owners:
            found |= owners[size, w]
            hit.update(p for s in starts for p in range(s, s + size))
    assert (hit, found) == brute_hits(text, items)


def test_cutting_words():
    assert decontamination.without_words("Ab, cd! é", {1}) == "Ab, ! é"
    assert decontamination.without_words("", set()) == ""


# op2


def test_schedule_is_longest_first():
    sizes = {i: s for i, s in enumerate([7, 7, 6, 5, 4, 3, 3, 1])}
    placed = sharding.schedule(sizes, 3)
    loads = [0, 0, 0]
    for i in sorted(sizes, key=lambda i: (-sizes[i], i)):
        k = min(range(3), key=lambda k: (loads[k], k))
        assert placed[i] == k
        loads[k] += sizes[i]


# op3


def brute_removed(docs, span):
    words = {d: t.split() for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - span + 1):
            first.setdefault(tuple(words[d][i : i + span]), d)
    out = {}
    for d, w in words.items():
        gone = {p for i in range(len(w) - span + 1) if first[tuple(w[i : i + span])] < d for p in range(i, i + span)}
        out[d] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


def test_leftmost_least():
    r = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 39):
        v = r.integers(0, 5, 200).astype(np.uint64)
        got = substring_dedup.leftmost_least(v, width)
        assert got.tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(len(v) - width + 1)]


def test_edges_depend_on_their_tokens_alone():
    r = np.random.default_rng(2)
    t = r.integers(0, 1 << 63, 40).astype(np.uint64)
    twice = np.concatenate([t, t])
    for k in (1, 3, 12):
        e = substring_dedup.edge_hashes(twice, k)
        assert len(e) == len(twice) - k + 1
        assert (e[: 40 - k + 1] == e[40 : 80 - k + 1]).all()
        assert len(set(e.tolist())) == 40


# op4


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><p>menu</nav><div class='ad'>buy</div><article><h1>One &amp;\n two</h1><p>three<b>!</b><br>four<p>five</article><footer>f</footer><script>x"
    assert html_text.main_text(page) == "One & two\n\nthree! four\n\nfive"
    comments = "<article><p>kept</p><section id='comments'><article class='comment'><p>gone</p></article></section></article>"
    assert html_text.main_text(comments) == "kept"
    assert html_text.main_text("") == "" and html_text.main_text("<nav>only a menu</nav>") == ""


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/!-ab\"'= &;pdivscriptnavarticle", max_size=200))
def test_any_markup_is_read(page):
    assert isinstance(html_text.main_text(page), str)


def test_long_hostile_pages_are_read_in_time():
    for page in ("<" * 100_000, "<a \"" * 30_000, "<!--" * 30_000, "<script>" * 30_000, "&" * 100_000):
        html_text.main_text(page)


def test_references_are_decoded():
    assert html_text.main_text("<article><p>a&nbsp;&lt;b&gt; &eacute;&#8364;</p></article>") == " ".join(html.unescape("a&nbsp;&lt;b&gt; &eacute;&#8364;").split())


# op5


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\t ", max_size=60))
def test_fingerprints_against_brute_force(text):
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_pieces_of_long_texts_count_together(monkeypatch):
    text = " ".join(str(i % 97) for i in range(500)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole


def test_close_fingerprints_share_an_anchor():
    r = random.Random(3)
    for _ in range(400):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 2)):
            y ^= 1 << b
        rows, found = simhash.anchors(np.array([x, y], dtype=np.uint64))
        a, b = (set(found[rows == k].tolist()) for k in (0, 1))
        assert a & b and len(a) <= 32


def test_forest_keeps_components():
    r = random.Random(4)
    base = r.getrandbits(64)
    fps = {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(60)} | {base}
    fps = sorted(fps)
    links = simhash.forest(np.array(fps, dtype=np.uint64), 2)
    roots = {x: x for x in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for u, v in links:
        assert (u ^ v).bit_count() <= 2
        roots[find(u)] = find(v)
    near = {x: {y for y in fps if (x ^ y).bit_count() <= 2} for x in fps}
    for x in fps:
        assert all(find(x) == find(y) for y in near[x])
    assert len(links) == len(fps) - len({find(x) for x in fps})


# op7

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab0123456789@.+- ()é%", max_size=60))
def test_base_spans_against_plain_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_long_runs_are_found_in_time():
    for run in ("1" * 100_000, "a" * 100_000, "1." * 50_000, "+" * 100_000, "a@" * 50_000, "+1 " * 30_000):
        pii.base_spans(run)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_hidden_spans():
    assert pii.hide("a b@c.de 1", [(2, 8, "email")]) == "a [EMAIL] 1"
    assert pii.hide("abcdef", [(0, 3, "ip"), (2, 5, "card")]) == "[IP]f"


def test_gradients_of_the_network():
    x, y = pii.labelled_windows(3, seed=1)
    x, y, net = x[:8], y[:8], pii.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        e = net.emissions(x)[0]
        _, _, total = net._sums(e)
        gold = e[0][np.arange(3), y[0]] + net.p["s"][y[0]]
        for k in range(1, len(x)):
            gold = gold + net.p["t"][y[k - 1], y[k]] + e[k][np.arange(3), y[k]]
        return (total - gold).mean()

    grads = net.step(x, y)
    for name in ("x", "h", "b", "o", "ob", "t", "s"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-4
        high = loss()
        net.p[name][at] = old - 1e-4
        low = loss()
        net.p[name][at] = old
        assert (high - low) / 2e-4 == pytest.approx(grads[name][at], rel=1e-3, abs=1e-6)


# op9


@pytest.fixture(scope="module")
def coder(spark):
    return bpe.Bpe(*bpe.read_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json")))


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


TEXTS = ["", "  ", "a" * 40, "<|endoftext|> hi <|startoftext|>x", "ΑΣ ΟΔΟΣ", "İstanbul", "a\x1cb \x1f c\x85d", "I'm we're 'SS '", "été 日本語 🙂 ½ ² Ⅷ", "hahahahaha lololol", "</w> a</w>", "K Å <| x"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_odd_texts(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == ids
    assert coder.decode(coder.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdehnostuéßñ'!.,123 \n", max_size=80))
def test_ids_against_the_library(coder, library, text):
    assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_every_code_point(coder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 512):
        text = " ".join(f"a{c}b {c}\u0301\u0323x" for c in points[at : at + 512])
        assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(at)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_ids_of_any_text(coder, library, text):
    assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_very_long_run(coder, library):
    text = "ab0" * 100_000 + "é" * 100_000 + "abra" * 100_000
    assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, coder.known)) <= bpe.LONGEST


def test_stores_are_bounded(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    text = " ".join(f"word{i % 13}x" for i in range(60))
    assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(coder.known) <= 6


# op8


def test_unreadable_and_silent_recordings():
    for data in (None, b"", b"no wav", audio.play([0.0] * 64, 1), audio.play(None, 1)):
        assert len(audio.integers(audio.chroma(audio.read_wav(data)))[0]) == 0


def test_paths_of_a_document_are_gathered():
    rng = random.Random(9)
    docs = [["x"] * 80, [rng.choice("abc") for _ in range(150)], "one two three four five".split() * 30]
    words = [[w.encode() for w in d] for d in docs]
    found = substring_dedup.paths(words, substring_dedup.WordHash(), span=10, k=4)
    doc, edges, whole, first, windows, others = substring_dedup.once_a_document(found)
    flat = [(int(d), int(e), int(p), int(f), int(w)) for d, e, p, a, w, o in zip(doc, edges, whole, first, windows, others.to_pylist(), strict=True) for f in (a, *(o or ()))]
    assert sorted(flat) == sorted(zip(*(x.tolist() for x in found), strict=True))
    assert len({(d, e, p) for d, e, p in zip(doc.tolist(), edges.tolist(), whole.tolist(), strict=True)}) == len(doc) < len(flat)
    covered = {(d, f + i) for d, _, _, f, w in flat for i in range(w)}
    assert covered == {(i, s) for i, d in enumerate(docs) for s in range(len(d) - 9)}

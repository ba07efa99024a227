"""BPE encoding and decoding, by dynamic programming over prefixes.

A word's encoding has, for each prefix of the word, one last token. The automaton of all tokens (Aho-Corasick, with
suffix links) yields every token that ends at a position, longest first; a token is the last one of that prefix if the
encoding of what precedes it ends with a token that it can stand beside. Two tokens can stand side by side if no merge
crosses their border: walking up the right edge of the first and the left edge of the second in the order of the merges,
the pair that faces each other at a moment must not have a merge due before either of them is merged away. The ids follow
from the back-pointers. Words repeat, so what was found for a word, a run of non-spaces and a pair of tokens is kept, up
to a bound; of words and runs, those met lately stay.

Texts are normalised and split as the vocabulary file says: NFC, white space runs to a space, lower case, then
contractions, runs of letters, single digits, runs of other signs. Python's Unicode tables are of another version than the
tokenizers library's: `odd_points` asks the library about every code point, and texts that hold one on which the two differ
are normalised and split by the library, so that ids agree for every text. Special tokens in a text become their ids.
Decoding joins the tokens' strings by a space, as a file without a decoder has it.

Edge cases: a null or empty text has no tokens and decodes to the empty text. Rows are independent: repeated rows and
null ids are returned as they are. Runs of any length without a space are encoded whole, in time that grows with their
length. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept, sha256, texts

END = "</w>"
KEPT = 250_000
LONGEST = 64
#: Rows that are given out at a time.
ROWS = 100

#: The splitting pattern and white space of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"[\x09-\x0D\x20\x85\xA0  -     　]"

_NEVER = 1 << 60


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _closed(letter: str) -> str:
    """The letter that ends a word."""
    return chr(ord(letter) + 0x1000)


def runs_of(text: str, spaces) -> list[str]:
    """The runs of non-spaces of a text, normalised."""
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # split() takes these for spaces
    return spaces.split(text) if odd else text.split()


@functools.lru_cache(maxsize=2)
def _library(rules: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(rules)
    return tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str


def library_words(rules: str, text: str) -> list[str]:
    """A text's words, in byte letters, as the library normalises and splits it. rules: a vocabulary file without its vocabulary."""
    normalize, split = _library(rules)
    return [word for word, _ in split(normalize(text))]


def _odd_among(points: list[str], differ, probe) -> set[str]:
    """Of some characters those on which this module and the library differ, and those that compose differently."""
    found: set[str] = set()
    if differ("".join(map(probe, points))):
        found.update(c for c in points if differ(probe(c)))
    for c in points:
        if unicodedata.decomposition(c) and (parts := unicodedata.normalize("NFD", c)) != c and differ(parts):
            found.update(parts)
    return found


def _odd_blocks(rules: str):
    """The odd characters of blocks of 256 code points."""

    def run(batches):
        letters, split, spaces = _byte_letters(), regex.compile(SPLIT).findall, regex.compile(SPACE + "+")

        def differ(text: str) -> bool:
            return ["".join(map(letters.__getitem__, w.encode())) for r in runs_of(text, spaces) for w in split(r)] != library_words(rules, text)

        def probe(c: str) -> str:  # what has no name has no place among marks either
            return f"a{c}b {c}! " if unicodedata.category(c) == "Cn" else f"a{c}b {c}! a\u0301{c}\u0323b a{c}\u0301b "

        for batch in batches:
            found: set[str] = set()
            for block in batch.column(0).to_pylist():
                if points := [chr(c) for c in range(block << 8, block + 1 << 8) if not 0xD800 <= c < 0xE000]:
                    found |= _odd_among(points, differ, probe)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["c"])

    return run


def odd_points(spark: SparkSession, rules: str) -> frozenset[str]:
    """The characters on which this module and the library differ: by class, by case, by order among marks, or by composition.

    Every code point is compared, by tasks, once for the rules and versions; the result stays in the shared folder.
    """
    import tokenizers

    name = sha256("|".join([rules, SPLIT, SPACE, tokenizers.__version__, unicodedata.unidata_version, regex.__version__, "1"]).encode())[:24]
    blocks = lambda: spark.range(0, 0x110000 >> 8, 1, 68).mapInArrow(_odd_blocks(rules), "c string").distinct()
    return frozenset(r.c for r in kept(spark, f"odd-{name}", blocks).collect())  # code points at most


class Bpe:
    def __init__(self, vocab: dict[str, int], merges: list[list[str]], special: dict[str, int], odd: frozenset[str] = frozenset(), rules: str = ""):
        self.odd, self.rules = odd, rules
        self.special = special
        self.strings = {i: s.encode() for s, i in (vocab | special).items()}
        self.letters = _byte_letters()
        self.of_byte = {b: c for b, c in enumerate(self.letters)}
        inner = lambda s: s[: -len(END) - 1] + _closed(s[-len(END) - 1]) if s.endswith(END) and len(s) > len(END) else s
        self.id_of = {inner(s): i for s, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), rank)
            self.parts.setdefault(whole, (left, right, rank))
        self.ends = ahocorasick.Automaton()
        for letters, i in self.id_of.items():
            self.ends.add_word(letters, (i, len(letters)))
        self.ends.make_automaton()
        self.edges: tuple[dict, dict] = ({}, {})
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT).findall
        self.spaces = regex.compile(SPACE + "+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.mark = os.path.commonprefix(list(special))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the letter at the token's left (0) or right (1) edge up to the token: (part, rank of the merge that takes it in)."""
        known = self.edges[side].get(token)
        if known is None:
            known, until, part = [], _NEVER, token
            while True:
                known.append((part, until))
                if part not in self.parts:
                    break
                until = self.parts[part][2]
                part = self.parts[part][side]
            known = self.edges[side][token] = known[::-1]
        return known

    def can_stand(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens that follow each other."""
        xs, ys = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        known = True
        while True:
            (x, x_until), (y, y_until) = xs[i], ys[j]
            due = self.rank.get((x, y), _NEVER)
            if due < x_until and due <= y_until and due != _NEVER:  # of equal merges the left one comes first
                known = False
                break
            if x_until == y_until == _NEVER:
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self.beside) >= 4 * KEPT:
            self.beside.clear()
        self.beside[left << 32 | right] = known
        return known

    def _is_whole(self, token: int) -> bool:
        """Whether the token's own letters are encoded as this token: its halves can't be, so it stands unless a border inside it holds."""
        known = self.whole.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                left, right, rank = self.parts[token]
                known = self._is_whole(left) and self._is_whole(right) and self._meets(left, right, rank)
            self.whole[token] = known
        return known

    def _meets(self, left: int, right: int, rank: int) -> bool:
        """Whether left and right both come to stand, and then merge at rank."""
        xs, ys = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = xs[i], ys[j]
            if x_until == y_until == _NEVER:
                return self.rank.get((x, y)) == rank
            due = self.rank.get((x, y), _NEVER)
            if due < x_until and due <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_letters(self, letters: str) -> list[int]:
        """The ids of one word, whose last letter is closed."""
        n = len(letters)
        last, before = [-1] * (n + 1), [0] * (n + 1)
        beside = self.beside.get
        for end, (token, length) in self.ends.iter(letters):  # by end, longest first
            end += 1
            if last[end] < 0:
                begin = end - length
                if begin:
                    left = last[begin]
                    if left < 0:
                        continue
                    fits = beside(left << 32 | token)
                    if fits is None:
                        fits = self.can_stand(left, token)
                else:
                    fits = self._is_whole(token)
                if fits:
                    last[end], before[end] = token, begin
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = before[at]
        ids.reverse()
        return ids

    def _run(self, run: str) -> bytes:
        """The ids of a run of non-spaces, or of one word of it, that isn't in the newer of the two stores."""
        ids = self.older.get(run)
        if ids is None:
            words = (run,) if run.isalpha() else self.split(run)
            if len(words) == 1 and len(words[0]) == len(run):
                letters = "".join(map(self.letters.__getitem__, run.encode()))
                found = self.encode_letters(letters[:-1] + _closed(letters[-1]))
                ids = struct.pack(f"<{len(found)}I", *found)
            else:
                ids = b"".join([self.known.get(w) or self._run(w) for w in words])
        if len(run) <= LONGEST:
            if len(self.known) >= KEPT:
                self.older, self.known = self.known, {}
            self.known[run] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and not self.odd.isdisjoint(text):
            return b"".join([struct.pack(f"<{len(ids)}I", *ids) for ids in (self.encode_letters(w[:-1] + _closed(w[-1])) for w in library_words(self.rules, text))])
        make = self._run
        return b"".join([self.known.get(r) or make(r) for r in runs_of(text, self.spaces) if r])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.marks is None or self.mark not in text:
            return self._plain(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._plain(p) for p in self.marks.split(text))

    def forget(self) -> None:
        """Drops the words and runs met."""
        self.known, self.older = {}, {}

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_built: dict[str, Bpe] = {}


def _bpe_for(tables) -> Bpe:
    name, *parts = tables.value
    if name not in _built:
        _built.clear()
        _built[name] = Bpe(*parts)
    return _built[name]


def read_vocabulary(spark: SparkSession, path: str) -> tuple[dict[str, int], list[list[str]], dict[str, int], frozenset[str], str]:
    """What Bpe takes: tokens, merges, special tokens, odd characters, and the file's rules without its tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    rules = json.dumps({**file, "model": {**file["model"], "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None})
    merges = [list(m) if not isinstance(m, str) else m.split(" ") for m in file["model"]["merges"]]
    return file["model"]["vocab"], merges, {t["content"]: t["id"] for t in file["added_tokens"]}, odd_points(spark, rules), rules


def encode(docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, n_tokens, ids (binary, little-endian unsigned 32-bit integers) and decoded for every row.

    vocabulary: path of the vocabulary file on the driver; its tables, whose size the file fixes, are broadcast.
    """
    tables = docs.sparkSession.sparkContext.broadcast((vocabulary, *read_vocabulary(docs.sparkSession, vocabulary)))

    def run(batches):
        bpe = _bpe_for(tables)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):  # ids and decoded texts are several times the input
                    ids = [bpe.encode(t) for t in texts(batch.column(1).slice(at, ROWS))]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, ROWS), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string())],
                        [id_col, "n_tokens", "ids", "decoded"],
                    )
        finally:
            bpe.forget()
            give_back()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def digest(encoded: DataFrame, id_col="doc_id") -> DataFrame:
    """The columns of the op9 query."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))

"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form that each goes back to.

Words are counted over whole texts. Two near words agree in the half of either that the error is not in. So two kinds of
automata hold the words, forward and backward (of reversed words): minimal, acyclic, and with the number of words below each
transition, so that a path spells a word's number (a perfect hash), at which its count stands. A word asks both: its own first
half, matched exactly, leads to a state of the forward automaton, and the rest is completed with one error; its last half does
so backward. What has the first half in common is left to the forward automaton, so that each near word is met once.

The automata are dealt out, since the words grow with the corpus. What a word of n code points asks for, its first n // 2 or
last n - n // 2 code points, is the name of a bucket; words that it could meet there are of n - 1 to n + 1 code points, so that
each word lies in two buckets a direction. A task builds its automata over BLOCK words or so of its buckets at a time, in
sorted order, and answers what these buckets are asked. A bucket of more than a block's words is cut into parts: each part of
its words meets each part of its questions in a unit of its own, so that no task grows with a bucket. Buckets that are cut are
at most MOST, as a block grows to that end, and are broadcast.

Only a word's own summary is returned by a task: how many words are near, and the one of largest count. Forms are followed to
their roots by pointer doubling over tables; counts at least double from form to form, so that the steps are few.

Edge cases: a null or empty text has no words; a null id is as an empty one in the deletions. Repeated rows are counted each.
Texts are read whole. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, drop_stored, give_back, stored
from .simhash import LOWER

#: Of a text whose A-Z are lower-cased.
LETTER = "[a-z\u00C0-\u00FF]"
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
DROP = 97
BLOCK = 4096
MOST = 20_000
#: Different words that a task holds, and places of words that it should get.
HELD, SHARE = 200_000, 50_000


class Automaton:
    """The minimal acyclic automaton of sorted different words; a word's number is its place among them."""

    def __init__(self, words: list[str]):
        #: of each state: whether a word ends here, {letter: (state, words before those of this transition)}, words
        self.ends: list[bool] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []
        register: dict[tuple, int] = {}

        def state(final: bool, below: list[tuple[str, int]]) -> int:
            key = (final, *below)
            known = register.get(key)
            if known is None:
                known = register[key] = len(self.ends)
                before, out = int(final), {}
                for letter, target in below:
                    out[letter] = (target, before)
                    before += self.count[target]
                self.ends.append(final)
                self.next.append(out)
                self.count.append(before)
            return known

        path: list[tuple[bool, list]] = [(False, [])]  # the states of the last word, which may still grow
        last = ""

        def close(to: int) -> None:
            for k in range(len(last), to, -1):
                target = state(*path.pop())
                path[-1][1].append((last[k - 1], target))

        for word in words:
            common = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                common += 1
            close(common)
            path += [(False, []) for _ in range(len(word) - common)]
            path[-1] = (True, path[-1][1])
            last = word
        close(0)
        self.start = state(*path.pop())

    def walk(self, state: int, number: int, letters: str) -> tuple[int, int] | None:
        """Where letters lead, and the words before."""
        for c in letters:
            step = self.next[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with word[:half] and differ from word by one insertion, deletion or replacement."""
        found: set[int] = set()
        at = self.walk(self.start, 0, word[:half])
        ends, following = self.ends, self.next
        for i in range(half, len(word) + 1):
            if at is None:
                break
            state, number = at
            step, own, rest, later = following[state], word[i : i + 1], word[i:], word[i + 1 :]
            for c, (target, before) in step.items():
                for letters in (rest, later) if own and c != own else (rest,):  # c is inserted, or stands for word[i]
                    s, n = target, number + before
                    for x in letters:
                        go = following[s].get(x)
                        if go is None:
                            break
                        s, n = go[0], n + go[1]
                    else:
                        if ends[s]:
                            found.add(n)
            if own:
                gone = self.walk(state, number, later)
                if gone is not None and ends[gone[0]]:
                    found.add(gone[1])
                at = (step[own][0], number + step[own][1]) if own in step else None
        return found


def runs_of(text: bytes, least_length: int = LEAST_LENGTH) -> list[str]:
    """The maximal runs of at least so many code points, lower-cased (A-Z)."""
    return _runs(least_length)(text.translate(LOWER).decode())


@functools.lru_cache(maxsize=4)
def _runs(least_length: int):
    return re.compile(f"{LETTER}{{{least_length},}}").findall


def count_words(docs: DataFrame, id_col="doc_id", text_col="text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """word and n: lower-cased (A-Z) runs, each without a code point where `drop` divides the CRC of its document's id and itself.

    A task counts up to HELD different words before it gives them out.
    """

    def run(batches):
        counts: dict[str, int] = {}

        def given():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                begun = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(runs_of(text, least_length)).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % drop == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield given()
                    counts = {}
        yield given()
        give_back()

    counted = docs.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _rows_of(words: DataFrame) -> DataFrame:
    """bucket, back, ask, word (reversed if back), n: a word's two places a direction, and its two questions."""
    size, mirrored = F.length("word"), F.reverse("word")
    prefix = lambda text, k: F.substring(text, F.lit(1), k)

    def row(text, back: bool, ask: bool, k):
        return F.struct(prefix(text, k.cast("int")).alias("bucket"), F.lit(back).alias("back"), F.lit(ask).alias("ask"), text.alias("word"), F.col("n"))

    low, high = F.floor((size - 1) / 2), F.floor((size + 1) / 2)
    # halves of words that are one shorter, as long, or one longer: size - size // 2 of them backward
    ahead = [row(F.col("word"), False, False, k) for k in (F.floor(size / 2), F.when(size % 2 == 0, low).otherwise(high))]
    behind = [row(mirrored, True, False, k) for k in (F.ceil(size / 2), F.when(size % 2 == 0, F.ceil((size + 1) / 2)).otherwise(F.ceil((size - 1) / 2)))]
    asks = [row(F.col("word"), False, True, F.floor(size / 2)), row(mirrored, True, True, F.ceil(size / 2))]
    return words.select(F.explode(F.array(*ahead, *behind, *asks)).alias("r")).select("r.*")


def _answer(block: int):
    """(word, n_near, near_n, near) of the questions of a partition that is sorted by back, bucket, unit, ask and word."""

    def run(batches):
        held: dict[str, int] = {}
        asked: dict[str, int] = {}
        mirrored, place, was_cut = False, None, False

        def answers():
            words = sorted(held)
            counts = [held[w] for w in words]
            automaton = Automaton(words)
            out = []
            for word, half in asked.items():
                numbers = automaton.one_error(word, half)
                first = None
                for k in numbers:
                    if mirrored and words[k][::-1].startswith(word[:half - 1 : -1] if half else word[::-1]):
                        continue  # the forward automaton finds it
                    own = (-counts[k], words[k][::-1] if mirrored else words[k])
                    total, first = (total + 1, min(first, own)) if first else (1, own)
                if first:
                    out.append((word[::-1] if mirrored else word, total, -first[0], first[1]))
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "near_n", "near"])

        for batch in batches:
            for name, back, ask, word, n, cut, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (back, name, unit) != place:
                    if back != mirrored or cut or was_cut or len(held) >= block:  # a cut bucket's words may stand in another bucket's unit as well
                        if asked:
                            yield answers()
                        held, asked = {}, {}
                    mirrored, place, was_cut = back, (back, name, unit), cut
                if ask:
                    asked[word] = len(name)
                else:
                    held[word] = n
        if asked:
            yield answers()
        give_back()

    return run


def near_words(words: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """word, n_near, near_n and near (of the words that differ by one code point the one of largest n, the first of these) for words (word, n), a stored table, that have a near one."""
    rows = _rows_of(words)
    sizes = stored(rows.where("not ask").groupBy("back", "bucket").agg(F.count("*").alias("size")), "buckets")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    block = max(block, -(-total // most))
    heavy = sizes.where(F.col("size") > block).select(F.col("back").alias("__back"), F.col("bucket").alias("__bucket"), F.ceil(F.col("size") / block).cast("int").alias("parts"))
    named = rows.join(F.broadcast(heavy), (F.col("back") == F.col("__back")) & (F.col("bucket") == F.col("__bucket")), "left")  # at most `most` rows
    parts = F.coalesce("parts", F.lit(1))
    mine, all_parts = F.pmod(F.xxhash64("word"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    units = F.transform(all_parts, lambda k: F.when(F.col("ask"), k * parts + mine).otherwise(mine * parts + k))
    dealt = named.select("bucket", "back", "ask", "word", "n", F.col("parts").isNotNull().alias("cut"), F.explode(units).alias("unit"))
    answers = dealt.repartition(max(1, total // SHARE), "back", "bucket", "unit").sortWithinPartitions("back", "bucket", "unit", "ask", "word").mapInArrow(_answer(block), "word string, n_near long, near_n long, near string")
    return answers.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for forms (word, form), a stored table without circles, in which each word has one form."""
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = found.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        further = stored(found.join(ahead, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")), "roots")
        moved = further.where("moved").limit(1).count()
        drop_stored(found)
        if not moved:
            return further.drop("moved")
        found = further


def variants(docs: DataFrame, id_col="doc_id", text_col="text", times: int = TIMES) -> DataFrame:
    """word, n, form, form_n, n_near and root for every word: the form is its near word of largest n, if that is `times` its own or more."""
    words = stored(count_words(docs, id_col, text_col), "words")
    near = near_words(words)
    larger = F.col("near_n") >= times * F.col("n")
    formed = stored(
        words.join(near, "word", "left").select("word", "n", F.when(larger, F.col("near")).alias("form"), F.when(larger, F.col("near_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).alias("n_near")), "formed"
    )
    return formed.join(roots(formed.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op11 query."""
    return found.select("word", "n", "n_near", "form", "form_n", "root")

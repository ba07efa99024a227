"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit boundaries, and put in another order behind sentinels.

A unit is white space with the run of other characters that follows it, or the white space at a text's end. One scan of a
table-driven byte automaton sees the whole of every text: its states know whether a unit is in its white space or in its
run, how many UTF-8 continuation bytes are due, and how much of a sentinel has been read. Each transition emits what it
completes (a unit, a code point, a sentinel), and these are counted for each text. A second pass over what was emitted
finds the bytes at which the chosen units begin.

What the automaton knows depends on the last REACH bytes alone. So a buffer of texts is scanned in LANES lanes at once, a
column of bytes at a time, each lane beginning REACH bytes before its own; a byte that no text holds stands between texts
and starts the automaton anew. Long texts are scanned slab by slab in the same way.

The choices depend on the seed and the id alone: h1 to h4 are the first four groups of 8 hex digits of the SHA-256 of
`<seed>:<id>`. The prefix ends after min(h1 % (n+1), h2 % (n+1)) of the n units and the middle after the larger; the text
stays plain if h3 % 100 >= percent, and is spm if h4 % 100 < spm, else psm. A text that is empty or holds a sentinel stays
plain, so that `restored` gives every text back.

Edge cases: a null text is as an empty one; a null id is as an empty one in the choice. Rows are independent: repeated rows
are each returned. Texts are cut whole, whatever their length. An empty table gives an empty result. Other columns play no
part.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, give_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: What a transition emits.
UNIT, POINT, SENTINEL = 1, 2, 4
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Stands between texts; UTF-8 has no such byte.
GAP = 0xFF
#: Bytes that decide a state: a lead byte and three continuations.
REACH = 4
LANES = 4096
#: Bytes that are scanned, and as a rule given out, at a time.
SLAB = 1 << 22


def transitions() -> np.ndarray:
    """[state << 8 | byte] -> next state << 8 | what is emitted. State 0 stands at a text's beginning."""
    parts = ("begin", "space", "run")
    states = [(part, due, seen) for part in parts for due in range(4) for seen in range(3)]
    number = {s: i for i, s in enumerate(states)}
    out = np.zeros(len(states) << 8, dtype=np.uint16)
    for (part, due, seen), i in number.items():
        for byte in range(256):
            if byte == GAP:
                continue  # to state 0, with nothing emitted
            space, continues = byte in SPACES, 0x80 <= byte < 0xC0 and due > 0
            emitted = (UNIT if part == "begin" or space and part == "run" else 0) | (0 if continues else POINT)
            left = due - 1 if continues else 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
            read = 1 if byte == ord("<") else 2 if seen == 1 and byte in b"PSM" else 0
            if seen == 2 and byte == ord(">"):
                emitted |= SENTINEL
            out[i << 8 | byte] = number["space" if space else "run", left, read] << 8 | emitted
    return out


_TABLE = transitions()


def scan(data: bytes) -> np.ndarray:
    """What the transition at each byte emits; data begins with REACH gaps, whose own are left out."""
    buffer = np.frombuffer(data, dtype=np.uint8)
    n = len(buffer) - REACH
    out = np.empty(n, dtype=np.uint8)
    for first in range(0, n, SLAB):
        size = min(SLAB, n - first)
        width = -(-size // LANES)
        lanes = -(-size // width)
        own = np.full(lanes * width + REACH, GAP, dtype=np.uint8)
        own[: size + REACH] = buffer[first : first + size + REACH]
        columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(own, (lanes, width + REACH), (width, 1)).T)
        state, emitted = np.zeros(lanes, dtype=np.uint16), np.empty((width, lanes), dtype=np.uint8)
        for k, column in enumerate(columns):
            step = _TABLE[state | column]
            if k >= REACH:
                emitted[k - REACH] = step & 0xFF
            state = step & 0xFF00
        out[first : first + size] = emitted.T.reshape(-1)[:size]
    return out


def choice(key: str, n: int, percent: int, spm: int, seed: int) -> tuple[str, int, int]:
    """Form, and the units before the middle and before the suffix, of a text of n units without a sentinel."""
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16])
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("plain" if not n or h3 % 100 >= percent else "spm" if h4 % 100 < spm else "psm"), a, b


def cut(keys: list, texts: list[bytes], percent: int, spm: int, seed: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    gap = bytes([GAP])
    emitted = scan(gap * REACH + gap.join(texts) + gap)
    units = np.flatnonzero(emitted & UNIT)
    first_unit = np.searchsorted(units, np.append(begins, len(emitted)))
    sentinels = np.flatnonzero(emitted & SENTINEL)
    marked = np.diff(np.searchsorted(sentinels, np.append(begins, len(emitted)))) > 0
    ps, ss, ms = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for i, text in enumerate(texts):
        own = units[first_unit[i] : first_unit[i + 1]]
        form, a, b = choice("" if keys[i] is None else str(keys[i]), len(own), percent, spm, seed)
        if form == "plain" or marked[i]:
            out.append((len(own), "plain", None, None, text))
            continue
        at = [int(own[k] - begins[i]) if k < len(own) else len(text) for k in (a, b)]
        prefix, middle, suffix = text[: at[0]], text[at[0] : at[1]], text[at[1] :]
        points = [int(np.count_nonzero(emitted[begins[i] + x : begins[i] + y] & POINT)) for x, y in ((0, at[0]), at)]
        out.append((len(own), form, *points, ps + prefix + ss + suffix + ms + middle if form == "psm" else ss + suffix + ps + prefix + ms + middle))
    return out


def transform(docs: DataFrame, percent: int = 50, spm: int = 80, seed: int = 42, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output for every row."""

    def run(batches):
        try:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), blobs(batch.column(1))
                upto = np.cumsum([len(t) for t in texts])
                begin = 0
                while begin < len(texts):
                    end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLAB)))
                    n, form, prefix, middle, output = zip(*cut(keys[begin:end], texts[begin:end], percent, spm, seed), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, end - begin), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                        [id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
                    )
                    begin = end
        finally:
            give_back()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text, from what transform returned: each sentinel occurs once in an output that isn't plain."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    last = F.substring(output, m + 3, F.length(output))
    psm, spm = F.concat(between(p, s), last, between(s, m)), F.concat(between(p, m), last, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(formed: DataFrame, id_col="doc_id") -> DataFrame:
    """The columns of the op12 query."""
    return formed.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))

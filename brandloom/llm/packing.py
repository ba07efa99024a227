"""Packing: documents become sequences of at most WINDOW ids, by bounded-space online packing.

Each partition of documents is read once. A document's ids, with the closing id, are cut where a whole window is full; what
is left of it is placed best-fit: into the open window with the least room that holds it. At most OPEN windows are open. When
the piece fits none and no more may be opened, the fullest is emitted; a gap of more than GAP ids in it is first filled with
the piece's head, since documents may be cut. So a partition is packed in bounded memory, and with next to no padding.

Finally the windows that are still open are merged: those of up to MERGE windows' partitions are packed together, whole
windows as pieces, the largest first, in rounds of tasks until one task is left over. That one closes its windows by cutting,
and gives what remains at last to sequences of a power of two, which need no padding either. What travels is at most OPEN
windows a partition; the rest stays where it was written.

Ids are those of the tokenizers library for a byte-level BPE file. They are made by tiktoken from the same vocabulary, which
is several times faster: its merges are given by rank, as the file's must be (`ranks_of` checks that each merge makes the next
id), and both split texts by the same pattern with the same classes (a test compares every code point).

Edge cases: a null or empty text is the closing id alone. Rows are independent: repeated rows are packed each, and rows with
a null id too. A text is encoded whole, whatever its length; special tokens in a text become their ids. An empty table gives
an empty result. Other columns play no part.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored, texts

WINDOW = 2048
OPEN = 64
GAP = 8
#: Open windows that a task merges.
MERGE = 4096
END = 1

#: The splitting pattern that the file's byte-level rule stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: (number of the document among its task's, its id, its ids before the piece, all its ids, the piece's ids)
Piece = tuple[int, object, int, int, np.ndarray]


def ranks_of(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes of each token with its id, which is its rank, and the special tokens."""
    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model, rule = file["model"], file["pre_tokenizer"]
    if file["normalizer"] is not None or rule["type"] != "ByteLevel" or rule["add_prefix_space"] or not rule["use_regex"] or model["type"] != "BPE":
        raise ValueError("packing takes a byte-level BPE file without a normalizer")
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    byte_of = {chr(b) if b in printable else chr(next(others)): b for b in range(256)}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in model["vocab"].items() if s not in special}
    merged = [model["vocab"]["".join(m if not isinstance(m, str) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 != len(ranks):
        raise ValueError("the file's merges aren't in the order of their ids")
    return ranks, special


def encoder(ranks: dict[bytes, int], special: dict[str, int]):
    """text -> ids as unsigned 32-bit integers."""
    import tiktoken

    made, allowed = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special), set(special)
    return lambda text: made.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


_made: dict[str, object] = {}


def _encoder_of(tables):
    """A worker process keeps the encoder of the vocabulary that it met last."""
    name, *parts = tables.value
    if name not in _made:
        _made.clear()
        _made[name] = encoder(*parts)
    return _made[name]


class Packer:
    """Windows of `window` ids, of which at most `most` are open. Emitted windows are lists of pieces."""

    def __init__(self, window: int = WINDOW, most: int = OPEN, gap: int = GAP):
        self.window, self.most, self.gap = window, most, gap
        self.rooms: list[tuple[int, int]] = []  # (room, window's number), sorted
        self.windows: dict[int, list[Piece]] = {}
        self.opened = 0

    def _take(self, k: int) -> list[Piece]:
        return self.windows.pop(self.rooms.pop(k)[1])

    def add(self, document: int, key, ids: np.ndarray) -> Iterator[list[Piece]]:
        """The windows that a whole document fills, and what must go to make room for its rest."""
        rest = len(ids) // self.window * self.window
        for at in range(0, rest, self.window):
            yield [(document, key, at, len(ids), ids[at : at + self.window])]
        if rest < len(ids):
            yield from self.place([(document, key, rest, len(ids), ids[rest:])])

    def place(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """Places pieces that stay together, less than a window in all, as far as they do not fill another's gap."""
        size = sum(len(p[4]) for p in pieces)
        k = bisect.bisect_left(self.rooms, (size, -1))
        if k == len(self.rooms) and k >= self.most:
            gap = self.rooms[0][0]
            fullest = self._take(0)
            if gap > self.gap:
                head, pieces = split(pieces, gap)
                fullest, size = fullest + head, size - gap
            yield fullest
            k = bisect.bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, number = self.rooms.pop(k)
            self.windows[number] += pieces
        else:
            room, number, self.opened = self.window, self.opened, self.opened + 1
            self.windows[number] = list(pieces)
        if room == size:
            yield self.windows.pop(number)
        else:
            bisect.insort(self.rooms, (room - size, number))

    def left(self) -> list[list[Piece]]:
        """The open windows, the fullest first."""
        return [self.windows[number] for _, number in self.rooms]


def split(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first `size` ids of pieces, and the others."""
    head = []
    for i, (document, key, start, of, ids) in enumerate(pieces):
        if len(ids) >= size:
            rest = [(document, key, start + size, of, ids[size:])] if len(ids) > size else []
            return [*head, (document, key, start, of, ids[:size])], rest + pieces[i + 1 :]
        head.append(pieces[i])
        size -= len(ids)
    return head, []


def closed(left: list[list[Piece]], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Open windows as full sequences, and the rest as sequences of a power of two."""
    pieces = [p for w in left for p in w]
    size = sum(len(p[4]) for p in pieces)
    while size:
        own = window if size >= window else 1 << size.bit_length() - 1
        head, pieces = split(pieces, own)
        size -= own
        yield head


def _out(kind: str, id_col: str) -> str:
    return f"`{id_col}` {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, open boolean"


class _Rows:
    """Rows of pieces as Arrow batches."""

    def __init__(self, id_col: str, kind: pa.DataType, first: int):
        self.id_col, self.kind, self.sequence, self.rows, self.held = id_col, kind, first, [], 0

    def add(self, sequence: list[Piece], still_open: bool = False):
        offset = 0
        for _, key, start, of, ids in sequence:
            self.rows.append((key, start, len(ids), of, ids.astype("<u4").tobytes(), self.sequence, offset, still_open))
            offset += len(ids)
        self.held += offset
        self.sequence += 1
        if self.held > 1 << 19:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        kinds = [self.kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(kinds)
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [self.id_col, "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "open"])
        self.rows, self.held = [], 0
        return out


def _first_sequence(turn: int) -> int:
    """Sequences are numbered by round, task and place in the task."""
    return turn << 58 | TaskContext.get().partitionId() << 34


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, most: int = OPEN, gap: int = GAP, end: int = END, merge: int = MERGE, id_col="doc_id", text_col="text") -> DataFrame:
    """A row for each piece: id_col, start, length, doc_tokens, ids (little-endian unsigned 32-bit integers), sequence_id, offset.

    vocabulary: path of the vocabulary file on the driver; its tables, whose size the file fixes, are broadcast.
    """
    tables = docs.sparkSession.sparkContext.broadcast((vocabulary, *ranks_of(vocabulary)))
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batches):
        encode, packer, rows = _encoder_of(tables), Packer(window, most, gap), None
        n = 0
        for batch in batches:
            rows = rows or _Rows(id_col, batch.column(0).type, _first_sequence(0))
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                n += 1
                for sequence in packer.add(n, key, np.append(encode(text), np.uint32(end))):
                    yield from rows.add(sequence)
        for sequence in packer.left():
            yield from rows.add(sequence, True)
        if rows:
            yield rows.flush()
        give_back()

    def merged(turn: int, last: bool):
        def run(batches):
            windows: dict[int, list[Piece]] = {}
            arrow = None
            for batch in batches:
                arrow = batch.column(0).type
                for key, start, _, of, ids, sequence, _, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # by sequence and offset
                    windows.setdefault(sequence, []).append((0, key, start, of, np.frombuffer(ids, dtype="<u4")))
            if not windows:
                return
            packer, rows = Packer(window, most, gap), _Rows(id_col, arrow, _first_sequence(turn))
            for pieces in sorted(windows.values(), key=lambda w: -sum(len(p[4]) for p in w)):
                for sequence in packer.place(pieces):
                    yield from rows.add(sequence)
            for sequence in closed(packer.left(), window) if last else packer.left():
                yield from rows.add(sequence, not last)
            yield rows.flush()

        return run

    schema = _out(kind, id_col)
    packed = stored(docs.select(id_col, text_col).mapInArrow(first, schema), "packed")
    parts, turn = [packed.where("not open")], 0
    while True:
        still = packed.where("open")
        tasks = -(-still.select("sequence_id").distinct().count() // merge)
        if not tasks:
            break
        turn += 1
        dealt = still.repartition(tasks, F.xxhash64("sequence_id")) if tasks > 1 else still.coalesce(1)
        packed = stored(dealt.sortWithinPartitions("sequence_id", "offset").mapInArrow(merged(turn, tasks == 1), schema), "merged")
        parts.append(packed.where("not open"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("open")


def digest(packed: DataFrame, id_col="doc_id") -> DataFrame:
    """The columns of the op13 query."""
    return packed.select(id_col, "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Benchmark decontamination.

The normalised 13-word windows of the benchmark items (an item of fewer words is one window) form a hash set, and each
document is scanned against it where it lies. What is broadcast is a bit table of the windows' and their k-grams' hashes,
SPARSE bits for each window and at most MOST_BITS in all, so that its size is bounded whatever the benchmark holds. Every
window of L words contains exactly one of the k-grams at word positions 0, s, 2s, ... when s = L - k + 1, so only those
k-grams are looked up; where one is found, the windows around it are. A bit can be set by chance: what the table nominates
is joined with the windows themselves, by all of their words, and only that counts. The same plan serves a benchmark of any
size; a larger one nominates more.

Document rows are told apart by the numbers of a stored table, never by a hash. A window that is met in many documents is
dealt to SALTS parts.

Edge cases: a null or empty text has no words, no hits, and is clean. Items that are null or have no words are ignored;
an item whose id is null still marks words but is not listed. Repeated items are listed once. Every document row gives
one result row, repeated rows and null ids included. Texts of any length are scanned whole. An empty table of documents
gives an empty result, an empty benchmark hits nothing. Other columns of either table play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import blobs, stored

WINDOW = 13
PROBE = 4
SPARSE, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 29
SALTS = 8

#: Lower-cases A-Z; every other ASCII byte outside 0-9 and a-z becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

NOMINEES = "array<struct<window:binary,size:int,starts:array<int>>>"
_nominees = pa.list_(pa.struct([("window", pa.binary()), ("size", pa.int32()), ("starts", pa.list_(pa.int32()))]))
_hash = xxhash.xxh3_64_intdigest


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    size = min(window, len(words))
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


def hashes_of(words: list[bytes], window: int = WINDOW) -> set[int]:
    """Hashes of an item's windows, and of the k-grams that nominate them (seeded by the window's size, which tells them apart)."""
    size = min(window, len(words))
    k = min(PROBE, size)
    found = {_hash(w, window + size) for w in windows_of(words, window)}
    return found | {_hash(b" ".join(words[i : i + k]), size) for i in range(len(words) - k + 1)} if words else found


class BitTable:
    """Which hashes there may be; bits: how many, a power of two; words: (number, 64 bits) of those that aren't 0."""

    def __init__(self, bits: int, numbers: np.ndarray, words: np.ndarray, sizes: list[int]):
        table = np.zeros(bits // 64, dtype="<u8")
        table[numbers] = words
        self.bits, self.sizes, self.mask = table.tobytes(), sizes, bits - 1

    def nominate(self, words: list[bytes]) -> dict[tuple[int, bytes], list[int]]:
        """(size, window) -> its starts, for all windows that may be an item's."""
        out: dict[tuple[int, bytes], list[int]] = {}
        n, bits, mask = len(words), self.bits, self.mask
        for size in self.sizes:
            k = min(PROBE, size)
            step = size - k + 1
            for p in range(0, n - k + 1, step):
                h = _hash(b" ".join(words[p : p + k]), size) & mask
                if bits[h >> 3] >> (h & 7) & 1:
                    for start in range(max(0, p - step + 1), min(p, n - size) + 1):
                        window = b" ".join(words[start : start + size])
                        h = _hash(window, WINDOW + size) & mask
                        if bits[h >> 3] >> (h & 7) & 1:
                            out.setdefault((size, window), []).append(start)
        return out


def _windows(batches):
    for batch in batches:
        items, sizes, windows = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
            words = words_of(text)
            found = set(windows_of(words))
            items += [item] * len(found)
            sizes += [min(WINDOW, len(words))] * len(found)
            windows += found
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(sizes, pa.int32()), pa.array(items, pa.string())], ["window", "size", "item"])


def _hashes(batches):
    for batch in batches:
        found = set().union(*(hashes_of(words_of(t)) for t in blobs(batch.column(0))))
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(found, dtype=np.uint64, count=len(found)).view(np.int64))], ["h"])


class Windows:
    """A benchmark's windows as a stored table (window, size, items), and its bit table as a broadcast."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str):
        spark = benchmark.sparkSession
        items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
        found = items.mapInArrow(_windows, "window binary, size int, item string")
        self.rows = stored(found.groupBy("window", "size").agg(F.collect_set("item").alias("items")), "windows")  # collect_set leaves nulls out
        measured = self.rows.groupBy("size").count().collect()  # WINDOW rows at most
        bits = LEAST_BITS
        while bits < min(MOST_BITS, SPARSE * sum(r["count"] for r in measured)):
            bits *= 2
        place = F.col("h").bitwiseAND(F.lit(bits - 1))
        words = items.select("text").mapInArrow(_hashes, "h long").select(F.shiftright(place, 6).alias("k"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}L) & 63 as int))").alias("b"))
        words = words.groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()  # bits / 64 rows at most
        self.table = spark.sparkContext.broadcast(BitTable(bits, words["k"].to_numpy(), words["b"].to_numpy().view(np.uint64), sorted(r["size"] for r in measured)))


def _scanned(rows: DataFrame, windows: Windows, text_col: str, keep_text: bool) -> tuple[DataFrame, str, str]:
    """rows with two columns more, and their names: the text's word count, and what the bit table nominates in it."""
    at, shared = rows.columns.index(text_col), windows.table
    mark = "_" * (1 + max(len(c) for c in rows.columns))  # no column has this name
    kept = [f for i, f in enumerate(rows.schema) if keep_text or i != at]
    schema = StructType(kept).add(f"{mark}n", "long").add(f"{mark}w", _type(NOMINEES))
    names = schema.names

    def run(batches):
        table = shared.value
        for batch in batches:
            n_words, nominees = [], []
            for text in blobs(batch.column(at)):
                words = words_of(text)
                n_words.append(len(words))
                nominees.append([{"window": w, "size": size, "starts": starts} for (size, w), starts in table.nominate(words).items()])
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(nominees, _nominees)], names)

    return rows.mapInArrow(run, schema), names[-2], names[-1]


def _type(ddl: str):
    return StructType.fromDDL(f"x {ddl}")[0].dataType


def _judged(scanned: DataFrame, windows: Windows) -> DataFrame:
    """row, n_hit, hit_words, item_ids and contaminated of each row (row, n_words, nominees) with a nominee that is an item's window."""
    asked = scanned.where(F.size("nominees") > 0).select("row", "n_words", F.explode("nominees").alias("w")).select("row", "n_words", "w.*").withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
    known = windows.rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1)))
    met = asked.join(known, ["window", "size", "salt"]).select("row", "n_words", places.alias("at"), "items")
    hits = met.groupBy("row", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    n_hit = F.size("hit_words").cast("long")
    return hits.select("row", n_hit.alias("n_hit"), "hit_words", "item_ids", (20 * n_hit >= F.col("n_words")).alias("contaminated"))


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """One row per document: its id, word count, positions of hit words, ids of the items found, and the verdict."""
    windows = Windows(benchmark, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned, n, w = _scanned(rows, windows, "text", False)
    scanned = stored(scanned.select("id", F.col(n).alias("n_words"), F.col(w).alias("nominees"), F.monotonically_increasing_id().alias("row")), "scanned")
    judged = _judged(scanned, windows)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return scanned.select("row", "id", "n_words").join(judged, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("hit_words", none("int")).alias("hit_words"),
        F.coalesce("item_ids", none("string")).alias("item_ids"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def without_words(text: str, hit: set[int]) -> str:
    """text less the hit words; what stands between the others stays."""
    out, n, at, begin, word = [], -1, 0, 0, False
    data = text.encode()
    folded = data.translate(FOLD)
    while at < len(folded):
        word = folded[at] != 32
        begin = at
        while at < len(folded) and (folded[at] != 32) == word:
            at += 1
        n += word
        if not word or n not in hit:
            out.append(data[begin:at])
    return b"".join(out).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """docs with all their columns, less contaminated documents, or (remove="spans") with the hit words cut out.

    Rows without a nominee pass where they are scanned; only the others are stored, numbered and judged.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r}")
    windows = Windows(benchmark, item_col, item_text_col)
    scanned, n, w = _scanned(docs, windows, text_col, True)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clean = scanned.where(F.size(w) == 0).select(*columns)
    suspects = scanned.where(F.size(w) > 0).select(F.struct(*columns).alias("whole"), F.col(n).alias("n_words"), F.col(w).alias("nominees"), F.monotonically_increasing_id().alias("row"))
    suspects = stored(suspects, "suspects")
    judged = _judged(suspects, windows)
    if remove == "documents":
        return clean.unionByName(suspects.join(judged.where("contaminated"), "row", "left_anti").select("whole.*"))
    at = docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            hits = batch.column(batch.num_columns - 1).to_pylist()
            column = batch.column(at)
            changed = pa.array([t if t is None or not h else without_words(t, set(h)) for t, h in zip(column.to_pylist(), hits, strict=True)], column.type)
            yield pa.RecordBatch.from_arrays([changed if i == at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])

    hit = suspects.join(judged.select("row", F.col("hit_words").alias("hit_of_row")), "row", "left").select("whole.*", "hit_of_row")
    return clean.unionByName(hit.mapInArrow(cut, docs.schema))


def digest(found: DataFrame, id_col="doc_id") -> DataFrame:
    """The columns of the op1 query."""
    return found.select(
        id_col, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), "contaminated",
    )


__all__ = ["decontaminate", "digest", "find_passages"]

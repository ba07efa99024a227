"""The last decks of each user as keyed state, the stream's twin of ranking.deck_history.

A key's state is its list of the last `most` decks, newest first. A deck that is shown again moves to its new place, one that
arrives late is put where its time says, and what falls off the end is forgotten, which is safe, as the decks before it only
get newer. Each batch returns the lists of the keys that it touches, whole, so that a sink that replaces rows by key (such
as ingest.upsert_sink) holds what the batch twin gives, however the stream is cut or restarted. Rows without a deck are left out.

The session needs RocksDB as its state store (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(held: list[tuple[str, int]], shown: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """The last decks, newest first; of equal times by deck."""
    last: dict[str, int] = {}
    for deck, at in [*held, *shown]:
        last[deck] = max(at, last.get(deck, at))
    return sorted(last.items(), key=lambda d: (-d[1], d[0]))[:most]


class DeckHistory(StatefulProcessor):
    def __init__(self, key: str, most: int, idle_ms: int | None):
        self.key, self.most, self.idle_ms = key, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decks", "decks array<string>, at array<long>", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = list(zip(*self.state.get(), strict=True)) if self.state.exists() else []
        for frame in rows:
            held = merged(held, list(zip(frame["deck"].tolist(), frame["at"].tolist(), strict=True)), self.most)
        decks, at = [d for d, _ in held], [int(t) for _, t in held]
        self.state.update((decks, at))
        yield pd.DataFrame({self.key: [key[0]], "decks": [decks], "at": [at]})

    def close(self) -> None:
        pass


def deck_stream(shown: DataFrame, key: str, signature: str, at: str, most: int = 7, idle_ms: int | None = None) -> DataFrame:
    """key, decks and at (lists, newest first) of each key that a batch touches. shown: a stream; at is a long.

    idle_ms: a key that has not been shown anything for so long is forgotten.
    """
    rows = shown.where(F.col(signature).isNotNull() & F.col(at).isNotNull()).select(key, F.col(signature).cast("string").alias("deck"), F.col(at).cast("long").alias("at"))
    kind = shown.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(DeckHistory(key, most, idle_ms), f"`{key}` {kind}, decks array<string>, at array<long>", "update", "processingTime" if idle_ms else "none")

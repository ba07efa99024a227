"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import hashlib

import pyarrow as pa

from ..sources.shared import drop_stored, kept, shared_dir, stored
from ..sources.tables import table


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def give_back() -> None:
    """Returns what a task has freed to the system: a worker process serves the tasks of other stages next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


__all__ = ["blobs", "drop_stored", "give_back", "kept", "sha256", "shared_dir", "stored", "table", "texts"]

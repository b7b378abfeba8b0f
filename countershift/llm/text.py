"""Byte-level text helpers shared by the operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space, the separators between words everywhere in this subpackage.
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = 1 << 20


def blocks(data: bytes, size: int = _BLOCK) -> Iterator[bytes]:
    """Cut bytes into pieces of about ``size`` that end at white space, so that no word is cut."""
    if len(data) <= size:
        yield data
        return
    at = 0
    while at < len(data):
        found = _SPACE.search(data, min(at + size, len(data)))
        end = found.end() if found else len(data)
        yield data[at:end]
        at = end


def release_memory() -> None:
    """Give freed memory of this Python worker back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Of sorted batches the runs of rows that are equal in the first ``keys`` (integer) columns, each as one table."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and columns[:, a].tolist() != key:
                yield pa.Table.from_batches(held)
                held = []
            key = columns[:, a].tolist()
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)

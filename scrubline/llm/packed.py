"""Packed exchange of hashes between chunks of documents and buckets of hashes.

A row carries all hashes that one chunk has for one bucket: sorted, distinct,
four bytes each (the bucket holds the rest), so that a hash costs four bytes on
its way and a group task holds one bucket. Four bytes may agree by chance; what
is found this way is a superset that the operators then check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def keys(r: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper and the rest of the hash in the lower 32 bits."""
    return ((r >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF))


def cells(chunk: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(bucket, chunk, sorted distinct lower halves, how often each) of each cell."""
    if not len(key):
        return
    order = np.lexsort((key, chunk))
    chunk, key = chunk[order], key[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])))
    count = np.diff(np.append(first, len(key))).astype(np.uint32)
    chunk, key = chunk[first], key[first]
    bucket = key >> np.uint64(32)
    edge = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for a, b in zip(edge, [*edge[1:], len(key)]):
        yield int(bucket[a]), int(chunk[a]), low[a:b], count[a:b]


def find(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is x among them, at which place)."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at

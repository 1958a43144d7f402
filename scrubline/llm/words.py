"""Words and their 64-bit hashes over Arrow batches, without a loop over words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D (in UTF-8 those
bytes occur in no other character). A word's hash is a polynomial over a table
of random 64-bit values, one a byte, then mixed. Two different words agree with
a probability of about 2**-63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in groups of about this many bytes (one text is never cut).
GROUP_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[0x41:0x5B] = _TABLE[0x61:0x7B]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.cumprod(np.full(256, _BASE, np.uint64), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(1 << int(n).bit_length(), _BASE, np.uint64), dtype=np.uint64)
    return _powers[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    letter = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    return edge[::2], edge[1::2]


def hash_words(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a byte array."""
    a, b = word_spans(data)
    if not len(a):
        return np.zeros(0, np.uint64), a, b
    size = b - a
    values = (_LOWER if lower else _TABLE)[data]
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    at = within + np.repeat(a, size)
    terms = values[at] * powers(int(size.max()))[within]
    return mix(np.add.reduceat(terms, first) + size.astype(np.uint64)), a, b


def groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of texts of about ``size``
    bytes; nulls count as empty. One separator byte follows each text."""
    lengths = np.fromiter((0 if x is None else x for x in _lengths(texts)), np.int64, len(texts))
    a, total = 0, 0
    for k, n in enumerate(lengths):
        if total and total + n > size:
            yield _group(texts, a, k)
            a, total = k, 0
        total += int(n)
    if a < len(texts):
        yield _group(texts, a, len(texts))


def _lengths(texts: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc
    return pc.binary_length(texts).to_pylist()


def _group(texts: pa.Array, a: int, b: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    raw = [v or "" for v in texts.slice(a, b - a).to_pylist()]
    parts = [v.encode("utf-8") for v in raw]
    data = np.frombuffer(b"\n".join([*parts, b""]) if parts else b"", np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    return a, b, data, offsets


def hashed(texts: pa.Array, lower: bool) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    for _, _, data, offsets in groups(texts):
        h, start, _ = hash_words(data, lower)
        cut = np.searchsorted(start, offsets)
        for k in range(len(offsets) - 1):
            yield h[cut[k]:cut[k + 1]]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` consecutive words at each position; of the whole
    sequence, if it is shorter; none without words."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = h[:len(h) - k + 1]
    for j in range(1, k):
        out = mix(out * _BASE + h[j:len(h) - k + 1 + j])
    return out if k > 1 else mix(out)

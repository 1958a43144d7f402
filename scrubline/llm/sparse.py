"""Incidence matrices in compressed sparse rows, built by hand on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Entries that a product expands at a time (more only for one longer row).
BLOCK = 1 << 20


@dataclass
class Csr:
    """Row r holds columns indices[indptr[r]:indptr[r + 1]], each with the value in
    data (None: all are 1)."""
    indptr: np.ndarray
    indices: np.ndarray
    columns: int
    data: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    def transpose(self) -> Csr:
        """Rows become columns: entries dealt out by a count of each column."""
        indptr = np.append(0, np.cumsum(np.bincount(self.indices, minlength=self.columns)))
        sorted_already = len(self.indices) < 2 or bool((self.indices[1:] >= self.indices[:-1]).all())
        order = slice(None) if sorted_already else np.argsort(self.indices, kind="stable")
        return Csr(indptr, self.row_of()[order], self.rows, None if self.data is None else self.data[order])


def spans(ends: np.ndarray, lo: int, hi: int) -> Csr:
    """Incidence of consecutive spans (their ends, the first starting at 0) and the
    places lo..hi: one row a span that meets them, its places as columns from 0."""
    cut = np.clip(ends, lo, hi) - lo
    return Csr(np.append(0, cut), np.arange(hi - lo), hi - lo)


def members(group: np.ndarray, groups: int) -> Csr:
    """Incidence of rows and the group that each belongs to."""
    return Csr(np.arange(len(group) + 1), group, groups)


def expansion(a: Csr, b: Csr) -> np.ndarray:
    """Products that each row of a·b adds up: the work, known before it is done."""
    total = np.append(0, np.cumsum(np.diff(b.indptr)[a.indices]))
    return total[a.indptr[1:]] - total[a.indptr[:-1]]


def multiply(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product a·b, a block of rows at a time: for each entry (i, k) of
    a row i, row k of b is added to row i of the product. Yields (rows, columns,
    values) of the nonzero entries in order of rows and columns."""
    work = np.cumsum(expansion(a, b))
    first = 0
    while first < a.rows:
        done = work[first - 1] if first else 0
        end = max(int(np.searchsorted(work, done + block, "right")), first + 1)
        lo, hi = a.indptr[first], a.indptr[end]
        k, value = a.indices[lo:hi], None
        row, at = np.repeat(np.arange(first, end), np.diff(a.indptr[first:end + 1])), b.indptr[k]
        size = b.indptr[k + 1] - at
        if a.data is not None:
            value = a.data[lo:hi]
        if (size != 1).any():  # rows of b that add several entries, or none
            stop = np.cumsum(size)
            row, at = np.repeat(row, size), np.arange(stop[-1]) + np.repeat(at - stop + size, size)
            value = None if value is None else np.repeat(value, size)
        if b.data is not None:
            value = b.data[at] if value is None else value * b.data[at]
        key = row * b.columns + b.indices[at]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], None if value is None else value[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.diff(np.append(new, len(key))) if value is None or not len(key) else np.add.reduceat(value, new)
        row, column = np.divmod(key[new], max(b.columns, 1))
        yield row, column, total
        first = end

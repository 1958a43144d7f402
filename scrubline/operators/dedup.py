"""Deduplication (C9, C9a, C9b) as aggregates, never as per-key windows.

A ``row_number()`` window over the key moves a hot key (a third of all rows)
into one task. Every variant here is a ``groupBy`` instead, so the hot key is
first collapsed inside each map task (partial aggregation) and only one partial
row per task crosses the shuffle:

* full-row dedup: ``dropDuplicates()`` (hash aggregate on all columns);
* ``keep="first"|"last"`` on a subset: ``min_by``/``max_by`` of the whole row
  ordered by ``(order_by..., remaining columns)`` - deterministic on ties;
* ``keep="none"``: ``count`` plus ``any_value`` of the row, then ``count == 1``.

NULL keys form one group, as pandas does.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import duplicate_count  # noqa: F401  (R5, re-exported)

KEEP = ("first", "last", "none")


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def deduplicate(df: DataFrame, subset: Sequence[str] | str | None = None, keep: str | bool = "first",
                order_by: Sequence[str] | str | None = None) -> DataFrame:
    """Drop duplicate rows (on ``subset``, default all columns).

    ``keep``: ``"first"`` / ``"last"`` keep one row per key by ``order_by``
    order; ``"none"`` (or ``False``) drops every member of a duplicated group.
    An unknown subset column raises, as does an unknown ``keep``.
    """
    if keep is False:
        keep = "none"
    X.require_batch(df, "deduplicate")
    if keep not in KEEP:
        raise ValueError(f"deduplicate: keep must be one of {KEEP} or False, not {keep!r}")
    keys = _as_list(subset)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"deduplicate: unknown subset columns {missing}")
    cols = list(df.columns)
    full_row = not keys or set(keys) == set(cols)
    if full_row:
        if keep == "none":
            return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
                    .where(F.col("_n") == 1).select(*cols))
        # identical rows: whichever is kept, the result is the same
        return df.dropDuplicates()
    row = F.struct(*[F.col(c) for c in cols])
    if keep == "none":
        return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(row).alias("_row"))
                .where(F.col("_n") == 1).select("_row.*"))
    order = _as_list(order_by)
    if not order:
        raise ValueError("deduplicate: keep first/last on a subset needs order_by (row order must be explicit)")
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in cols if c not in order and c not in keys])
    pick = F.min_by(row, rank) if keep == "first" else F.max_by(row, rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``(rows_before, rows_after, removed)``."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    return b.withColumn("rows_after", after.agg(F.count(F.lit(1))).scalar()).withColumn(
        "removed", F.col("rows_before") - F.col("rows_after"))

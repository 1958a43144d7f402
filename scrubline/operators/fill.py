"""Forward and backward fill in row order (W1, W2) without a global window.

A window without ``partitionBy`` moves every row into one task. Instead rows are
cut into *blocks*, contiguous ranges of the whole order tuple (order keys, then
the remaining columns as tie-breakers) of about ``rows_per_block`` rows, whose
boundaries histograms find (``ranges.py``). Equal, NULL and text keys are split
like any others; a table of a single block is one window a group. Then

1. inside each ``(partition_by..., block)`` window the usual running
   ``last(value, ignorenulls)`` fills what it can;
2. one small aggregate takes each block's last non-missing value (``max_by``
   over the order key, map-side combined);
3. a running ``last(..., ignorenulls)`` over the *block* table (one row per group
   and block) gives what each block inherits from the blocks before it;
4. the block table is counted, and joined back by broadcast if it is small; it
   fills the leading gaps of each block.

A hot ``partition_by`` group holding a third of all rows is still spread over
many blocks. Backward fill is the mirror image, computed as running windows in
descending order (every frame here grows row by row: O(n) per partition).
Counting, writing and the block table are jobs that run when the fill is called.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .quantile import settled
from .ranges import blocks, orderable

ROWS_PER_BLOCK = 1_000_000


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def _with_blocks(df: DataFrame, order: Sequence[str] | str, rows_per_block: int) -> DataFrame:
    """``df`` with ``_blk``: contiguous ranges of the order tuple, NULLs first."""
    return blocks(df, order, rows_per_block)


def _fill(df: DataFrame, cols: Sequence[str] | str | None, order_by, partition_by,
          forward: bool, rows_per_block: int, unique_order: bool = False) -> DataFrame:
    order = _as_list(order_by)
    if not order:
        raise ValueError("forward/backward fill needs order_by: row order must be explicit")
    X.require_batch(df, "forward/backward fill")
    pby = _as_list(partition_by)
    targets = [c for c in (_as_list(cols) or X.visible_columns(df)) if c in df.columns and c not in order and c not in pby]
    if not targets:
        return df
    keep = list(df.columns)
    if not unique_order:
        # ties in the order key are broken by the remaining columns, so a
        # recomputed task fills exactly as the first attempt did
        order = order + [f.name for f in df.schema.fields
                         if f.name not in order and f.name not in pby and orderable(f.dataType)]
    # the value to carry: NaN counts as missing
    vals = {c: F.when(~X.is_missing(F.col(c), X.dtype_of(df, c)), F.col(c)) for c in targets}
    total = df.count()
    if total <= rows_per_block:  # a single block: nothing to carry over
        keys = order if forward else [F.col(o).desc_nulls_last() for o in order]
        w = Window.partitionBy(*(pby or [F.lit(0)])).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        filled = {c: F.last(v, ignorenulls=True).over(w).cast(X.dtype_of(df, c)) for c, v in vals.items()}
        return df.withColumns(filled).select(*keep)
    blk = blocks(df, order, rows_per_block, total)
    # a single order column orders max_by/min_by directly (fixed-width buffer:
    # hash aggregation); several need a struct (sort-based aggregation)
    okey = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])
    if forward:
        w_in = Window.partitionBy(*pby, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        local = {c: F.last(v, ignorenulls=True).over(w_in) for c, v in vals.items()}
        tails = blk.groupBy(*pby, "_blk").agg(
            *[F.max_by(v, F.when(v.isNotNull(), okey)).alias(c) for c, v in vals.items()])
        w_blk = Window.partitionBy(*pby).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        carry = tails.select(*pby, "_blk", *[F.last(c, ignorenulls=True).over(w_blk).alias(f"_carry_{c}")
                                             for c in targets])
    else:
        # "next non-missing value" = running last value in *descending* order:
        # a growing frame (O(n)) instead of an unbounded-following frame, which
        # Spark re-aggregates for every row (O(n^2) per window partition)
        desc = [F.col(o).desc_nulls_last() for o in order]
        w_in = Window.partitionBy(*pby, "_blk").orderBy(*desc).rowsBetween(Window.unboundedPreceding, 0)
        local = {c: F.last(v, ignorenulls=True).over(w_in) for c, v in vals.items()}
        heads = blk.groupBy(*pby, "_blk").agg(
            *[F.min_by(v, F.when(v.isNotNull(), okey)).alias(c) for c, v in vals.items()])
        w_blk = Window.partitionBy(*pby).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = heads.select(*pby, "_blk", *[F.last(c, ignorenulls=True).over(w_blk).alias(f"_carry_{c}")
                                             for c in targets])
    filled = blk.withColumns({f"_local_{c}": e for c, e in local.items()})
    keys = pby + ["_blk"]
    cond = None
    for k in keys:
        e = F.col(f"_L.{k}").eqNullSafe(F.col(f"_R.{k}"))
        cond = e if cond is None else cond & e
    joined = filled.alias("_L").join(settled(carry).alias("_R"), cond, "left").select(
        "_L.*", *[F.col(f"_R._carry_{c}") for c in targets])
    out = joined.withColumns({c: F.coalesce(F.col(f"_local_{c}"), F.col(f"_carry_{c}")).cast(X.dtype_of(df, c))
                              for c in targets})
    return out.select(*keep)


def forward_fill(df: DataFrame, cols: Sequence[str] | str | None = None, order_by=None,
                 partition_by=None, rows_per_block: int = ROWS_PER_BLOCK,
                 unique_order: bool = False) -> DataFrame:
    """Each missing cell takes the last non-missing value before it in
    ``order_by`` order (within ``partition_by`` groups); leading gaps stay NULL.

    Ties in ``order_by`` are broken by the remaining columns; pass
    ``unique_order=True`` when the order key is unique (a single numeric key
    then keeps the block tails on hash aggregation)."""
    return _fill(df, cols, order_by, partition_by, True, rows_per_block, unique_order)


def backward_fill(df: DataFrame, cols: Sequence[str] | str | None = None, order_by=None,
                  partition_by=None, rows_per_block: int = ROWS_PER_BLOCK,
                  unique_order: bool = False) -> DataFrame:
    """Each missing cell takes the next non-missing value after it."""
    return _fill(df, cols, order_by, partition_by, False, rows_per_block, unique_order)

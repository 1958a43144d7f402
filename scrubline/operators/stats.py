"""Statistic-based cleaners: impute missing values (C10) and replace sentinels (C11).

Two steps. First the statistics of all target columns come from
one long-format pass: the targets are stacked into ``(column, value)`` rows and
aggregated per column (exact median by radix selection, mean by ``avg``, mode
by two combined aggregates), optionally per ``by`` group. Then the statistics
are applied to every row: without ``by`` as a scalar subquery holding a
``map<column, statistic>`` (one row, size bounded by the number of columns;
Spark runs it once and inlines the result), with ``by`` as an equi-join on the
group keys: the statistics table is computed and counted first, broadcast when it
is small (then no row of the table is shuffled) and shuffled when it is not. No
``collect()`` and no cross join.
"""

from __future__ import annotations

import decimal
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from . import fill as W
from .quantile import approx_median, exact_median, settled

_STATS = "__scrubline_stats"


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def _numeric_like(df: DataFrame) -> list[str]:
    """Columns that the numeric strategies may fill: numeric and text ones."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.StringType)) and f.name in X.visible_columns(df)]


def _holding(df: DataFrame, cols: Sequence[str], cell: Callable[[str], Column]) -> list[str]:
    """The columns with at least one cell that ``cell`` selects: default targets
    depend on the data, so one aggregate over these columns finds them."""
    if not cols:
        return []
    X.require_batch(df, "default targets")
    row = df.agg(*[F.coalesce(F.bool_or(cell(c)), F.lit(False)).alias(f"_{k}") for k, c in enumerate(cols)]).first()
    return [c for k, c in enumerate(cols) if row[k]]


# A fractional statistic does not fit an integral column or, with more digits, a
# decimal one. Such a column is widened so that every cell keeps its exact value:
# up to 32 bits to double, long to decimal(28, 8), a decimal to at least 8 places.
_PLACES = 8


def filled_type(dt: T.DataType) -> T.DataType:
    """Type of a numeric column after a statistic has been written into it."""
    if isinstance(dt, T.LongType):
        return T.DecimalType(20 + _PLACES, _PLACES)
    if isinstance(dt, T.IntegralType):
        return T.DoubleType()
    if isinstance(dt, T.DecimalType):
        places = max(dt.scale, _PLACES)
        digits = dt.precision - dt.scale + places
        return T.DecimalType(digits, places) if digits <= 38 else dt
    return dt


def constant(value, dt: T.DataType) -> tuple[Column, T.DataType]:
    """(``value`` as a literal, type of the column that takes it): the column's
    own type if the value fits it exactly, else the type of :func:`filled_type`."""
    if isinstance(dt, T.StringType):
        return F.lit(str(value) if not isinstance(value, str) else value), dt
    if isinstance(value, str):
        raise TypeError(f"text {value!r} does not fit a column of {dt.simpleString()}")
    d = decimal.Decimal(str(value)) if not isinstance(value, bool) else decimal.Decimal(int(value))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.lit(float(value)).cast(dt), dt
    if not d.is_finite():
        raise TypeError(f"{value!r} does not fit a column of {dt.simpleString()}")
    bits = {"byte": 7, "short": 15, "integer": 31, "long": 63}
    if isinstance(dt, T.IntegralType):
        if d == d.to_integral_value() and -(1 << bits[dt.typeName()]) <= d < (1 << bits[dt.typeName()]):
            return F.lit(int(d)).cast(dt), dt
    elif d == d.quantize(decimal.Decimal(1).scaleb(-dt.scale)) and abs(d) < decimal.Decimal(10) ** (dt.precision - dt.scale):
        return F.lit(d).cast(dt), dt
    wide = filled_type(dt)
    if isinstance(wide, T.DecimalType) and (wide == dt or -d.as_tuple().exponent > wide.scale or abs(d) >= decimal.Decimal(10) ** (wide.precision - wide.scale)):
        raise TypeError(f"{value!r} does not fit a column of {dt.simpleString()}, not even widened to {wide.simpleString()}")
    return F.lit(d).cast(wide) if isinstance(wide, T.DecimalType) else F.lit(float(value)), wide


def _stack(df: DataFrame, values: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """Long format ``(by..., _col, _v)``: one row per input row and target column."""
    cells = F.array(*[F.struct(F.lit(c).alias("_col"), e.cast("double").alias("_v")) for c, e in values.items()])
    return df.select(*by, F.explode(cells).alias("_s")).select(*by, "_s._col", "_s._v")


def _numeric_stats(df: DataFrame, values: dict[str, Column], strategy: str,
                   by: Sequence[str], method: str) -> DataFrame:
    """``(by..., _stats map<string,double>)``: one statistic per target column."""
    by = list(by)
    long = _stack(df, values, by)
    if strategy == "mean":
        per = long.where(F.col("_v").isNotNull()).groupBy(*by, "_col").agg(F.avg("_v").alias("_stat"))
    elif method == "approx":
        per = approx_median(long, "_v", by + ["_col"], name="_stat")
    else:
        per = exact_median(long, "_v", by + ["_col"], bounded_groups=not by, name="_stat")
    packed = F.map_from_entries(F.collect_list(F.struct("_col", "_stat"))).alias("_stats")
    return per.groupBy(*by).agg(packed) if by else per.agg(packed)


def _join_by(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    stats = settled(stats)
    cond = None
    for k in by:
        c = F.col(f"_L.{k}").eqNullSafe(F.col(f"_R.{k}"))
        cond = c if cond is None else cond & c
    return df.alias("_L").join(stats.alias("_R"), cond, "left").select("_L.*", *[
        F.col(f"_R.{c}") for c in stats.columns if c not in by])


def _apply(df: DataFrame, stats: DataFrame | None, by: Sequence[str],
           fills: Callable[[DataFrame, Column], dict[str, Column]]) -> DataFrame:
    """Attach the statistics map (scalar subquery or group join) and rewrite columns."""
    if stats is None:
        return df.withColumns(fills(df, F.lit(None)))
    cols = list(df.columns)
    if by:
        joined = _join_by(df, stats, by)
        return joined.withColumns(fills(joined, F.col("_stats"))).select(*cols)
    # the scalar subquery is attached once as a column, so it runs once however
    # many target columns read it
    attached = df.withColumn(_STATS, stats.select("_stats").scalar())
    return attached.withColumns(fills(attached, F.col(_STATS))).select(*cols)


def _fill_value(c: str, dt: T.DataType, missing: Column, stat: Column) -> Column:
    """Write ``stat`` where ``missing`` and the statistic exists; other cells keep
    their exact values (text columns get the statistic as text)."""
    wide = dt if isinstance(dt, T.StringType) else filled_type(dt)
    return F.coalesce(F.when(missing, stat.cast(wide)), F.col(c).cast(wide))


def _missing_in(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return _holding(df, cols, lambda c: X.is_missing(F.col(c), X.dtype_of(df, c)))


# ------------------------------------------------------------------- C10

def impute_missing(df: DataFrame, cols: Sequence[str] | str | None = None, strategy: str = "median",
                   value=None, order_by: Sequence[str] | str | None = None,
                   by: Sequence[str] | str | None = None, method: str = "exact") -> DataFrame:
    """Fill NULL (and NaN) cells.

    ``strategy``: ``median`` (exact, or ``method="approx"``), ``mean``,
    ``mode`` (ties -> smallest), ``constant`` (``value``; None fills nothing),
    ``forward_fill`` / ``backward_fill`` (need ``order_by``). An unknown
    strategy falls back to median. Without ``cols`` every eligible column with a
    missing cell is a target (found by one aggregate); others are unchanged. A
    NULL statistic fills nothing. Cells that are not filled keep their exact
    values; a column that the filled value does not fit is widened
    (:func:`filled_type`).
    """
    by = _as_list(by)
    targets = _as_list(cols)
    if strategy not in ("constant",):
        X.require_batch(df, f"impute_missing({strategy})")
    known = ("median", "mean", "mode", "constant", "forward_fill", "backward_fill")
    if strategy not in known:
        strategy = "median"
    if strategy in ("forward_fill", "backward_fill"):
        t = [c for c in (targets or X.visible_columns(df)) if c in df.columns and c not in by and c not in _as_list(order_by)]
        fn = W.forward_fill if strategy == "forward_fill" else W.backward_fill
        return fn(df, t, order_by=order_by, partition_by=by or None)

    if strategy == "constant":
        if value is None:
            return df
        text = isinstance(value, str)
        default = [f.name for f in df.schema.fields
                   if (isinstance(f.dataType, T.StringType) if text else isinstance(f.dataType, T.NumericType))
                   and f.name in X.visible_columns(df)]
        t = [c for c in (targets or _missing_in(df, default)) if c in df.columns and c not in by]
        out = {}
        for c in t:
            dt = X.dtype_of(df, c)
            if not isinstance(dt, (T.NumericType, T.StringType)):
                out[c] = F.when(X.is_missing(F.col(c), dt), F.lit(value).cast(dt)).otherwise(F.col(c))
                continue
            if text and isinstance(dt, T.NumericType):
                raise TypeError(f"impute_missing: text {value!r} into numeric column {c!r}")
            lit, wide = constant(value, dt)
            out[c] = F.when(X.is_missing(F.col(c), dt), lit).otherwise(F.col(c).cast(wide))
        return df.withColumns(out) if out else df

    if strategy == "mode":
        t = [c for c in (targets or _missing_in(df, X.visible_columns(df))) if c in df.columns and c not in by]
        return _impute_modes(df, t, by) if t else df

    # median / mean over numeric-coerced values
    t = [c for c in (targets or _missing_in(df, _numeric_like(df))) if c in df.columns and c not in by
         and isinstance(X.dtype_of(df, c), (T.NumericType, T.StringType))]
    if not t:
        return df
    values = {c: X.num_col(df, c) for c in t}
    stats = _numeric_stats(df, values, strategy, by, method)

    def fills(frame: DataFrame, smap: Column) -> dict[str, Column]:
        return {c: _fill_value(c, X.dtype_of(df, c), X.is_missing(F.col(c), X.dtype_of(df, c)), smap[c])
                for c in t}
    return _apply(df, stats, by, fills)


def _impute_modes(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """C10c for many columns in one pass.

    Every target cell becomes ``(column, s, d, l)`` with one typed slot set
    (text, floating, decimal, or integral/date/timestamp as a long), so one
    ``groupBy(by, column, s, d, l).count()`` counts the values of all columns
    at once. ``min_by`` over ``(-count, value)`` then picks each column's most
    frequent value (ties -> smallest) into a small ``map<column, value>``,
    applied like the other statistics. Each slot orders like its column's type.
    """
    from .profile import _typed
    cells = F.array(*[F.struct(F.lit(c).alias("_col"), _typed(df, c).alias("v")) for c in cols])
    long = (df.select(*by, F.explode(cells).alias("_x"))
            .select(*by, F.col("_x._col").alias("_col"), F.col("_x.v.s").alias("s"),
                    F.col("_x.v.d").alias("d"), F.col("_x.v.l").alias("l"), F.col("_x.v.m").alias("m"))
            .where(F.col("s").isNotNull() | F.col("d").isNotNull() | F.col("l").isNotNull() | F.col("m").isNotNull()))
    counts = long.groupBy(*by, "_col", "s", "d", "l", "m").agg(F.count(F.lit(1)).alias("_n"))
    value = F.struct("s", "d", "l", "m")
    pick = F.min_by(value, F.struct((-F.col("_n")).alias("a"), value.alias("b"))).alias("_mode")
    per = counts.groupBy(*by, "_col").agg(pick)
    packed = F.map_from_entries(F.collect_list(F.struct("_col", "_mode"))).alias("_stats")
    stats = per.groupBy(*by).agg(packed) if by else per.agg(packed)

    def restore(c: str, m: Column) -> Column:
        dt = X.dtype_of(df, c)
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            return m["d"].cast(dt)
        if isinstance(dt, T.IntegralType):
            return m["l"].cast(dt)
        if isinstance(dt, T.DateType):
            return F.date_from_unix_date(m["l"].cast("int"))
        if isinstance(dt, T.DecimalType):
            return F.coalesce(m["m"].cast(dt), m["s"].cast(dt))
        if isinstance(dt, T.TimestampType):
            return F.timestamp_micros(m["l"])
        if isinstance(dt, T.TimestampNTZType):
            return X.ntz_of_micros(m["l"])
        return m["s"].cast(dt)

    def fills(frame: DataFrame, smap: Column) -> dict[str, Column]:
        return {c: F.coalesce(F.when(X.is_missing(F.col(c), X.dtype_of(df, c)), restore(c, smap[c])), F.col(c))
                for c in cols}
    return _apply(df, stats, by, fills)


# ------------------------------------------------------------------- C11

def replace_sentinel(df: DataFrame, cols: Sequence[str] | str | None = None, sentinel: float = X.SENTINEL,
                     strategy: str = "median", value=None,
                     valid: Callable[[Column], Column] | None = None,
                     by: Sequence[str] | str | None = None, method: str = "exact") -> DataFrame:
    """C11: replace cells equal (after numeric coercion) to ``sentinel``.

    The statistic is taken over non-sentinel, non-missing values (and, with
    ``valid``, only values passing that predicate - e.g. ``lambda v: v > 0``
    for "median of valid prices"); an empty statistic gives 0.0. ``constant``
    uses ``value`` or 0; any other strategy means median. Without ``cols``
    every numeric or text column that holds the sentinel is a target (found by
    one aggregate). Other cells keep their exact values (:func:`filled_type`).
    """
    by = _as_list(by)
    if strategy != "constant":
        X.require_batch(df, f"replace_sentinel({strategy})")
    s = F.lit(float(sentinel))

    def mask(c: str) -> Column:
        return F.coalesce(X.num_col(df, c) == s, F.lit(False))

    t = [c for c in (_as_list(cols) or _holding(df, _numeric_like(df), mask)) if c in df.columns and c not in by
         and isinstance(X.dtype_of(df, c), (T.NumericType, T.StringType))]
    if not t:
        return df
    if strategy not in ("median", "mean", "constant"):
        strategy = "median"

    if strategy == "constant":
        fill_v = value if value is not None else 0
        out = {}
        for c in t:
            dt = X.dtype_of(df, c)
            lit, wide = constant(fill_v, dt)
            out[c] = F.when(mask(c), lit).otherwise(F.col(c).cast(wide))
        return df.withColumns(out)

    values = {}
    for c in t:
        v = X.num_col(df, c)
        keep = v != s
        if valid is not None:
            keep = keep & valid(v)
        values[c] = F.when(keep, v)
    stats = _numeric_stats(df, values, strategy, by, method)

    def fills(frame: DataFrame, smap: Column) -> dict[str, Column]:
        return {c: _fill_value(c, X.dtype_of(df, c), mask(c), F.coalesce(smap[c], F.lit(0.0))) for c in t}
    return _apply(df, stats, by, fills)

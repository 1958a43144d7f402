"""Row-local cleaners C1-C8: narrow projections, no shuffle, stream-safe.

Each cleaner is ``DataFrame -> DataFrame`` and only rewrites its target
columns with built-in Column expressions (no Python UDF), so a chain of them
collapses into one ``Project`` inside whole-stage codegen. Absent target
columns are skipped, as in the reference.
"""

from __future__ import annotations

import decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from .stats import constant, filled_type


def _targets(df: DataFrame, cols: Sequence[str] | str | None, default: Sequence[str]) -> list[str]:
    if cols is None or (not isinstance(cols, str) and len(cols) == 0):
        cols = list(default)
    elif isinstance(cols, str):
        cols = [cols]
    return [c for c in cols if c in df.columns]


def _as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # a phone held as a float must not turn into "....0" (T12)
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    if isinstance(dtype, T.DecimalType):
        return F.when(c % 1 == 0, c.cast(T.DecimalType(38, 0)).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


# ------------------------------------------------------------------- C1

def phone_e164_expr(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """US phone to E.164: strip non-digits; 10 digits -> +1…, 11 digits with a
    leading 1 -> +…; anything else (and NULL) unchanged. A number is read by its
    digits if it is whole; one with a fraction or a sign is no phone."""
    s = _as_text(c, dtype)
    d = F.regexp_replace(s, r"\D", "")
    if isinstance(dtype, T.NumericType):
        d = F.when(s.rlike(r"^\d+$"), d)
    return (F.when(s.isNull(), s)
            .when(F.length(d) == 10, F.concat(F.lit("+1"), d))
            .when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d))
            .otherwise(s))


def standardize_phone(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Normalise phone columns (default ``phone``) to E.164."""
    t = _targets(df, cols, ["phone"])
    return df.withColumns({c: phone_e164_expr(F.col(c), X.dtype_of(df, c)) for c in t}) if t else df


# ------------------------------------------------------------------- C2

def lowercase(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Lower-case text columns (default ``email``); NULL stays NULL."""
    t = _targets(df, cols, ["email"])
    return df.withColumns({c: F.lower(F.col(c).cast("string")) for c in t}) if t else df


# ------------------------------------------------------------------- C3

def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name in X.visible_columns(df)]


def _bound(value, dt: T.DataType, upper: bool):
    """``value``, or None where no value of the type can lie beyond it."""
    if value is None or isinstance(dt, (T.FloatType, T.DoubleType)):
        return value
    d = decimal.Decimal(str(value))
    if d.is_nan():
        raise TypeError("clamp_range: a bound must not be NaN")
    if isinstance(dt, T.IntegralType):
        least, most = -(1 << (8 * _WIDTH[dt.typeName()] - 1)), (1 << (8 * _WIDTH[dt.typeName()] - 1)) - 1
    else:
        most = decimal.Decimal((0, (9,) * dt.precision, -dt.scale))
        least = -most
    return None if (d >= most if upper else d <= least) else value


_WIDTH = {"byte": 1, "short": 2, "integer": 4, "long": 8}


def _fits(value, dt: T.DataType) -> bool:
    return value is None or constant(value, dt)[1] == dt


def clamp_range(df: DataFrame, cols: Sequence[str] | str | None = None,
                min_val: float | None = None, max_val: float | None = None) -> DataFrame:
    """Clip numeric columns to ``[min_val, max_val]`` (either may be None).

    Reversed bounds are swapped; NULL and NaN stay missing (as NULL). Values are
    compared in the column's own type, so none is rounded; a bound that no value
    of the type lies beyond is no bound. A column keeps its type if it can hold
    the bounds exactly (a float column takes the nearest float); else it is widened as
    a fill would (``filled_type``), or TypeError is raised if that cannot hold them
    either. A named non-numeric column is an error.
    """
    if min_val is None and max_val is None:
        return df
    if min_val is not None and max_val is not None and min_val > max_val:
        min_val, max_val = max_val, min_val
    t = _targets(df, cols, _numeric_columns(df))
    out = {}
    for c in t:
        dt = X.dtype_of(df, c)
        if not isinstance(dt, T.NumericType):
            raise TypeError(f"clamp_range: column {c!r} is {dt.simpleString()}, not numeric")
        lo, hi = _bound(min_val, dt, False), _bound(max_val, dt, True)
        typ = dt if _fits(lo, dt) and _fits(hi, dt) else filled_type(dt)
        v = F.col(c).cast(typ)
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            v = X.nan_to_null(v)
        e = v
        if lo is not None:
            e = F.greatest(e, constant(lo, dt)[0].cast(typ))
        if hi is not None:
            e = F.least(e, constant(hi, dt)[0].cast(typ))
        # greatest/least skip NULL, so guard: a missing value stays missing
        out[c] = F.when(v.isNotNull(), e)
    return df.withColumns(out) if out else df


# ------------------------------------------------------------------- C4

def fix_date_order(df: DataFrame, start: str = "dob", end: str = "admission_date",
                   mode: str = "swap", fmt: str = X.DATE_FORMAT) -> DataFrame:
    """Where ``start > end``, swap them (``mode="swap"``) or NULL the
    start (``mode="null_start"``; ``"null_dob"`` is accepted too). Both columns
    come back as DateType; unparseable text becomes NULL. Missing columns
    leave the table unchanged."""
    if not X.present(df, start, end):
        return df
    s, e = X.date_col(df, start, fmt), X.date_col(df, end, fmt)
    bad = s > e
    if mode == "swap":
        # withColumns evaluates both against the input row: a true swap
        return df.withColumns({start: F.when(bad, e).otherwise(s), end: F.when(bad, s).otherwise(e)})
    if mode in ("null_start", "null_dob"):
        return df.withColumns({start: F.when(bad, F.lit(None).cast("date")).otherwise(s), end: e})
    return df.withColumns({start: s, end: e})


# ------------------------------------------------------------------- C5

def code_format_expr(c: Column) -> Column:
    """ICD-10 repair: strip, upper-case, drop spaces, insert the missing dot;
    keep the repaired text only when it is a valid code, else the original."""
    s = F.regexp_replace(F.upper(X.strip_ws(c)), " ", "")
    dotted = F.when(s.rlike(X.ICD10_NO_DOT), F.regexp_replace(s, r"^([A-Z]\d{2})(\d{1,2})$", "$1.$2")).otherwise(s)
    return F.when(c.isNull(), c).when(dotted.rlike(X.ICD10_LENIENT), dotted).otherwise(c)


def fix_code_format(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Repair ICD-10 code columns (default ``icd10_code``)."""
    t = _targets(df, cols, ["icd10_code"])
    return df.withColumns({c: code_format_expr(F.col(c).cast("string")) for c in t}) if t else df


# ------------------------------------------------------------------- C6

def abs_negative(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Negative values (after numeric coercion) become their absolute value."""
    t = _targets(df, cols, ["dosage_mg"])
    out = {}
    for c in t:
        dt = X.dtype_of(df, c)
        v = X.num(F.col(c), dt)
        if isinstance(dt, T.NumericType):
            out[c] = F.when(v < 0, F.abs(F.col(c))).otherwise(F.col(c))
        else:
            out[c] = F.when(v < 0, F.abs(v).cast("string")).otherwise(F.col(c))
    return df.withColumns(out) if out else df


# ------------------------------------------------------------------- C7

def fill_blank(df: DataFrame, cols: Sequence[str] | str | None = None, value=X.BLANK_FILL) -> DataFrame:
    """NULL or whitespace-only cells become ``value``. No default target:
    an empty column list changes nothing. Text into a numeric column is an
    error (the type would drift); a number that the column's type cannot hold
    widens it exactly, as a constant fill does (``stats.constant``)."""
    t = _targets(df, cols, [])
    out = {}
    for c in t:
        dt = X.dtype_of(df, c)
        if isinstance(dt, T.NumericType):
            if not isinstance(value, (int, float, decimal.Decimal)):
                raise TypeError(f"fill_blank: cannot put text {value!r} into numeric column {c!r}")
            fill, typ = constant(value, dt)
        else:
            fill, typ = F.lit(value).cast(dt), dt
        out[c] = F.when(X.is_blank(F.col(c), dt), fill).otherwise(F.col(c).cast(typ))
    return df.withColumns(out) if out else df


# ------------------------------------------------------------------- C8

def drop_columns(df: DataFrame, cols: Sequence[str] | str | None = None,
                 protected: Sequence[str] = ()) -> DataFrame:
    """Drop the listed columns that exist; refusing ``protected`` ones."""
    t = _targets(df, cols, [])
    hit = [c for c in t if c in set(protected)]
    if hit:
        raise ValueError(f"drop_columns: refusing to drop protected columns {hit}")
    return df.drop(*t) if t else df

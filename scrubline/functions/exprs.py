"""Shared Column helpers: the null model, numeric coercion, whitespace, dates.

Every numeric path goes through :func:`num` so that text is coerced the way a
lenient ``to_numeric`` would, and NaN is treated as missing (Spark keeps NaN
apart from NULL; the cleaning semantics do not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: patterns and bounds whose exact text decides results. ---
# US E.164 phone (rule R6).
E164_US = r"^\+1\d{10}$"
# ICD-10 code as the rule accepts it (R11): letter, two digits, dot, 1-2 digits.
ICD10_STRICT = r"^[A-Z]\d{2}\.\d{1,2}$"
# ICD-10 code as the repair accepts it (C5): the decimal part is optional.
ICD10_LENIENT = r"^[A-Z]\d{2}(\.\d{1,2})?$"
# ICD-10 code missing its dot (C5): letter and 3-4 digits.
ICD10_NO_DOT = r"^[A-Z]\d{3,4}$"
# Age bounds of the CRM suite.
AGE_MIN, AGE_MAX = 18, 100
# Default sentinel.
SENTINEL = -1
# Default text for blank mandatory cells.
BLANK_FILL = "UNKNOWN"
# Date text format of the fixtures.
DATE_FORMAT = "yyyy-MM-dd"
# --- end of fixed values ---

# Text that a lenient numeric parser accepts: optional sign, digits with an
# optional fraction, optional exponent, surrounding whitespace; or inf / nan.
_NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL_TEXT = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"
# Python's str.strip() removes any Unicode whitespace; Spark's trim only spaces.
_EDGE_WS = r"(?U)^\s+|\s+$"


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def nan_to_null(c: Column) -> Column:
    """NULL where ``c`` is NaN; ``c`` must be a double/float column."""
    return F.when(~F.isnan(c), c)


def num(c: Column | str, dtype: T.DataType) -> Column:
    """Coerce to double with NULL for anything unparseable or NaN.

    Numeric and boolean columns are cast; text is parsed only when it has a
    numeric shape (``try_cast`` alone would also read ``'1d'`` as 1.0);
    dates, timestamps and nested types give NULL.
    """
    c = F.col(c) if isinstance(c, str) else c
    if is_numeric_type(dtype) or isinstance(dtype, T.BooleanType):
        v = c.cast("double")
    elif isinstance(dtype, T.StringType):
        v = F.when(c.rlike(_NUMERIC_TEXT) | c.rlike(_SPECIAL_TEXT), F.trim(c).try_cast("double"))
    else:
        return F.lit(None).cast("double")
    return nan_to_null(v)


def num_col(df: DataFrame, name: str) -> Column:
    return num(F.col(name), dtype_of(df, name))


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, _EDGE_WS, "")


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """True for NULL, and for NaN in floating columns (never NULL itself)."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_blank(c: Column, dtype: T.DataType) -> Column:
    """Missing, or text that is empty after stripping whitespace."""
    if isinstance(dtype, T.StringType):
        return c.isNull() | (strip_ws(c) == F.lit(""))
    return is_missing(c, dtype)


def as_date(c: Column, dtype: T.DataType, fmt: str = DATE_FORMAT) -> Column:
    """Parse to DateType; unparseable text gives NULL."""
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, T.StringType):
        return F.try_to_date(c, fmt)
    return F.lit(None).cast("date")


def date_col(df: DataFrame, name: str, fmt: str = DATE_FORMAT) -> Column:
    return as_date(F.col(name), dtype_of(df, name), fmt)


# Internal column carrying a step's input values (plan ledger); never a target.
TAG = "__scrubline_old"


def visible_columns(df: DataFrame) -> list[str]:
    """Columns of the table proper (internal bookkeeping columns excluded)."""
    return [c for c in df.columns if not c.startswith("__scrubline")]


class BatchOnly(ValueError):
    """An operator that needs the whole table was given a streaming DataFrame."""


def require_batch(df: DataFrame, op: str) -> None:
    """Ordered dedup, fills, exact statistics and duplicate counts need the whole
    table; on a stream run them per micro-batch inside ``foreachBatch``."""
    if df.isStreaming:
        raise BatchOnly(f"{op} is batch-only: apply it inside writeStream.foreachBatch, "
                        "or use the streaming variants in scrubline.streaming")


def micros(c: Column, dt: T.DataType) -> Column:
    """Microseconds of a timestamp. A timestamp without a zone counts as if it
    were UTC, whatever the session's zone (no gaps or repeats at clock changes)."""
    if isinstance(dt, T.TimestampNTZType):
        days = F.unix_date(c.cast("date")).cast("long")
        fraction = F.extract(F.lit("SECOND"), c).cast("decimal(8,6)")
        seconds = F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60
        return days * 86_400_000_000 + seconds * 1_000_000 + (fraction * 1_000_000).cast("long")
    return F.unix_micros(c)


def ntz_of_micros(c: Column) -> Column:
    """The timestamp without a zone of :func:`micros`."""
    day = (c - F.pmod(c, F.lit(86_400_000_000))) / F.lit(86_400_000_000)
    rest = F.pmod(c, F.lit(86_400_000_000))
    whole = F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz")
    return whole + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (rest / F.lit(1_000_000)).cast("decimal(18,6)"))


def present(df: DataFrame, *names: str) -> bool:
    cols = set(df.columns)
    return all(n in cols for n in names)

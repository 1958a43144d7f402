"""Column profile.

Null counts and exact distinct counts of *all* columns come from one pass:
every cell becomes a ``(column, typed value)`` row, ``groupBy(column,
value)`` collapses repeats map-side (a value holding a third of a column is one
partial row per task), and a second ``groupBy(column)`` yields rows, nulls and
distinct values. Mixing several ``countDistinct`` in one aggregate would
instead make Spark copy every row once per column (``Expand``).

Sample values are the first non-missing values in ``order_by`` order: cells become
``(column, value)`` rows in one scan, and a row number per column, which Spark
limits to the first k in each task before the shuffle, keeps k of them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X

SAMPLE_SIZE = 5

# The profile's output schema (counts >= 0, null_pct in [0, 100]).
PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_pct", T.DoubleType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def _text(df: DataFrame, c: str):
    """Cell as text, NULL when missing (NaN included); -0.0 reads as 0.0."""
    dt = X.dtype_of(df, c)
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        col = col + F.lit(0.0)
    return F.when(~X.is_missing(F.col(c), dt), col.cast("string"))


def schema_table(df: DataFrame) -> DataFrame:
    """``(position, column, dtype)`` from the schema (one row per column)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def _scale(df: DataFrame) -> int:
    """Largest scale of the decimal columns: one slot type for all of them."""
    return max([f.dataType.scale for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)], default=0)


def _typed(df: DataFrame, c: str):
    """Cell as a struct ``(s, d, l, m)`` with exactly one slot set (NULL when
    missing): text in ``s``, floating values in ``d`` (-0.0 as 0.0), integral,
    date and timestamp values in ``l``, decimals in ``m``. Distinct cells stay
    distinct without formatting every number as text, and order as their type."""
    dt = X.dtype_of(df, c)
    col = F.col(c)
    s = d = l = m = None
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        d = col.cast("double") + F.lit(0.0)
    elif isinstance(dt, T.IntegralType):
        l = col.cast("long")
    elif isinstance(dt, T.DateType):
        l = F.unix_date(col).cast("long")
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        l = X.micros(col, dt)
    elif isinstance(dt, T.DecimalType) and dt.precision - dt.scale + _scale(df) <= 38:
        m = col
    else:
        s = col.cast("string")
    miss = X.is_missing(col, dt)
    parts = [F.when(~miss, s if s is not None else F.lit(None).cast("string")).alias("s"),
             F.when(~miss, d if d is not None else F.lit(None).cast("double")).alias("d"),
             F.when(~miss, l if l is not None else F.lit(None).cast("long")).alias("l"),
             F.when(~miss, m if m is not None else F.lit(None)).cast(f"decimal(38,{_scale(df)})").alias("m")]
    return F.struct(*parts)


def column_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """``(column, rows, null_count, unique_count)`` for every column, one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _typed(df, c).alias("v")) for c in df.columns])
    # flat key columns (not a struct) keep the aggregation on the fast hash map
    long = df.select(F.explode(cells).alias("_c")).select(
        F.col("_c.column").alias("column"), *[F.col(f"_c.v.{k}").alias(k) for k in ("s", "d", "l", "m")])
    present = F.col("s").isNotNull() | F.col("d").isNotNull() | F.col("l").isNotNull() | F.col("m").isNotNull()
    if approx:
        return long.groupBy("column").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~present).alias("null_count"),
            F.approx_count_distinct(F.xxhash64("s", "d", "l", "m")).alias("unique_count"))
    per_value = long.groupBy("column", "s", "d", "l", "m").agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy("column").agg(
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(~present, F.col("_n"))), F.lit(0)).alias("null_count"),
        F.count_if(present).alias("unique_count"))


def sample_values(df: DataFrame, order_by: Sequence[str] | str, k: int = SAMPLE_SIZE,
                  cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, sample_values array<string>)``: first ``k`` non-missing
    values of each column in ``order_by`` order."""
    order = _as_list(order_by)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in (cols or df.columns)])
    keys = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    long = df.select(*keys, F.explode(cells).alias("_x")).select("_x.column", "_x.value", *[f"_o{i}" for i in range(len(order))])
    # one scan: each task keeps the first k of each column before the shuffle
    names = [f"_o{i}" for i in range(len(order))]
    rank = F.row_number().over(Window.partitionBy("column").orderBy(*names, "value"))
    top = long.where("value IS NOT NULL").withColumn("_r", rank).where(F.col("_r") <= k)
    return top.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda s: s["value"]).alias("sample_values"))


def profile(df: DataFrame, order_by: Sequence[str] | str | None = None,
            k: int = SAMPLE_SIZE, approx: bool = False) -> DataFrame:
    """One row per column: ``position, column, dtype, null_count, null_pct,
    unique_count`` and, with ``order_by``, ``sample_values``.

    ``null_pct`` is percent of ``max(rows, 1)`` rounded to 2 places.
    """
    meta = F.broadcast(schema_table(df))  # one row per column: bounded
    counts = column_counts(df, approx)
    rows = F.coalesce(F.col("rows"), F.lit(0))
    out = meta.join(counts, "column", "left").select(
        "position", "column", "dtype",
        F.coalesce(F.col("null_count"), F.lit(0)).cast("long").alias("null_count"),
        F.round(F.coalesce(F.col("null_count"), F.lit(0)) / F.greatest(rows, F.lit(1)) * 100.0, 2).alias("null_pct"),
        F.coalesce(F.col("unique_count"), F.lit(0)).cast("long").alias("unique_count"))
    if order_by:
        out = out.join(F.broadcast(sample_values(df, order_by, k)), "column", "left")
    else:
        out = out.withColumn("sample_values", F.lit(None).cast("array<string>"))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in PROFILE_SCHEMA.fields])


def profile_violations(prof: DataFrame) -> DataFrame:
    """Profile rows breaking the documented bounds (expected empty)."""
    bad = ((F.col("null_count") < 0) | (F.col("unique_count") < 0)
           | (F.col("null_pct") < 0) | (F.col("null_pct") > 100))
    return prof.where(bad)


def schema_violations(prof: DataFrame, schema: T.StructType = PROFILE_SCHEMA) -> DataFrame:
    """``(field, problem)`` of a report against its output schema: a field that is
    ``missing``, of another ``type``, or ``unknown`` (expected empty)."""
    have = {f.name: f.dataType for f in prof.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    found = [(n, "missing" if n not in have else "type") for n, t in want.items() if n not in have or have[n] != t]
    found += [(n, "unknown") for n in have if n not in want]
    return prof.sparkSession.createDataFrame(found, "field string, problem string")


def sample_rows(df: DataFrame, order_by: Sequence[str] | str, k: int = SAMPLE_SIZE) -> DataFrame:
    """P5: first ``k`` rows in ``order_by`` order, every cell as text, missing as ``"NULL"``."""
    order = _as_list(order_by)
    top = df.orderBy(*order).limit(k)
    return top.select(*[F.coalesce(_text(df, c), F.lit("NULL")).alias(c) for c in df.columns])


def shape(df: DataFrame) -> DataFrame:
    """One row ``(rows, n_columns, columns, dtypes)``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields]).alias("dtypes"))


def full_report(df: DataFrame, suite, order_by: Sequence[str] | str, k: int = SAMPLE_SIZE) -> DataFrame:
    """One record with the suite's 12 counts, total, score and gates, the
    per-column stats (``column_stats`` array, one entry per column) and the
    first ``k`` rows as text (``sample_rows``). Both arrays are bounded by the
    schema width and ``k``."""
    from ..plans.suite import report
    rep = report(df, suite)
    prof = profile(df, order_by, k)
    stats = prof.agg(F.array_sort(F.collect_list(F.struct(*prof.columns))).alias("column_stats"))
    rows = sample_rows(df, order_by, k)
    ordered = rows.select(F.struct(*[F.col(o) for o in _as_list(order_by)]).alias("_o"),
                          F.struct(*rows.columns).alias("_r"))
    samples = ordered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_r"))),
                                      lambda x: x["_r"]).alias("sample_rows"))
    return (rep.withColumn("column_stats", stats.scalar())
            .withColumn("sample_rows", samples.scalar()))

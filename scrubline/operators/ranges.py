"""Blocks of rows that are contiguous in an order, found by histograms.

``blocks`` gives every row the number of a block of about ``rows_per_block`` rows such
that blocks follow each other in the order of a list of columns. No row travels
to find the boundaries: the rows form *cells*, at first a single one, and a cell
with more rows than a block is cut by a histogram over the next *code* of its rows.

Codes. Each column is a short list of numbers whose lexicographic order is that of the
column, NULL first: whole numbers, dates and times are one or two longs, a
floating number is its kind (-inf, finite, inf, NaN) and its value, text and binary are
seven bytes and their count a long, as many as the longest needs, a long decimal is
its digits as text. Equal codes mean equal values, so the codes of all columns in a
row order rows as the columns do.

Refinement. A heavy cell's code range is cut into equal bins, about eight times as
many as it makes blocks. One aggregate counts the bins, with the range of codes in each;
a bin's cell is named by the rank of its first row, the running sum of the counts.
Bins that are still too heavy are cut again by their own narrower range,
and by the next code once all their codes agree. Cells that agree in every code
hold equal rows; these are dealt out freely. A block is ``rank // rows_per_block``: cells
of at most a block's rows, so a block has less than twice the rows asked for.

Each round reads the ordering columns only, aggregates with map-side combine, and
joins rows with a table of heavy cells and of their bins, which is broadcast if a
count finds it small. Rounds end when no cell is heavy: one for evenly spread
keys, a few for crowded ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..session import scratch_path
from .quantile import settled

_LEAST = -(1 << 61) - 1   # code of NULL: below all others, and differences stay within 64 bits
_BYTES = 7
_MOST_BINS = 1 << 16


def orderable(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType,
                           T.BooleanType, T.BinaryType))


def _chunks(df: DataFrame, data: Column) -> Iterator[tuple[str, Column]]:
    """Binary data by seven bytes: their value and how many there are."""
    longest = df.agg(F.max(F.length(data))).first()[0] or 0
    for at in range(0, longest + 1, _BYTES):
        part = F.substring(data, at + 1, _BYTES)
        value = F.conv(F.rpad(F.hex(part), 2 * _BYTES, "0"), 16, 10).cast("long") * (_BYTES + 1) + F.length(part)
        yield "long", F.coalesce(value, F.lit(-1).cast("long"))


def codes(df: DataFrame, name: str) -> Iterator[tuple[str, Column]]:
    """(kind, code) of a column: ``long`` or ``double``, in order of weight."""
    c, dt = F.col(name), X.dtype_of(df, name)
    least = F.lit(_LEAST).cast("long")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        v = c.cast("double")
        inf = F.lit(float("inf"))
        yield "long", F.when(c.isNull(), 0).when(F.isnan(v), 4).when(v == inf, 3).when(v == -inf, 1).otherwise(2).cast("long")
        yield "double", F.when(F.isnan(v) | (F.abs(v) == inf), 0.0).otherwise(F.coalesce(v, F.lit(0.0))) + F.lit(0.0)
    elif isinstance(dt, T.LongType):
        yield "long", F.coalesce(F.shiftright(c, 2), least)
        yield "long", F.coalesce(c.bitwiseAND(F.lit(3)), F.lit(0)).cast("long")
    elif isinstance(dt, T.IntegralType):
        yield "long", F.coalesce(c.cast("long"), least)
    elif isinstance(dt, T.BooleanType):
        yield "long", F.coalesce(c.cast("int").cast("long"), least)
    elif isinstance(dt, T.DateType):
        yield "long", F.coalesce(F.unix_date(c).cast("long"), least)
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        yield "long", F.coalesce(X.micros(c, dt), least)
    elif isinstance(dt, T.DecimalType) and dt.precision <= 18:
        unscaled = (c * F.lit(10 ** dt.scale).cast(T.DecimalType(19, 0))).cast("long")
        yield "long", F.coalesce(unscaled, least)
    elif isinstance(dt, T.DecimalType):
        picture = "0" * (dt.precision - dt.scale) + ("." + "0" * dt.scale if dt.scale else "")
        digits = F.regexp_replace(F.to_char(c, F.lit("MI" + picture)), "[- ]", "")
        turned = F.translate(digits, "0123456789", "9876543210")
        yield from _chunks(df, F.when(c < 0, F.concat(F.lit("0"), turned)).otherwise(F.concat(F.lit("1"), digits)).cast("binary"))
    else:
        yield from _chunks(df, c.cast("binary"))


def _bin(kind: str) -> Column:
    """Bin of ``_code`` within ``_lo`` .. ``_hi`` (``_lo`` < ``_hi``) out of ``_bins``, never
    falling as the code grows, and two bins at least."""
    if kind == "long":
        return F.expr("(_code - _lo) div ((_hi - _lo) div _bins + 1)")
    # halves, as the span of two doubles may be infinite
    span = F.expr("_hi / 2 - _lo / 2")
    even = F.floor(F.least((F.col("_code") / 2 - F.col("_lo") / 2) / span, F.lit(1.0)) * F.col("_bins"))
    middle = F.col("_lo") / 2 + F.col("_hi") / 2
    halves = F.when(F.col("_code") > F.when(middle < F.col("_hi"), middle).otherwise(F.col("_lo")), 1).otherwise(0)
    # doubles next to each other: their span may vanish in a half
    return F.when(span > 1e-290, even).otherwise(halves).cast("long")


def _cut(rows: DataFrame, cells: DataFrame, kind: str) -> DataFrame:
    """``rows`` with ``_bin`` (NULL outside ``cells``)."""
    joined = rows.join(cells.withColumnRenamed("_cell", "_of"), F.col("_cell") == F.col("_of"), "left")
    return joined.withColumn("_bin", F.when(F.col("_of").isNotNull(), _bin(kind))).drop("_of", "_lo", "_hi", "_bins")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(df: DataFrame, order: Sequence[str], rows_per_block: int, rows: int | None = None) -> DataFrame:
    """``df`` with ``_blk`` (long), by the columns of ``order`` and, where these
    agree, by the other columns that have an order. ``rows``: the table's size if it is known."""
    order = [order] if isinstance(order, str) else list(order)
    total = df.count() if rows is None else rows
    if total <= rows_per_block:
        return df.withColumn("_blk", F.lit(0).cast("long"))
    names = order + [f.name for f in df.schema.fields if f.name not in order and orderable(f.dataType)]
    placed = df.withColumn("_cell", F.lit(0).cast("long"))
    heavy = df.sparkSession.createDataFrame([(0, total)], "_cell long, _n long")
    for kind, code in (c for name in names for c in codes(df, name)):
        coded = placed.withColumn("_code", code)
        spans = (coded.join(F.broadcast(heavy.select("_cell")) if heavy.count() <= _MOST_BINS else heavy.select("_cell"), "_cell")
                 .groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi")))
        heavy = _kept(spans, "block-cells")
        while not (split := heavy.where("_lo < _hi")).isEmpty():
            wanted = F.ceil(F.col("_n") * F.lit(8.0) / F.lit(float(rows_per_block)))
            cells = settled(split.select("_cell", "_lo", "_hi", F.least(F.greatest(wanted, F.lit(16)), F.lit(_MOST_BINS)).cast("long").alias("_bins")))
            cut = _cut(placed.withColumn("_code", code), cells, kind)
            counts = cut.where("_bin IS NOT NULL").groupBy("_cell", "_bin").agg(
                F.count(F.lit(1)).alias("_n"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi"))
            before = Window.partitionBy("_cell").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
            ranked = _kept(counts.withColumn("_rank", F.col("_cell") + F.coalesce(F.sum("_n").over(before), F.lit(0))), "block-bins")
            places = settled(ranked.select(F.col("_cell").alias("_of"), F.col("_bin").alias("_at"), "_rank"))
            moved = cut.join(places, (F.col("_cell") == F.col("_of")) & (F.col("_bin") == F.col("_at")), "left")
            placed = moved.withColumn("_cell", F.coalesce("_rank", "_cell")).select(*df.columns, "_cell")
            still = ranked.where(F.col("_n") > rows_per_block).select(F.col("_rank").alias("_cell"), "_n", "_lo", "_hi")
            heavy = _kept(heavy.where("_lo = _hi").unionByName(still), "block-cells")
        if heavy.isEmpty():
            break
    # what is still heavy agrees in every code: equal rows, dealt out over their blocks
    parts = settled(heavy.select(F.col("_cell").alias("_of"), F.ceil(F.col("_n") / F.lit(float(rows_per_block))).alias("_parts")))
    dealt = placed.join(parts, F.col("_cell") == F.col("_of"), "left")
    piece = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.lit(0))
    at = F.col("_cell") + piece * F.lit(rows_per_block)
    return _kept(dealt.withColumn("_at", at).withColumn("_blk", F.expr(f"_at div {int(rows_per_block)}")).select(*df.columns, "_blk"), "blocks")

"""Quarantine split (R16): flag every row with the names of the rules it fails.

One projection: ``array_compact(array(when(p1, 'r1'), when(p2, 'r2'), ...))``.
A full-row duplicate rule flags all copies of a row but one. Copies are equal, so
the rows are counted (combined in each task) and written out as often as
counted; which copy stays makes no difference, and no window holds a hot group.

Hot groups. A counted row with more than ``PIECE`` copies is written out in two levels:
it is first cut into pieces of at most that many, the pieces are dealt out over all
tasks, and each writes its own copies. So neither an array nor a task grows with the group.

Zeros. Grouping takes -0.0 and 0.0 for one value, and so does the rule. Where a column
holds -0.0, rows are counted by the signs of their zeros too, and come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..plans.suite import Suite

FLAGS = "failed_rules"
#: Copies of one row that a task writes out together.
PIECE = 10_000
_N, _COPY, _SIGNS, _FROM, _MORE = (f"__scrubline_{k}" for k in ("n", "copy", "signs", "from", "more"))


def _negative_zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string") == "-0.0", F.lit(False))


def _counted(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of their copies and whether another row equal to it
    comes before it (as rows that differ in the sign of a zero are equal)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    n = F.count(F.lit(1)).alias(_N)
    held = df.agg(*[F.coalesce(F.bool_or(_negative_zero(c)), F.lit(False)).alias(f"_{k}") for k, c in enumerate(floats)]).first() if floats else ()
    signed = [c for c, found in zip(floats, held) if found]
    if not signed:
        return df.groupBy(*df.columns).agg(n).withColumn(_MORE, F.lit(False))
    signs = F.concat(*[F.when(_negative_zero(c), "1").otherwise("0") for c in signed])
    rows = df.withColumn(_SIGNS, signs).groupBy(*df.columns, _SIGNS).agg(n)
    first = Window.partitionBy(*df.columns).orderBy(_SIGNS)  # at most one row for each way to sign the zeros
    rows = rows.withColumn(_MORE, F.row_number().over(first) > 1)
    back = {c: F.when(F.substring(_SIGNS, k + 1, 1) == "1", F.lit(-0.0).cast(X.dtype_of(df, c))).otherwise(F.col(c)) for k, c in enumerate(signed)}
    return rows.withColumns(back).drop(_SIGNS)


def _copies(df: DataFrame, piece: int = PIECE) -> DataFrame:
    """``df`` with ``__scrubline_copy``: 1 for one copy of each row, more for the others."""
    rows = _counted(df)
    cut = rows.withColumn(_FROM, F.explode(F.sequence(F.lit(0).cast("long"), (F.col(_N) - 1).cast("long"), F.lit(piece).cast("long"))))
    few, many = cut.where(F.col(_N) <= piece), cut.where(F.col(_N) > piece)
    dealt = few.unionByName(many.repartition(_FROM, F.xxhash64(*df.columns)))
    until = F.least(F.col(_FROM) + piece, F.col(_N))
    copy = F.explode(F.sequence(F.col(_FROM) + 1, until))
    return dealt.select(*df.columns, _MORE, copy.alias(_COPY)).withColumn(_COPY, F.col(_COPY) + F.col(_MORE).cast("long")).drop(_MORE)


def flag(df: DataFrame, suite: Suite, piece: int = PIECE) -> DataFrame:
    """Add ``failed_rules array<string>`` (empty for clean rows), rules in the
    suite's order. A duplicate rule over a subset of columns raises ValueError:
    which of its rows is the first needs an order (use ``dedup`` for that)."""
    dups = [w.rule for w in suite.rules if w.rule.kind == "duplicates"]
    if any(r.subset for r in dups):
        raise ValueError("quarantine: duplicates over a subset of columns have no first row without an order")
    rows = df
    if any(r.applicable(df) for r in dups):
        X.require_batch(df, "quarantine of duplicate rows")
        rows = _copies(df, piece)
    names = F.array(*[
        F.when(F.col(_COPY) > 1 if w.rule.kind == "duplicates" else w.rule.predicate(df), F.lit(w.rule.name))
        for w in suite.rules if w.rule.kind != "duplicates" or w.rule.applicable(df)]) if suite.rules else F.array()
    return rows.withColumn(FLAGS, F.array_compact(names)).select(*df.columns, FLAGS)


def quarantine(df: DataFrame, suite: Suite) -> DataFrame:
    """Rows failing at least one row rule, with their ``failed_rules``."""
    return flag(df, suite).where(F.size(F.col(FLAGS)) > 0)


def split(df: DataFrame, suite: Suite) -> tuple[DataFrame, DataFrame]:
    """``(clean rows, quarantined rows with failed_rules)`` from one flagged plan."""
    flagged = flag(df, suite)
    good = flagged.where(F.size(F.col(FLAGS)) == 0).drop(FLAGS)
    bad = flagged.where(F.size(F.col(FLAGS)) > 0)
    return good, bad

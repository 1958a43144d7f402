"""Defect rules (R1-R13, R5) as schema-aware Column builders.

A rule knows the columns it needs. Given a DataFrame it yields

* ``predicate(df)`` - a boolean row Column (quarantine, filters, streams), and
* ``count(df)``     - an aggregate Column, so that all scalar rules of a suite
  are counted together in one ``agg``.

When a required column is absent the rule is *not applicable*: its count is 0
and its predicate is false (a dropped column passes, as in the reference).
Duplicate rows (R5) are a row-set rule: they need a ``groupBy`` and are counted
by :func:`duplicate_count`, never inside the scalar aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exprs as X

@dataclass(frozen=True)
class Rule:
    """One defect rule.

    ``kind`` is ``"row"`` (one predicate per row), ``"cells"`` (one predicate
    per listed column, counts summed over cells) or ``"duplicates"``.
    """

    name: str
    columns: tuple[str, ...]
    kind: str = "row"
    build: Callable[..., Column] | None = field(default=None, compare=False)
    subset: tuple[str, ...] | None = None

    def applicable(self, df: DataFrame) -> bool:
        if self.kind == "cells":
            return not self.columns or any(c in df.columns for c in self.columns)
        if self.kind == "duplicates":
            return self.subset is None or X.present(df, *self.subset)
        return X.present(df, *self.columns)

    def cell_predicates(self, df: DataFrame) -> list[Column]:
        if self.kind != "cells":
            raise TypeError(f"rule {self.name} is not a cell rule")
        cols = [c for c in self.columns if c in df.columns] if self.columns else X.visible_columns(df)
        return [self.build(df, c) for c in cols]

    def predicate(self, df: DataFrame) -> Column:
        """Row predicate: true where the row has this defect."""
        if self.kind == "duplicates":
            raise TypeError("duplicate rows are a row-set rule; use duplicate_count/dedup")
        if not self.applicable(df):
            return F.lit(False)
        if self.kind == "cells":
            preds = self.cell_predicates(df)
            out = preds[0]
            for p in preds[1:]:
                out = out | p
            return out
        return F.coalesce(self.build(df), F.lit(False))

    def predicates(self, df: DataFrame) -> list[Column]:
        """The row predicates whose true-counts add up to this rule's count
        (one per row rule, one per column for a cell rule, none if n/a)."""
        if self.kind == "duplicates":
            raise TypeError("duplicate rows are counted by duplicate_count()")
        if not self.applicable(df):
            return []
        if self.kind == "cells":
            return [F.coalesce(p, F.lit(False)) for p in self.cell_predicates(df)]
        return [self.predicate(df)]

    def count(self, df: DataFrame) -> Column:
        """Aggregate Column counting the defect (LongType)."""
        if self.kind == "duplicates":
            raise TypeError("duplicate rows are counted by duplicate_count()")
        if not self.applicable(df):
            return F.lit(0).cast("long")
        if self.kind == "cells":
            counts = [F.count_if(F.coalesce(p, F.lit(False))) for p in self.cell_predicates(df)]
            out = counts[0]
            for c in counts[1:]:
                out = out + c
            return out.cast("long")
        return F.count_if(self.predicate(df)).cast("long")

    def cells_per_row(self) -> int:
        return max(len(self.columns), 1) if self.kind == "cells" else 1


# ---------------------------------------------------------------- R1 .. R13

def null_values(col: str, name: str | None = None) -> Rule:
    """NULL after numeric coercion (unparseable text counts as NULL)."""
    return Rule(name or f"{col}_null", (col,), build=lambda df: X.num_col(df, col).isNull())


def missing_cells(cols: Sequence[str] = (), name: str = "missing_count") -> Rule:
    """R2: NULL/NaN cells over the given columns (all columns when empty)."""
    return Rule(name, tuple(cols), kind="cells",
                build=lambda df, c: X.is_missing(F.col(c), X.dtype_of(df, c)))


def equals_value(col: str, value: float = X.SENTINEL, name: str | None = None) -> Rule:
    """Numeric-coerced value equal to a sentinel."""
    return Rule(name or f"{col}_sentinel", (col,), build=lambda df: X.num_col(df, col) == F.lit(float(value)))


def at_most(col: str, bound: float = 0.0, name: str | None = None) -> Rule:
    """Numeric-coerced value <= bound (non-positive for bound 0)."""
    return Rule(name or f"{col}_at_most", (col,), build=lambda df: X.num_col(df, col) <= F.lit(float(bound)))


def below(col: str, bound: float = 0.0, name: str | None = None) -> Rule:
    """Numeric-coerced value < bound (negative for bound 0)."""
    return Rule(name or f"{col}_below", (col,), build=lambda df: X.num_col(df, col) < F.lit(float(bound)))


def out_of_range(col: str, lo: float | None = X.AGE_MIN, hi: float | None = X.AGE_MAX,
                 name: str | None = None) -> Rule:
    """Numeric value < lo or > hi; NULL, NaN and unparseable never count."""
    def build(df: DataFrame) -> Column:
        v = X.num_col(df, col)
        parts = []
        if lo is not None:
            parts.append(v < F.lit(float(lo)))
        if hi is not None:
            parts.append(v > F.lit(float(hi)))
        if not parts:
            return F.lit(False)
        return parts[0] if len(parts) == 1 else parts[0] | parts[1]
    return Rule(name or f"{col}_range", (col,), build=build)


def not_matching(col: str, pattern: str, nulls_are_errors: bool, name: str | None = None) -> Rule:
    """Text not matching a regex. R6 skips NULL, R11 counts NULL."""
    def build(df: DataFrame) -> Column:
        c = F.col(col).cast("string")
        if nulls_are_errors:
            return ~F.coalesce(c, F.lit("")).rlike(pattern)
        return c.isNotNull() & ~c.rlike(pattern)
    return Rule(name or f"{col}_format", (col,), build=build)


def phone_not_e164(col: str = "phone", name: str = "phone_format_errors") -> Rule:
    """Phone not in US E.164 form; NULL skipped."""
    return not_matching(col, X.E164_US, nulls_are_errors=False, name=name)


def code_format(col: str = "icd10_code", pattern: str = X.ICD10_STRICT,
                name: str = "icd10_format_errors") -> Rule:
    """Code not matching the pattern; NULL counts as an error."""
    return not_matching(col, pattern, nulls_are_errors=True, name=name)


def not_lower(col: str = "email", name: str = "email_case_errors") -> Rule:
    """Text differing from its lower-case form; NULL skipped."""
    return Rule(name, (col,), build=lambda df: F.col(col).cast("string") != F.lower(F.col(col).cast("string")))


def date_after(first: str, second: str, name: str | None = None, fmt: str = X.DATE_FORMAT) -> Rule:
    """Both parse as dates and ``first > second``.

    Date order (dob after admission) is ``date_after("dob", "admission_date")``;
    the cross-column check (discharge before admission) is
    ``date_after("admission_date", "discharge_date")``.
    """
    return Rule(name or f"{first}_after_{second}", (first, second),
                build=lambda df: X.date_col(df, first, fmt) > X.date_col(df, second, fmt))


def blank_cells(cols: Sequence[str], name: str = "blank_mandatory_count") -> Rule:
    """NULL or whitespace-only cells, summed over the listed columns."""
    return Rule(name, tuple(cols), kind="cells",
                build=lambda df, c: X.is_blank(F.col(c), X.dtype_of(df, c)))


def custom(name: str, predicate: Column | Callable[[DataFrame], Column], columns: Sequence[str] = ()) -> Rule:
    """Q8: a user rule from a boolean Column (or a function of the DataFrame
    returning one); NULL counts as a pass. ``columns`` it needs make it not
    applicable (count 0) when absent."""
    build = predicate if callable(predicate) and not isinstance(predicate, Column) else (lambda df: predicate)
    return Rule(name, tuple(columns), build=build)


def duplicates(subset: Sequence[str] | None = None, name: str = "duplicate_count") -> Rule:
    """Rows repeating an earlier row (on ``subset``, default all columns)."""
    return Rule(name, tuple(subset or ()), kind="duplicates", subset=tuple(subset) if subset else None)


# ------------------------------------------------------------------ R5 count

def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One-row DataFrame ``(duplicate_count)``: all occurrences after the first.

    ``groupBy(keys).count()`` is combined map-side, so a key holding a third of
    all rows leaves each map task as one partial row; NULL keys group together.
    """
    X.require_batch(df, "duplicate_count")
    keys = list(subset) if subset else X.visible_columns(df)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_count"))

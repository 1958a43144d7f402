"""Cleaning plans and their ledger.

A plan is a list of steps ``{operation, target_columns, params}``. Steps are
checked against the table's schema before anything runs (G2) and folded into
one lazy DataFrame (G1), so row-local steps collapse into a single projection.

The ledger (G3, G4) scores the table after every step. Steps run in segments: a
step that needs statistics or a shuffle begins one, the row-local steps behind it
belong to it. A segment is written once to the scratch folder, and while it is written each
of its steps is *observed*: rows, the suite's rule counts, and ``affected``, the cells
that the step changed, counted null-safely against its input values, which ride along to
that point only and are not written. Observed aggregates of a segment lie behind its last
shuffle, in the writing tasks. A copy is removed as soon as the next one is written.
Only a rule over whole rows (duplicates) takes an aggregate of its own. ``defects_before`` is
the row before (W4). With ``checkpoint=False`` nothing is written: each
ledger row is an aggregate over its step's plan.

:func:`append_ledger` adds a ledger to a table that outlives runs, each step of a run once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..functions import rules as R
from ..operators import clean as C
from ..operators import dedup as D
from ..operators import stats as S
from ..session import exists, remove, scratch_path
from . import suite as Q

# The step names of a cleaning plan.
OPERATIONS = (
    "impute_missing", "replace_sentinel", "deduplicate", "standardize_phone",
    "lowercase_email", "clamp_range", "fix_date_order", "fix_icd10",
    "fix_negative_dosage", "fill_mandatory", "drop_column", "validate", "export",
)

# Parameters each step understands (anything else is rejected up front).
_PARAMS = {
    "impute_missing": {"strategy", "value", "order_by", "by", "method"},
    "replace_sentinel": {"sentinel", "strategy", "value", "valid_min", "by", "method"},
    "deduplicate": {"keep", "order_by"},
    "standardize_phone": set(),
    "lowercase_email": set(),
    "clamp_range": {"min_val", "max_val"},
    "fix_date_order": {"mode", "start", "end", "format"},
    "fix_icd10": set(),
    "fix_negative_dosage": set(),
    "fill_mandatory": {"value"},
    "drop_column": {"protected"},
    "validate": set(),
    "export": set(),
}


class PlanError(ValueError):
    """A step that cannot run against this table's schema."""


@dataclass(frozen=True)
class Step:
    operation: str
    target_columns: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)


def _coerce_columns(v) -> tuple[str, ...]:
    if v is None:
        return ()
    if isinstance(v, str):
        return (v,)
    if isinstance(v, (list, tuple)) and all(isinstance(c, str) for c in v):
        return tuple(v)
    raise PlanError(f"target_columns must be None, a string or a list of strings, not {v!r}")


def parse_step(raw: Step | Mapping[str, Any]) -> Step:
    """Validate one step's shape (not yet its columns)."""
    if isinstance(raw, Step):
        op, cols, params = raw.operation, raw.target_columns, raw.params
    elif isinstance(raw, Mapping):
        if "operation" not in raw:
            raise PlanError(f"step without operation: {raw!r}")
        op, cols, params = raw["operation"], raw.get("target_columns"), raw.get("params") or {}
    else:
        raise PlanError(f"step must be a mapping or Step, not {type(raw).__name__}")
    if op not in OPERATIONS:
        raise PlanError(f"unknown operation {op!r}; known: {', '.join(OPERATIONS)}")
    if not isinstance(params, Mapping):
        raise PlanError(f"params must be a mapping, not {params!r}")
    unknown = set(params) - _PARAMS[op]
    if unknown:
        raise PlanError(f"{op}: unknown params {sorted(unknown)}")
    return Step(op, _coerce_columns(cols), dict(params))


def check_step(columns: Sequence[str], step: Step) -> None:
    """Schema checks that would otherwise fail mid-job; ``columns`` are those
    of the table that the step gets."""
    if step.operation == "deduplicate":
        missing = [c for c in step.target_columns if c not in columns]
        if missing:
            raise PlanError(f"deduplicate: unknown subset columns {missing}")
        if step.target_columns and step.params.get("keep", "first") in ("first", "last") \
                and not step.params.get("order_by"):
            raise PlanError("deduplicate: keep first/last on a subset needs params.order_by")
    if step.operation == "impute_missing" and step.params.get("strategy") in ("forward_fill", "backward_fill") \
            and not step.params.get("order_by"):
        raise PlanError("impute_missing: forward/backward fill needs params.order_by")


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    """Run one step as a DataFrame transform (``validate``/``export`` are no-ops here)."""
    op, cols, p = step.operation, list(step.target_columns), step.params
    if op == "impute_missing":
        return S.impute_missing(df, cols, p.get("strategy", "median"), p.get("value"),
                                p.get("order_by"), p.get("by"), p.get("method", "exact"))
    if op == "replace_sentinel":
        vmin = p.get("valid_min")
        valid = (lambda v: v > F.lit(float(vmin))) if vmin is not None else None
        return S.replace_sentinel(df, cols, p.get("sentinel", X.SENTINEL), p.get("strategy", "median"),
                                  p.get("value"), valid, p.get("by"), p.get("method", "exact"))
    if op == "deduplicate":
        return D.deduplicate(df, cols or None, p.get("keep", "first"), p.get("order_by"))
    if op == "standardize_phone":
        return C.standardize_phone(df, cols)
    if op == "lowercase_email":
        return C.lowercase(df, cols)
    if op == "clamp_range":
        return C.clamp_range(df, cols, p.get("min_val"), p.get("max_val"))
    if op == "fix_date_order":
        return C.fix_date_order(df, p.get("start", "dob"), p.get("end", "admission_date"),
                                p.get("mode", "swap"), p.get("format", X.DATE_FORMAT))
    if op == "fix_icd10":
        return C.fix_code_format(df, cols)
    if op == "fix_negative_dosage":
        return C.abs_negative(df, cols)
    if op == "fill_mandatory":
        return C.fill_blank(df, cols, p.get("value", X.BLANK_FILL))
    if op == "drop_column":
        return C.drop_columns(df, cols, p.get("protected", ()))
    return df  # validate, export


def columns_after(columns: Sequence[str], step: Step) -> list[str]:
    """Columns of the table after a step, by the step alone."""
    if step.operation != "drop_column":
        return list(columns)
    gone = set(step.target_columns) - set(step.params.get("protected", ()))
    return [c for c in columns if c not in gone]


_FUSABLE = ("impute_missing", "replace_sentinel")


def fuse_steps(steps: Sequence[Step]) -> list[Step]:
    """Merge consecutive statistic steps with equal parameters on disjoint,
    explicitly named columns into one step, so their statistics come from one
    stacked aggregate. Steps on the same column stay apart: order matters
    there (imputing first puts sentinels into the median)."""
    out: list[Step] = []
    for st in steps:
        prev = out[-1] if out else None
        if (prev is not None and st.operation in _FUSABLE and prev.operation == st.operation
                and prev.target_columns and st.target_columns and dict(prev.params) == dict(st.params)
                and not set(prev.target_columns) & set(st.target_columns)
                and st.params.get("strategy", "median") in ("median", "mean")):
            out[-1] = Step(st.operation, prev.target_columns + st.target_columns, prev.params)
        else:
            out.append(st)
    return out


def apply_plan(df: DataFrame, steps: Sequence[Step | Mapping[str, Any]]) -> DataFrame:
    """G1: fold all steps into one lazy DataFrame (checked before running);
    statistic steps on disjoint columns share one aggregate (``fuse_steps``)."""
    parsed = [parse_step(s) for s in steps]
    columns = list(df.columns)
    for step in parsed:  # every step is checked before the first one is built
        check_step(columns, step)
        columns = columns_after(columns, step)
    return reduce(apply_step, fuse_steps(parsed), df)


def _ledger_row(frame: DataFrame, suite: Q.Suite, idx: int, op: str, cols: str,
                error: str | None, extra=(), kind: str = "cells") -> DataFrame:
    scored = Q.score(frame, suite, extra=extra)
    affected = F.col("affected") if extra else F.lit(0).cast("long")
    return scored.select(
        F.lit(idx).alias("step"), F.lit(op).alias("operation"), F.lit(cols).alias("target_columns"),
        F.col("rows"), F.col("total_defects").alias("defects_after"), F.col("score"),
        F.col("passed"), F.lit(error).cast("string").alias("error"),
        affected.cast("long").alias("affected"), F.lit(kind).alias("_affected_kind"))


# Steps whose output costs shuffles to recompute (statistics, dedup).
_HEAVY = ("impute_missing", "replace_sentinel", "deduplicate")


def _extra_targets(step: Step) -> tuple[str, ...]:
    """Columns that a step changes without naming them as targets."""
    if step.operation == "fix_date_order":
        return (step.params.get("start", "dob"), step.params.get("end", "admission_date"))
    return ()


def _same(new: DataFrame, old: DataFrame, c: str) -> Column:
    """Whether a cell kept its value (NULL equals NULL): by value if both types
    are numbers, by text if the types differ otherwise."""
    before, after = X.dtype_of(old, c), X.dtype_of(new, c)
    was = F.col(X.TAG)[c]
    if before == after or isinstance(before, T.NumericType) and isinstance(after, T.NumericType):
        return F.col(c).eqNullSafe(was)
    return F.col(c).cast("string").eqNullSafe(was.cast("string"))


class _Segment:
    """Steps that are written together, and what is observed of them."""

    def __init__(self, df: DataFrame, suite: Q.Suite):
        self.suite, self.copy = suite, None
        self.plain = self.seen = df      # the table so far, without and with observations
        self.waiting: list = []          # (ledger row, observation)

    def watch(self, entry: dict, frame: DataFrame, affected: Column | None) -> DataFrame:
        """``frame`` observed as the output of the step of ``entry``."""
        obs = Observation(f"scrubline_step_{entry['step']}_{uuid.uuid4().hex[:8]}")
        rules = [w.rule for w in self.suite.rules if w.rule.kind != "duplicates"]
        counts = [F.count(F.lit(1)).alias("rows"), *[r.count(frame).alias(r.name) for r in rules]]
        self.waiting.append((entry, obs))
        return frame.observe(obs, *counts, *([affected.cast("long").alias("affected")] if affected is not None else []))

    def whole_rows(self, entry: dict, frame: DataFrame) -> None:
        """Counts of the rules over whole rows, by an aggregate."""
        for w in self.suite.rules:
            if w.rule.kind == "duplicates":
                entry["counts"][w.rule.name] = R.duplicate_count(frame, w.rule.subset).first()[0] if w.rule.applicable(frame) else 0

    def written(self) -> None:
        """Write the segment if it has steps; later ones start from the copy."""
        if not self.waiting:
            return
        spark, schema = self.seen.sparkSession, self.plain.schema
        path = scratch_path(spark, "ledger")
        self.seen.write.parquet(path)
        for entry, obs in self.waiting:
            got = dict(obs.get)
            entry["affected"] = got.pop("affected", entry["affected"])
            entry["counts"].update(got)
        if self.copy is not None:
            remove(spark, self.copy)
        self.copy, self.waiting = path, []
        self.plain = self.seen = spark.read.schema(schema).parquet(path)


def _entry(step: int, operation: str, cols: str, columns, error: str | None = None) -> dict:
    return {"step": step, "operation": operation, "target_columns": cols, "error": error, "affected": 0, "counts": {}, "columns": list(columns)}


def _scored(spark, entries: list[dict], suite: Q.Suite) -> DataFrame:
    """The ledger from its entries, a row a step."""
    names = [w.rule.name for w in suite.rules]
    rows = []
    for e in entries:
        counts = {n: int(e["counts"].get(n) or 0) for n in ("rows", *names)}
        e["rows"], e["defects_after"] = counts["rows"], sum(counts[n] for n in names)
        one = spark.createDataFrame([counts], ", ".join(f"`{n}` long" for n in ("rows", *names)))
        rows.append(Q.score_counts(one, suite, e["columns"]).select(
            F.lit(e["step"]).alias("step"), F.lit(e["operation"]).alias("operation"), F.lit(e["target_columns"]).alias("target_columns"), "rows",
            F.lit(e["defects_after"]).cast("long").alias("defects_after"), "score", "passed", F.lit(e["error"]).cast("string").alias("error"),
            F.lit(int(e["affected"])).cast("long").alias("affected")))
    return _finished(reduce(DataFrame.unionByName, rows))


def _finished(led: DataFrame) -> DataFrame:
    w = Window.orderBy("step")  # the ledger has one row per step: a tiny table
    led = (led.withColumn("defects_before", F.lag("defects_after").over(w))
           .withColumn("reduction_pct", Q.reduction_pct(F.first("defects_after").over(
               w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("defects_after"))))
    return led.select("step", "operation", "target_columns", "rows", "defects_before", "defects_after",
                      "score", "passed", "reduction_pct", "affected", "error")


def _watched(state: DataFrame, step: Step) -> list[str]:
    """Columns that a step may change; none of steps that do not change cells."""
    if step.operation in ("deduplicate", "drop_column", "validate", "export"):
        return []
    return [c for c in X.visible_columns(state) if not step.target_columns or c in (*step.target_columns, *_extra_targets(step))]


def _with_old(state: DataFrame, watched: Sequence[str]) -> DataFrame:
    return state.withColumn(X.TAG, F.struct(*[F.col(c) for c in watched])) if watched else state


def _changed(new: DataFrame, old: DataFrame, watched: Sequence[str]) -> Column | None:
    counts = [F.count_if(~_same(new, old, c)) for c in watched if c in new.columns]
    return reduce(lambda a, b: a + b, counts) if counts else None


def ledger(df: DataFrame, steps: Sequence[Step | Mapping[str, Any]], suite: Q.Suite,
           checkpoint: bool | str = "auto") -> tuple[DataFrame, DataFrame]:
    """``(cleaned table, ledger)``.

    Ledger columns: ``step, operation, target_columns, rows, defects_before,
    defects_after, score, passed, reduction_pct, affected, error``. ``affected``
    is the number of cells a step changed (rows removed for ``deduplicate``,
    columns removed for ``drop_column``). A step that fails its checks is
    recorded with ``error`` and leaves the table unchanged. ``checkpoint``: a segment
    for each heavy step ("auto"), for each step (True), or no copies (False). The
    cleaned table reads the last copy; take both within ``session.leased`` to have it
    removed once they are written elsewhere.
    """
    if checkpoint is False:
        return _ledger_of_plans(df, steps, suite)
    first = _entry(0, "initial", "", df.columns)
    first["counts"] = Q.rule_counts(df, suite).first().asDict()
    entries, seg = [first], _Segment(df, suite)
    for i, raw in enumerate(steps, start=1):
        before = entries[-1]
        try:
            step = parse_step(raw)
            check_step(seg.plain.columns, step)
        except PlanError as exc:
            op = raw.get("operation", "?") if isinstance(raw, Mapping) else getattr(raw, "operation", "?")
            entries.append(_unchanged(before, i, str(op), "", str(exc), seg))
            continue
        cols = ",".join(step.target_columns)
        if step.operation in _HEAVY or checkpoint is True:
            seg.written()  # statistics must not run the observations of steps before
        old, watched = seg.plain, _watched(seg.plain, step)
        try:
            new = apply_step(_with_old(seg.seen, watched), step)  # with its plan-time type checks (e.g. clamp on text)
            plain = new.drop(X.TAG) if seg.seen is old else apply_step(old, step)
        except (TypeError, ValueError, KeyError) as exc:
            entries.append(_unchanged(before, i, step.operation, cols, f"{type(exc).__name__}: {exc}", seg))
            continue
        entry = _entry(i, step.operation, cols, plain.columns)
        if step.operation == "drop_column":
            entry["affected"] = len([c for c in step.target_columns if c in old.columns])
        seg.seen = seg.watch(entry, new, _changed(new, old, watched)).drop(X.TAG)
        seg.plain = plain
        seg.whole_rows(entry, plain)
        entries.append(entry)
    seg.written()
    for k, e in enumerate(entries):
        if e.get("same"):
            e["counts"] = entries[k - 1]["counts"]
        elif e["operation"] == "deduplicate":
            e["affected"] = entries[k - 1]["counts"]["rows"] - e["counts"]["rows"]
    return seg.plain, _scored(df.sparkSession, entries, suite)


def _unchanged(before: dict, step: int, operation: str, cols: str, error: str, seg: _Segment) -> dict:
    """The row of a step that did not run: the counts of the step before."""
    return _entry(step, operation, cols, seg.plain.columns, error) | {"same": True}


def _ledger_of_plans(df: DataFrame, steps, suite: Q.Suite) -> tuple[DataFrame, DataFrame]:
    """The ledger without copies: each row aggregates its step's own plan."""
    rows, state = [_ledger_row(df, suite, 0, "initial", "", None)], df
    for i, raw in enumerate(steps, start=1):
        try:
            step = parse_step(raw)
            check_step(state.columns, step)
        except PlanError as exc:
            op = raw.get("operation", "?") if isinstance(raw, Mapping) else getattr(raw, "operation", "?")
            rows.append(_ledger_row(state, suite, i, str(op), "", str(exc)))
            continue
        cols, watched = ",".join(step.target_columns), _watched(state, step)
        try:
            new = apply_step(_with_old(state, watched), step)
        except (TypeError, ValueError, KeyError) as exc:
            rows.append(_ledger_row(state, suite, i, step.operation, cols, f"{type(exc).__name__}: {exc}"))
            continue
        if step.operation == "deduplicate":
            rows.append(_ledger_row(new, suite, i, step.operation, cols, None, kind="rows_removed"))
        else:
            n = len([c for c in step.target_columns if c in state.columns]) if step.operation == "drop_column" else 0
            changed = _changed(new, state, watched)
            extra = (changed if changed is not None else F.lit(n)).cast("long").alias("affected")
            rows.append(_ledger_row(new, suite, i, step.operation, cols, None, extra=[extra]))
        state = new.drop(X.TAG)
    led = reduce(DataFrame.unionByName, rows)
    w = Window.orderBy("step")
    led = led.withColumn("affected", F.when(F.col("_affected_kind") == "rows_removed",
                                            F.lag("rows").over(w) - F.col("rows")).otherwise(F.col("affected")))
    return state, _finished(led)


def append_ledger(led: DataFrame, path: str, run_id: str) -> int:
    """Add a ledger to the table at ``path`` under ``run_id``; the number of rows
    added. Steps that the table has of this run are left out, so a run that is tried
    again, after an error or twice over, adds no row twice. The first call makes the table."""
    spark = led.sparkSession
    rows = led.withColumn("run_id", F.lit(run_id))
    if exists(spark, path):
        known = spark.read.schema(rows.schema).parquet(path).where(F.col("run_id") == run_id).select("step")
        rows = rows.join(known, "step", "left_anti")
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # a row a step: read before the table changes
    n = rows.count()
    if n:
        rows.coalesce(1).write.mode("append").parquet(path)
    return n


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All runs' ledgers: ``run_id`` and the columns of :func:`ledger`."""
    return spark.read.parquet(path)

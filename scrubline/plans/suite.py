"""Rule suites, weighted scores and pass/fail gates.

A suite is a list of weighted rules plus gate thresholds. Scoring is one scan:
every scalar rule is a ``count_if`` in a single ``agg`` (or ``groupBy(by).agg``
for per-group scores); the duplicate-row rule, if present, is one more
map-side-combined ``groupBy``. The score is then column arithmetic on that one
row per group - nothing is collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import rules as R


@dataclass(frozen=True)
class Weighted:
    rule: R.Rule
    weight: float = 1.0


@dataclass(frozen=True)
class Suite:
    """A named set of weighted rules with gate thresholds.

    ``required`` columns make the score 0.0 when absent (the retail suite needs
    ``price``); other missing columns make their rule pass. ``clip`` bounds a
    non-empty score; the two 0.0 exits (no rows, required column missing) are
    not clipped.
    """

    name: str
    rules: tuple[Weighted, ...]
    pass_threshold: float
    excellent_threshold: float
    required: tuple[str, ...] = ()
    clip: tuple[float, float] | None = (0.001, 0.999)
    extra_counts: tuple[R.Rule, ...] = field(default=())

    @property
    def rule_names(self) -> list[str]:
        return [w.rule.name for w in self.rules]


def _scalar_rules(suite: Suite) -> list[R.Rule]:
    return [w.rule for w in suite.rules if w.rule.kind != "duplicates"] + list(suite.extra_counts)


def _dup_rules(suite: Suite) -> list[R.Rule]:
    return [w.rule for w in suite.rules if w.rule.kind == "duplicates"]


def _join_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    cond = None
    for k in by:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def rule_counts(df: DataFrame, suite: Suite, by: Sequence[str] | None = None,
                extra: Sequence[Column] = ()) -> DataFrame:
    """One row (per ``by`` group) with ``rows``, one count per rule and ``total_defects``.

    ``total_defects`` sums the suite's weighted rules (R14); ``extra_counts``
    (such as total missing cells) are reported but not summed. ``extra`` are
    further aliased aggregate Columns computed in the same scan.
    """
    by = list(by or [])
    dups = _dup_rules(suite)
    if dups and not extra and all(r.subset is None and r.applicable(df) for r in dups):
        counts = _counts_by_row(df, suite, by)
        dups = []
    else:
        aggs = [F.count(F.lit(1)).alias("rows")] + [r.count(df).alias(r.name) for r in _scalar_rules(suite)]
        aggs += list(extra)
        counts = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    for r in dups:
        if not r.applicable(df):
            counts = counts.withColumn(r.name, F.lit(0).cast("long"))
            continue
        keys = list(r.subset) if r.subset else X.visible_columns(df)
        if by:
            # duplicates within each group: group keys are part of the row key
            keys = by + [k for k in keys if k not in by]
            per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            dup = per_key.groupBy(*by).agg(F.sum(F.col("_n") - 1).cast("long").alias(r.name))
            counts = (counts.join(dup, _join_keys(counts, dup, by), "left")
                      .select(counts["*"], F.coalesce(dup[r.name], F.lit(0)).alias(r.name)))
        else:
            dup = R.duplicate_count(df, r.subset)
            counts = counts.withColumn(r.name, dup.select(F.col("duplicate_count")).scalar())
    total = None
    for w in suite.rules:
        total = F.col(w.rule.name) if total is None else total + F.col(w.rule.name)
    counts = counts.withColumn("total_defects", (total if total is not None else F.lit(0)).cast("long"))
    ordered = by + ["rows"] + [r.name for r in _scalar_rules(suite) if r not in _dup_rules(suite)]
    ordered += [r.name for r in _dup_rules(suite)] + ["total_defects"]
    ordered += [c for c in counts.columns if c not in ordered]
    seen: list[str] = []
    for c in ordered:
        if c not in seen:
            seen.append(c)
    return counts.select(*seen)


def _counts_by_row(df: DataFrame, suite: Suite, by: Sequence[str]) -> DataFrame:
    """All counts from one ``groupBy(all columns).count()``.

    Identical rows fail the same rules, so each scalar rule's count is
    ``sum(n)`` over the distinct rows failing it, and full-row duplicates are
    ``sum(n - 1)``. One scan and one map-side-combined shuffle replace a scan
    for the scalar rules plus a scan and shuffle for the duplicates.
    """
    keys = list(by) + [c for c in X.visible_columns(df) if c not in by]
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    aggs = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("rows")]
    for r in _scalar_rules(suite):
        terms = [F.coalesce(F.sum(F.when(p, n)), F.lit(0)) for p in r.predicates(per)]
        total = terms[0] if terms else F.lit(0)
        for t in terms[1:]:
            total = total + t
        aggs.append(total.cast("long").alias(r.name))
    for r in _dup_rules(suite):
        aggs.append(F.coalesce(F.sum(n - 1), F.lit(0)).cast("long").alias(r.name))
    return per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)


def score_column(suite: Suite, df_columns: Sequence[str]) -> Column:
    """Score expression over the columns of :func:`rule_counts`."""
    n = F.col("rows")
    total_w = sum(w.weight for w in suite.rules) or 1.0
    weighted = None
    for w in suite.rules:
        denom = n * F.lit(w.rule.cells_per_row())
        sub = F.lit(1.0) - F.col(w.rule.name) / F.greatest(denom, F.lit(1))
        term = F.lit(w.weight / total_w) * sub
        weighted = term if weighted is None else weighted + term
    if weighted is None:
        weighted = F.lit(1.0)
    if suite.clip is not None:
        lo, hi = suite.clip
        weighted = F.least(F.greatest(weighted, F.lit(lo)), F.lit(hi))
    if not all(c in df_columns for c in suite.required):
        return F.lit(0.0)
    return F.when(n == 0, F.lit(0.0)).otherwise(weighted).cast("double")


def score(df: DataFrame, suite: Suite, by: Sequence[str] | None = None,
          extra: Sequence[Column] = ()) -> DataFrame:
    """Counts, ``score`` in [0, 1] and the two gate booleans, per ``by`` group (Q1-Q5, Q8)."""
    return score_counts(rule_counts(df, suite, by, extra), suite, df.columns)


def score_counts(counts: DataFrame, suite: Suite, columns: Sequence[str]) -> DataFrame:
    """Score and gates from ``rows`` and the rules' counts of a table that has
    ``columns``."""
    s = score_column(suite, columns)
    return (counts.withColumn("score", s)
            .withColumn("passed", F.col("score") >= F.lit(suite.pass_threshold))
            .withColumn("excellent", F.col("score") >= F.lit(suite.excellent_threshold)))


def score_groupings(df: DataFrame, suite: Suite, groupings: Sequence[Sequence[str]]) -> DataFrame:
    """Counts, score and gates for several groupings in one pass: a row for each group
    of each, say by batch, by day and source, and () for the total.

    ``grouping`` names a row's grouping columns (comma-joined, '' for the total); columns
    that it does not group by are NULL. One scan, and one aggregate over grouping
    sets that each task combines before the shuffle. With a rule of duplicate rows the rows are
    first counted by their values, as each whole row lies in one group of every
    grouping; a rule of duplicates on some columns raises ValueError (rows that share them
    may lie in different groups)."""
    names = list(dict.fromkeys(c for g in groupings for c in g))
    unknown = [c for c in names if c not in df.columns]
    clash = sorted({"rows", "grouping", "total_defects", "score", *suite.rule_names} & set(names))
    if unknown or clash or not groupings:
        raise ValueError(f"groupings need columns of the table that are not named like a result: {unknown + clash}")
    dups = _dup_rules(suite)
    if any(r.subset is not None for r in dups):
        raise ValueError("score_groupings: duplicates on some columns cannot be counted within several groupings")
    # copies of the grouping columns: those of the rows are needed whole by the rules
    keys = {c: f"__scrubline_by_{k}" for k, c in enumerate(names)}
    whole = any(r.applicable(df) for r in dups)
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__scrubline_n")) if whole else df.withColumn("__scrubline_n", F.lit(1).cast("long"))
    n = F.col("__scrubline_n")
    aggs = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("rows")]
    for r in _scalar_rules(suite):
        terms = [F.coalesce(F.sum(F.when(p, n)), F.lit(0)) for p in r.predicates(df)]
        aggs.append(sum(terms[1:], terms[0] if terms else F.lit(0)).cast("long").alias(r.name))
    aggs += [(F.coalesce(F.sum(n - 1), F.lit(0)) if r.applicable(df) else F.lit(0)).cast("long").alias(r.name) for r in dups]
    copied = rows.withColumns({k: F.col(c) for c, k in keys.items()})
    sets = [[F.col(keys[c]) for c in g] for g in groupings]
    label = F.lit("")
    for g in reversed(list(groupings)):
        here = [F.grouping(k) == (0 if c in g else 1) for c, k in keys.items()]
        label = F.when(reduce(lambda a, b: a & b, here), F.lit(",".join(g))).otherwise(label) if here else label
    counts = copied.groupingSets(sets, *[F.col(k) for k in keys.values()]).agg(*aggs, label.alias("grouping")) if keys else copied.agg(*aggs, label.alias("grouping"))
    total = sum((F.col(w.rule.name) for w in suite.rules), F.lit(0)).cast("long")
    scored = score_counts(counts.withColumn("total_defects", total), suite, df.columns)
    return scored.select("grouping", *[F.col(k).alias(c) for c, k in keys.items()], *[c for c in scored.columns if c != "grouping" and c not in keys.values()])


def validate(df: DataFrame, suite: Suite) -> DataFrame:
    """Q7: score a table without changing it."""
    return score(df, suite).select("score", "passed", "excellent")


def reduction_pct(initial: Column, current: Column) -> Column:
    """Q6: percent of the initial defects removed; 0 when there were none; may be negative."""
    return F.when(initial > 0, F.round((initial - current) / initial * 100.0, 2)).otherwise(F.lit(0.0))


def rule_status(df: DataFrame, suite: Suite, strict: bool = False) -> DataFrame:
    """R15/T9, one row a rule: ``rule, violations, status, score``.

    ``status`` is ``not_applicable`` for a rule whose columns are absent, else
    ``passed`` (no violation) or ``failed``. ``score`` is the suite's; with
    ``strict`` it is 0.0 as soon as one rule is not applicable."""
    applies = [w.rule.applicable(df) for w in suite.rules]
    s = score(df, suite)
    value = F.lit(0.0) if strict and not all(applies) else F.col("score")
    rules = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(w.rule.name).alias("rule"), F.col(w.rule.name).cast("long").alias("violations"),
                               F.lit(ok).alias("_ok")) for k, (w, ok) in enumerate(zip(suite.rules, applies))])
    long = s.select(value.alias("score"), F.explode(rules).alias("_r")).select("_r.*", "score")
    status = F.when(~F.col("_ok"), "not_applicable").when(F.col("violations") == 0, "passed").otherwise("failed")
    return long.select("position", "rule", "violations", status.alias("status"), "score")


# ------------------------------------------------------------- report shape

# The uniform report's count fields, in report order.
REPORT_FIELDS = (
    "missing_count", "sentinel_count", "price_below_zero", "duplicate_count",
    "phone_format_errors", "email_case_errors", "age_range_violations",
    "date_order_violations", "icd10_format_errors", "negative_dosage_count",
    "blank_mandatory_count", "cross_column_violations",
)


def report(df: DataFrame, suite: Suite) -> DataFrame:
    """Every suite yields the same 12 count fields (unused ones are 0),
    plus ``total_defects``, ``score`` and the gates, in one row."""
    if "missing_count" not in [r.name for r in _scalar_rules(suite)]:
        # every report counts the missing cells of the whole table (R2)
        suite = replace(suite, extra_counts=(*suite.extra_counts, R.missing_cells((), "missing_count")))
    scored = score(df, suite)
    cols = [F.col("rows")]
    for f in REPORT_FIELDS:
        cols.append(F.col(f) if f in scored.columns else F.lit(0).cast("long").alias(f))
    return scored.select(*cols, "total_defects", "score", "passed", "excellent")


# ----------------------------------------------------------------- presets

# Preset thresholds (pass, excellent) and rule weights.
RETAIL_THRESHOLDS = (0.70, 0.95)
CRM_THRESHOLDS = (0.60, 0.90)
EMR_THRESHOLDS = (0.55, 0.85)
RETAIL_WEIGHTS = (0.5, 0.3, 0.2)
MANDATORY_EMR = ("patient_id", "diagnosis")


def retail_suite(price: str = "price") -> Suite:
    """Nulls, sentinel -1 and non-positive values of ``price`` (0.5/0.3/0.2)."""
    w_null, w_sent, w_pos = RETAIL_WEIGHTS
    return Suite(
        "retail",
        (Weighted(R.null_values(price, "price_null_count"), w_null),
         Weighted(R.equals_value(price, X.SENTINEL, "sentinel_count"), w_sent),
         Weighted(R.at_most(price, 0.0, "price_below_zero"), w_pos)),
        *RETAIL_THRESHOLDS,
        required=(price,),
        extra_counts=(R.missing_cells((), "missing_count"),),
    )


def crm_suite() -> Suite:
    """Duplicate rows, phone format, email case, age range; 25% each."""
    return Suite(
        "crm",
        (Weighted(R.duplicates(None, "duplicate_count"), 0.25),
         Weighted(R.phone_not_e164("phone"), 0.25),
         Weighted(R.not_lower("email"), 0.25),
         Weighted(R.out_of_range("age", X.AGE_MIN, X.AGE_MAX, "age_range_violations"), 0.25)),
        *CRM_THRESHOLDS,
    )


def emr_suite() -> Suite:
    """Date order, code format, negative dosage, blank cells (per cell), discharge order; 20% each."""
    return Suite(
        "emr",
        (Weighted(R.date_after("dob", "admission_date", "date_order_violations"), 0.2),
         Weighted(R.code_format("icd10_code"), 0.2),
         Weighted(R.below("dosage_mg", 0.0, "negative_dosage_count"), 0.2),
         Weighted(R.blank_cells(MANDATORY_EMR), 0.2),
         Weighted(R.date_after("admission_date", "discharge_date", "cross_column_violations"), 0.2)),
        *EMR_THRESHOLDS,
    )


PRESETS = {"retail": retail_suite, "crm": crm_suite, "emr": emr_suite}


def preset(name: str) -> Suite:
    try:
        return PRESETS[name]()
    except KeyError:
        raise ValueError(f"unknown suite {name!r}; known: {sorted(PRESETS)}") from None

"""scrubline: rule-based table cleaning and validation on Spark DataFrames."""

from .functions import rules
from .operators.clean import (abs_negative, clamp_range, drop_columns, fill_blank, fix_code_format,
                              fix_date_order, lowercase, standardize_phone)
from .operators.dedup import deduplicate
from .operators.fill import backward_fill, forward_fill
from .operators.profile import profile, sample_rows, sample_values, shape
from .operators.quantile import exact_median, exact_quantiles
from .operators.stats import impute_missing, replace_sentinel
from .plans.plan import append_ledger, apply_plan, ledger, read_ledger
from .plans.suite import Suite, Weighted, crm_suite, emr_suite, preset, report, retail_suite, rule_counts, score, score_groupings
from .session import leased
from .sources.io import export, read_permissive, read_published, read_table

__all__ = [
    "rules", "abs_negative", "clamp_range", "drop_columns", "fill_blank", "fix_code_format", "fix_date_order",
    "lowercase", "standardize_phone", "deduplicate", "backward_fill", "forward_fill", "profile", "sample_rows",
    "sample_values", "shape", "exact_median", "exact_quantiles", "impute_missing",
    "replace_sentinel", "append_ledger", "apply_plan", "ledger", "read_ledger", "Suite", "Weighted", "crm_suite", "emr_suite", "preset",
    "report", "retail_suite", "rule_counts", "score", "score_groupings", "leased",
    "export", "read_permissive", "read_published", "read_table",
]

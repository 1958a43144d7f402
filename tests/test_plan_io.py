"""Plans, ledger, gated export, profile."""

import os
import tempfile

import pytest

from scrubline.operators import profile as P
from scrubline.plans import plan as G
from scrubline.plans import suite as Q
from scrubline.sources import fixtures as FX
from scrubline.sources.io import GateFailed, export

SF = "/root/testdata/sf0.001"


def test_parse_errors():
    with pytest.raises(G.PlanError):
        G.parse_step({"operation": "explode_everything"})
    with pytest.raises(G.PlanError):
        G.parse_step({"operation": "clamp_range", "params": {"lo": 1}})
    assert G.parse_step({"operation": "lowercase_email", "target_columns": "email"}).target_columns == ("email",)
    assert G.parse_step({"operation": "lowercase_email", "target_columns": None}).target_columns == ()


def test_ledger_records_errors_and_progress(spark):
    retail = FX.view(spark, SF, "retail")
    steps = [{"operation": "replace_sentinel", "target_columns": ["price"]},
             {"operation": "deduplicate", "target_columns": ["category"], "params": {"keep": "first"}},
             {"operation": "impute_missing", "target_columns": ["price"]}]
    out, led = G.ledger(retail, steps, Q.retail_suite())
    rows = led.orderBy("step").collect()
    assert [r.step for r in rows] == [0, 1, 2, 3]
    assert rows[2].error and "order_by" in rows[2].error
    assert rows[1].affected == rows[0].defects_after - rows[1].defects_after or rows[1].affected > 0
    assert rows[3].defects_after <= rows[1].defects_after and rows[3].reduction_pct > 0
    assert out.count() == retail.count()


def test_export_gate(spark):
    retail = FX.view(spark, SF, "retail")
    base = tempfile.mkdtemp(prefix="scrubline-test-")
    strict = Q.Suite("strict", Q.retail_suite().rules, 0.9999, 0.99999, required=("price",))
    with pytest.raises(GateFailed):
        export(retail, f"{base}/bad", gate=Q.score(retail, strict))
    assert not os.path.exists(f"{base}/bad")
    info = export(retail, f"{base}/ok", gate=Q.score(retail, Q.retail_suite()), partition_by=["category"])
    assert info["written"] and spark.read.parquet(f"{base}/ok").count() == retail.count()


def test_profile(spark):
    retail = FX.view(spark, SF, "retail")
    prof = {r.column: r for r in P.profile(retail, order_by="row_id").collect()}
    n = retail.count()
    assert prof["price"].null_count == retail.where("price IS NULL").count()
    assert prof["row_id"].unique_count == n and prof["row_id"].dtype == "bigint"
    assert len(prof["category"].sample_values) == 5
    full = P.profile(retail, order_by="row_id")
    assert [(f.name, f.dataType) for f in full.schema.fields] == [(f.name, f.dataType) for f in P.PROFILE_SCHEMA.fields]
    assert P.profile_violations(full).count() == 0
    rows = P.sample_rows(retail, "row_id").collect()
    assert len(rows) == 5 and all(isinstance(v, str) for v in rows[0])


def test_full_report_and_observed_export(spark):
    from scrubline.plans import suite as Q2
    emr = FX.view(spark, SF, "emr")
    rec = P.full_report(emr, Q2.emr_suite(), "row_id").collect()[0]
    assert len(rec.column_stats) == len(emr.columns) and len(rec.sample_rows) == 5
    assert rec.icd10_format_errors > 0 and rec.duplicate_count == 0
    base = tempfile.mkdtemp(prefix="scrubline-test-")
    info = export(emr, f"{base}/emr", suite=Q2.emr_suite())
    assert info["written_metrics"]["rows"] == emr.count()
    assert info["written_metrics"]["icd10_format_errors"] == rec.icd10_format_errors


def test_ledger_records_type_errors(spark):
    retail = FX.view(spark, SF, "retail")
    steps = [{"operation": "clamp_range", "target_columns": ["category"], "params": {"min_val": 0}}]
    _, led = G.ledger(retail, steps, Q.retail_suite())
    rows = led.orderBy("step").collect()
    assert rows[1].error and "TypeError" in rows[1].error


def test_read_table_formats(spark):
    from scrubline.sources.io import read_table
    retail = FX.view(spark, SF, "retail")
    base = tempfile.mkdtemp(prefix="scrubline-test-")
    retail.write.csv(f"{base}/csv", header=True)
    retail.write.json(f"{base}/json")
    schema = retail.schema
    csv = read_table(spark, f"{base}/csv", fmt="csv", schema=schema, header=True)
    js = read_table(spark, f"{base}/json", fmt="json", schema=schema)
    for d in (csv, js):
        assert d.count() == retail.count()
        assert Q.rule_counts(d, Q.retail_suite()).collect() == Q.rule_counts(retail, Q.retail_suite()).collect()


def test_fused_statistic_steps(spark):
    crm = FX.view(spark, SF, "crm")
    steps = [{"operation": "impute_missing", "target_columns": ["age"], "params": {"strategy": "mean"}},
             {"operation": "impute_missing", "target_columns": ["phone"], "params": {"strategy": "mean"}},
             {"operation": "impute_missing", "target_columns": ["age"], "params": {"strategy": "median"}}]
    fused = G.fuse_steps([G.parse_step(s) for s in steps])
    assert [f.target_columns for f in fused] == [("age", "phone"), ("age",)]
    a = G.apply_plan(crm, steps)
    from scrubline.operators import stats as S
    b = S.impute_missing(S.impute_missing(S.impute_missing(crm, ["age"], "mean"), ["phone"], "mean"), ["age"], "median")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_profile_approx_close_to_exact(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    exact = {r.column: r for r in P.profile(li).collect()}
    approx = {r.column: r for r in P.profile(li, approx=True).collect()}
    for c, r in exact.items():
        assert approx[c].null_count == r.null_count
        assert abs(approx[c].unique_count - r.unique_count) <= max(2, 0.06 * r.unique_count)

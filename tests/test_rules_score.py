"""Rule semantics, suite scores and the traps of SURVEY appendix A."""

import math

import pytest
from pyspark.sql import functions as F

from scrubline.functions import rules as R
from scrubline.operators import clean as C
from scrubline.plans import suite as Q


def _one(df):
    return df.collect()[0].asDict()


def test_retail_counts_and_score(spark):
    rows = [(1, None), (2, -1.0), (3, 0.0), (4, 5.0), (5, float("nan")), (6, 7.0), (7, 8.0), (8, 9.0), (9, 1.0), (10, 2.0)]
    df = spark.createDataFrame(rows, "k int, price double")
    r = _one(Q.score(df, Q.retail_suite()))
    assert (r["price_null_count"], r["sentinel_count"], r["price_below_zero"]) == (2, 1, 2)
    assert r["missing_count"] == 2 and r["total_defects"] == 5
    assert math.isclose(r["score"], 0.5 * 0.8 + 0.3 * 0.9 + 0.2 * 0.8)
    assert r["passed"] and not r["excellent"]


def test_text_numbers_are_coerced(spark):
    df = spark.createDataFrame([(" 1 ",), ("abc",), ("-1",), ("1e3",), ("1d",)], "price string")
    r = _one(Q.rule_counts(df, Q.retail_suite()))
    # 'abc' and '1d' are unparseable -> null; -1 is both sentinel and non-positive
    assert (r["price_null_count"], r["sentinel_count"], r["price_below_zero"]) == (2, 1, 1)


def test_missing_required_and_empty(spark):
    df = spark.createDataFrame([(1,)], "k int")
    assert _one(Q.score(df, Q.retail_suite()))["score"] == 0.0
    empty = spark.createDataFrame([], "price double")
    assert _one(Q.score(empty, Q.retail_suite()))["score"] == 0.0
    # a missing CRM column passes (sub-score 1), others still count
    crm = spark.createDataFrame([("A@X.COM",)], "email string")
    r = _one(Q.score(crm, Q.crm_suite()))
    assert r["email_case_errors"] == 1 and r["phone_format_errors"] == 0
    assert math.isclose(r["score"], 0.75)


def test_score_clip(spark):
    clean = spark.createDataFrame([(1.0,), (2.0,)], "price double")
    assert _one(Q.score(clean, Q.retail_suite()))["score"] == 0.999
    bad = spark.createDataFrame([(None,), (None,)], "price double")
    assert math.isclose(_one(Q.score(bad, Q.retail_suite()))["score"], 0.5)


def test_emr_blank_per_cell_and_whitespace(spark):
    rows = [("", "\t\n", "A01.1", 1.0, "2000-01-01", "2020-01-01", "2020-01-02"),
            ("PAT-1", None, None, -1.0, "2021-01-01", "2020-01-01", "2019-12-31"),
            ("PAT-2", "Sepsis", "A01.12", 2.0, "bad", "2020-01-01", "2020-01-03")]
    df = spark.createDataFrame(rows, "patient_id string, diagnosis string, icd10_code string, dosage_mg double,"
                                     " dob string, admission_date string, discharge_date string")
    r = _one(Q.score(df, Q.emr_suite()))
    assert r["blank_mandatory_count"] == 3  # both cells of row 1, one of row 2
    assert r["icd10_format_errors"] == 1  # null counts as an error
    assert r["negative_dosage_count"] == 1
    assert r["date_order_violations"] == 1 and r["cross_column_violations"] == 1
    exp = (0.2 * (1 - 1 / 3) + 0.2 * (1 - 1 / 3) + 0.2 * (1 - 1 / 3) + 0.2 * (1 - 3 / 6) + 0.2 * (1 - 1 / 3))
    assert math.isclose(r["score"], exp)


def test_crm_rules(spark):
    rows = [("+12125551234", "a@x.com", 30.0), ("+12125551234", "a@x.com", 30.0),
            ("(212) 555-1234", "A@x.com", 17.0), (None, None, float("nan")), ("1", "b@x.com", 101.0)]
    df = spark.createDataFrame(rows, "phone string, email string, age double")
    r = _one(Q.rule_counts(df, Q.crm_suite()))
    assert (r["duplicate_count"], r["phone_format_errors"], r["email_case_errors"], r["age_range_violations"]) == (1, 2, 1, 2)


def test_null_keys_group_together(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None), (2, None)], "a int, b int")
    assert _one(R.duplicate_count(df))["duplicate_count"] == 2


def test_grouped_scores(spark):
    rows = [("x", None), ("x", 1.0), ("y", -1.0), ("y", 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, price double")
    res = {r["g"]: r for r in Q.score(df, Q.retail_suite(), by=["g"]).collect()}
    assert res["x"]["price_null_count"] == 1 and res["y"]["sentinel_count"] == 1 and res[None]["rows"] == 1


def test_report_shape(spark):
    df = spark.createDataFrame([(1.0,)], "price double")
    rep = Q.report(df, Q.retail_suite())
    assert rep.columns[1:13] == list(Q.REPORT_FIELDS)
    assert _one(rep)["duplicate_count"] == 0


def test_drop_protected(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.drop_columns(df, ["a", "zz"]).columns == ["b"]
    with pytest.raises(ValueError):
        C.drop_columns(df, ["a"], protected=["a"])


def test_fill_blank_type_guard(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(TypeError):
        C.fill_blank(df, ["a"], "UNKNOWN")


def test_quarantine_flags(spark):
    from scrubline.operators import quarantine as QR
    rows = [(1, "PAT-1", "Sepsis", "A01.1", 1.0, "2000-01-01", "2020-01-01", "2020-01-02"),
            (2, "", "Sepsis", "a011", -1.0, "2000-01-01", "2020-01-01", "2020-01-02")]
    df = spark.createDataFrame(rows, "k int, patient_id string, diagnosis string, icd10_code string, dosage_mg double,"
                                     " dob string, admission_date string, discharge_date string")
    good, bad = QR.split(df, Q.emr_suite())
    assert [r.k for r in good.collect()] == [1]
    assert bad.collect()[0]["failed_rules"] == ["icd10_format_errors", "negative_dosage_count", "blank_mandatory_count"]


def test_custom_suite(spark):
    rows = [(1, 5.0, "a"), (2, 50.0, "b"), (3, None, "c"), (4, 7.0, None)]
    df = spark.createDataFrame(rows, "k int, amount double, tag string")
    suite = Q.Suite("custom", (Q.Weighted(R.custom("too_big", F.col("amount") > 10, ["amount"]), 3.0),
                               Q.Weighted(R.custom("no_tag", lambda d: d["tag"].isNull(), ["tag"]), 1.0),
                               Q.Weighted(R.custom("gone", F.col("zz") > 0, ["zz"]), 1.0)),
                    0.5, 0.9, clip=None)
    r = _one(Q.score(df, suite))
    assert (r["too_big"], r["no_tag"], r["gone"]) == (1, 1, 0)
    assert math.isclose(r["score"], (3 * 0.75 + 1 * 0.75 + 1 * 1.0) / 5)


def test_empty_table_scores_zero_in_every_suite(spark):
    for suite, schema in [(Q.crm_suite(), "phone string, email string, age double"),
                          (Q.emr_suite(), "patient_id string, diagnosis string"),
                          (Q.retail_suite(), "price double")]:
        r = _one(Q.score(spark.createDataFrame([], schema), suite))
        assert r["rows"] == 0 and r["score"] == 0.0 and r["total_defects"] == 0 and not r["passed"]

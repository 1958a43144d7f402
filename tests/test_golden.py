"""Golden edge rows for each operator (FIXTURES.md, inline edge rows)."""

import math

from pyspark.sql import functions as F

from scrubline.functions import rules as R
from scrubline.operators import clean as C
from scrubline.operators import dedup as D
from scrubline.operators import fill as W
from scrubline.operators import stats as S
from scrubline.operators.quantile import exact_median


def _col(df, name, order="k"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_phone_e164(spark):
    rows = [(1, "(212) 555-1234"), (2, "12125551234"), (3, "+442071234567"), (4, "555"), (5, None)]
    df = spark.createDataFrame(rows, "k int, phone string")
    assert _col(C.standardize_phone(df), "phone") == [
        "+12125551234", "+12125551234", "+442071234567", "555", None]


def test_code_format(spark):
    rows = [(1, "a011"), (2, "D5000"), (3, " e 119 "), (4, "c34"), (5, "A01.123"), (6, "X1"), (7, None)]
    df = spark.createDataFrame(rows, "k int, icd10_code string")
    out = C.fix_code_format(df)
    assert _col(out, "icd10_code") == ["A01.1", "D50.00", "E11.9", "C34", "A01.123", "X1", None]
    # the repair accepts C34 but the rule does not: it stays a defect
    bad = out.where(R.code_format().predicate(out)).select("k")
    assert sorted(r.k for r in bad.collect()) == [4, 5, 6, 7]


def test_clamp(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 200.0), (3, 50.0), (4, None), (5, float("nan"))], "k int, age double")
    assert _col(C.clamp_range(df, ["age"], 18, 100), "age") == [18.0, 100.0, 50.0, None, None]
    # reversed bounds are swapped
    assert _col(C.clamp_range(df, ["age"], 100, 18), "age") == [18.0, 100.0, 50.0, None, None]


def test_date_swap(spark):
    df = spark.createDataFrame([(1, "2024-01-02", "2020-01-01"), (2, "bad", "2020-01-01")],
                               "k int, dob string, admission_date string")
    out = C.fix_date_order(df).select("k", F.col("dob").cast("string").alias("dob"),
                                      F.col("admission_date").cast("string").alias("adm"))
    assert [(r.dob, r.adm) for r in out.orderBy("k").collect()] == [
        ("2020-01-01", "2024-01-02"), (None, "2020-01-01")]


def test_mode_and_median(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    nums = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert exact_median(nums, "v").collect()[0]["median"] == 2.5


def test_ffill_bfill(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, None), (4, 5.0)], "k int, v double")
    assert _col(W.forward_fill(df, ["v"], order_by="k"), "v") == [None, 3.0, 3.0, 5.0]
    assert _col(W.backward_fill(df, ["v"], order_by="k"), "v") == [3.0, 3.0, 5.0, 5.0]
    # the same through impute_missing
    assert _col(S.impute_missing(df, ["v"], "forward_fill", order_by="k"), "v") == [None, 3.0, 3.0, 5.0]


def test_dedup_keep(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, k string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(D.deduplicate(df, ["k"], "first", order_by="id")) == [1, 3, 4]
    assert ids(D.deduplicate(df, ["k"], "last", order_by="id")) == [2, 3, 5]
    assert ids(D.deduplicate(df, ["k"], "none")) == [3]
    assert ids(D.deduplicate(df, ["k"], False)) == [3]


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 3.0), (5, float("nan"))], "k int, v double")
    assert _col(S.impute_missing(df, ["v"], "median"), "v") == [1.0, 3.0, 3.0, 3.0, 3.0]
    mean = _col(S.impute_missing(df, ["v"], "mean"), "v")
    assert math.isclose(mean[1], 7 / 3)
    assert _col(S.impute_missing(df, ["v"], "mode"), "v") == [1.0, 3.0, 3.0, 3.0, 3.0]
    assert _col(S.impute_missing(df, ["v"], "constant", value=0.0), "v") == [1.0, 0.0, 3.0, 3.0, 0.0]
    # constant None fills nothing; unknown strategy means median
    assert _col(S.impute_missing(df, ["v"], "constant"), "v")[1] is None
    assert _col(S.impute_missing(df, ["v"], "nonsense"), "v")[1] == 3.0


def test_replace_sentinel(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 10.0), (3, 0.0), (4, None), (5, 20.0)], "k int, price double")
    assert _col(S.replace_sentinel(df, ["price"]), "price") == [10.0, 10.0, 0.0, None, 20.0]
    assert _col(S.replace_sentinel(df, ["price"], valid=lambda v: v > 0), "price")[0] == 15.0
    assert _col(S.replace_sentinel(df, ["price"], strategy="mean"), "price")[0] == 10.0
    assert _col(S.replace_sentinel(df, ["price"], strategy="constant"), "price")[0] == 0.0
    only = spark.createDataFrame([(1, -1.0), (2, None)], "k int, price double")
    # empty statistic gives 0.0
    assert _col(S.replace_sentinel(only, ["price"]), "price")[0] == 0.0


def test_fill_blank_and_abs(spark):
    df = spark.createDataFrame([(1, "  ", -2.5), (2, None, 3.0), (3, "x", None)], "k int, d string, dosage_mg double")
    assert _col(C.fill_blank(df, ["d"]), "d") == ["UNKNOWN", "UNKNOWN", "x"]
    assert _col(C.fill_blank(df, []), "d") == ["  ", None, "x"]
    assert _col(C.abs_negative(df), "dosage_mg") == [2.5, 3.0, None]


def test_mode_many_columns_one_pass(spark):
    import datetime as dt
    rows = [(1, "b", 2.0, 7, dt.date(2020, 1, 2)), (2, "a", 2.0, None, dt.date(2020, 1, 1)),
            (3, "b", None, 7, None), (4, "a", 1.0, 3, dt.date(2020, 1, 1)), (5, None, float("nan"), 3, dt.date(2020, 1, 2))]
    df = spark.createDataFrame(rows, "k int, s string, d double, i int, t date")
    out = {r.k: r for r in S.impute_missing(df, ["s", "d", "i", "t"], "mode").collect()}
    assert out[5].s == "a" and out[3].d == 2.0 and out[5].d == 2.0 and out[2].i == 3 and out[3].t == dt.date(2020, 1, 1)
    grouped = {r.k: r for r in S.impute_missing(df.withColumn("g", F.lit(1)), ["s", "i"], "mode", by=["g"]).collect()}
    assert grouped[5].s == "a" and grouped[2].i == 3

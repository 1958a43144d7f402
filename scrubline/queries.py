"""Registered queries: one Spark DataFrame builder per operator, each with the
DuckDB SQL that computes the same rows (the correctness oracle).

Every query reads whole test tables (or the dirty views Spark derives from
them); nothing is capped, sampled or filtered to make the check cheap. Float
results that depend on summation or interpolation order are rounded to the
same number of places on both sides.
"""

from __future__ import annotations

import decimal
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .functions import rules as R
from .operators import clean as C
from .operators import dedup as D
from .operators import fill as W
from .operators import inject as I
from .operators import profile as P
from .operators import quarantine as QR
from .operators import stats as S
from .operators.quantile import exact_median, exact_quantiles
from .plans import plan as G
from .plans import suite as Q
from .sources import fixtures as FX
from .sources.io import load
from .streaming import stream as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return FX.view(spark, sf, name)


# ------------------------------------------------------------------ SQL bits
_WS = r"'^\s+|\s+$'"


def _blank_sql(c: str) -> str:
    return f"({c} IS NULL OR regexp_replace({c}, {_WS}, '', 'g') = '')"


_RETAIL_COUNTS = """count(*) AS rows,
 count(*) FILTER (WHERE price IS NULL OR isnan(price)) AS price_null_count,
 count(*) FILTER (WHERE price = -1) AS sentinel_count,
 count(*) FILTER (WHERE price <= 0) AS price_below_zero,
 count(*) FILTER (WHERE row_id IS NULL) + count(*) FILTER (WHERE transaction_id IS NULL)
 + count(*) FILTER (WHERE category IS NULL) + count(*) FILTER (WHERE quantity IS NULL)
 + count(*) FILTER (WHERE price IS NULL OR isnan(price)) + count(*) FILTER (WHERE timestamp IS NULL) AS missing_count"""

_CRM_COUNTS = """count(*) AS rows,
 count(*) FILTER (WHERE phone IS NOT NULL AND NOT regexp_matches(phone, '^\\+1\\d{10}$')) AS phone_format_errors,
 count(*) FILTER (WHERE email <> lower(email)) AS email_case_errors,
 count(*) FILTER (WHERE age < 18 OR age > 100) AS age_range_violations"""

_CRM_DUPS = """(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {t}
 GROUP BY row_id, customer_id, email, phone, age, signup_date, plan))"""

_EMR_COUNTS = """count(*) AS rows,
 count(*) FILTER (WHERE try_strptime(dob, '%Y-%m-%d') > try_strptime(admission_date, '%Y-%m-%d')) AS date_order_violations,
 count(*) FILTER (WHERE NOT regexp_matches(coalesce(icd10_code, ''), '^[A-Z]\\d{2}\\.\\d{1,2}$')) AS icd10_format_errors,
 count(*) FILTER (WHERE dosage_mg < 0) AS negative_dosage_count,
 count(*) FILTER (WHERE """ + _blank_sql("patient_id") + """) + count(*) FILTER (WHERE """ + _blank_sql("diagnosis") + """) AS blank_mandatory_count,
 count(*) FILTER (WHERE try_strptime(admission_date, '%Y-%m-%d') > try_strptime(discharge_date, '%Y-%m-%d')) AS cross_column_violations"""


def _clip(expr: str) -> str:
    return f"greatest(least({expr}, 0.999), 0.001)"


# ================================================================ rules R1-R14

@register("retail_rules", FX.cte("retail") + f"""
, c AS (SELECT {_RETAIL_COUNTS} FROM retail)
SELECT rows, price_null_count, sentinel_count, price_below_zero, CAST(missing_count AS BIGINT) AS missing_count,
 CAST(price_null_count + sentinel_count + price_below_zero AS BIGINT) AS total_defects FROM c""")
def retail_rules(spark, sf):
    return Q.rule_counts(_view(spark, sf, "retail"), Q.retail_suite())


@register("crm_rules", FX.cte("crm") + f"""
, c AS (SELECT {_CRM_COUNTS} FROM crm)
SELECT rows, phone_format_errors, email_case_errors, age_range_violations,
 {_CRM_DUPS.format(t='crm')} AS duplicate_count,
 CAST({_CRM_DUPS.format(t='crm')} + phone_format_errors + email_case_errors + age_range_violations AS BIGINT) AS total_defects
FROM c""")
def crm_rules(spark, sf):
    return Q.rule_counts(_view(spark, sf, "crm"), Q.crm_suite())


@register("emr_rules", FX.cte("emr") + f"""
, c AS (SELECT {_EMR_COUNTS} FROM emr)
SELECT rows, date_order_violations, icd10_format_errors, negative_dosage_count,
 CAST(blank_mandatory_count AS BIGINT) AS blank_mandatory_count, cross_column_violations,
 CAST(date_order_violations + icd10_format_errors + negative_dosage_count + blank_mandatory_count
      + cross_column_violations AS BIGINT) AS total_defects
FROM c""")
def emr_rules(spark, sf):
    return Q.rule_counts(_view(spark, sf, "emr"), Q.emr_suite())


@register("natural_negative_balance", """
SELECT count(*) AS rows, count(*) FILTER (WHERE c_acctbal < 0) AS negative_balance,
 count(*) FILTER (WHERE c_acctbal IS NULL OR isnan(c_acctbal)) AS balance_null
FROM customer""")
def natural_negative_balance(spark, sf):
    """R12 and R1 on a natural column (no injected defects)."""
    cust = load(spark, sf, "customer")
    return cust.agg(F.count(F.lit(1)).alias("rows"),
                    R.below("c_acctbal", 0.0, "negative_balance").count(cust).alias("negative_balance"),
                    R.null_values("c_acctbal", "balance_null").count(cust).alias("balance_null"))


@register("ship_before_order", """
SELECT l_returnflag, l_linestatus, count(*) AS rows,
 count(*) FILTER (WHERE CAST(o.o_orderdate AS DATE) > CAST(l.l_shipdate AS DATE)) AS ship_before_order
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY l_returnflag, l_linestatus""")
def ship_before_order(spark, sf):
    """R10 across a join: ship date before the order date, per flag/status."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate")
    od = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    rule = R.date_after("o_orderdate", "l_shipdate", "ship_before_order")
    return j.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"),
                                                         rule.count(j).alias("ship_before_order"))


# ================================================================ scores Q1-Q8

_RETAIL_SCORE = _clip("0.5 * (1.0 - price_null_count / greatest(rows, 1)) + 0.3 * (1.0 - sentinel_count / greatest(rows, 1))"
                      " + 0.2 * (1.0 - price_below_zero / greatest(rows, 1))")
_CRM_SCORE = _clip("0.25 * (1.0 - d / greatest(rows, 1)) + 0.25 * (1.0 - phone_format_errors / greatest(rows, 1))"
                   " + 0.25 * (1.0 - email_case_errors / greatest(rows, 1)) + 0.25 * (1.0 - age_range_violations / greatest(rows, 1))")
_EMR_SCORE = _clip("0.2 * (1.0 - date_order_violations / greatest(rows, 1)) + 0.2 * (1.0 - icd10_format_errors / greatest(rows, 1))"
                   " + 0.2 * (1.0 - negative_dosage_count / greatest(rows, 1)) + 0.2 * (1.0 - blank_mandatory_count / greatest(rows * 2, 1))"
                   " + 0.2 * (1.0 - cross_column_violations / greatest(rows, 1))")


def _scored(df: DataFrame) -> DataFrame:
    return df.select("rows", "total_defects", F.round("score", 6).alias("score"), "passed", "excellent")


@register("retail_score", FX.cte("retail") + f"""
, c AS (SELECT {_RETAIL_COUNTS} FROM retail), s AS (SELECT *, {_RETAIL_SCORE} AS sc FROM c)
SELECT rows, CAST(price_null_count + sentinel_count + price_below_zero AS BIGINT) AS total_defects,
 round(sc, 6) AS score, sc >= 0.70 AS passed, sc >= 0.95 AS excellent FROM s""")
def retail_score(spark, sf):
    return _scored(Q.score(_view(spark, sf, "retail"), Q.retail_suite()))


@register("crm_score", FX.cte("crm") + f"""
, c AS (SELECT {_CRM_COUNTS}, {_CRM_DUPS.format(t='crm')} AS d FROM crm), s AS (SELECT *, {_CRM_SCORE} AS sc FROM c)
SELECT rows, CAST(d + phone_format_errors + email_case_errors + age_range_violations AS BIGINT) AS total_defects,
 round(sc, 6) AS score, sc >= 0.60 AS passed, sc >= 0.90 AS excellent FROM s""")
def crm_score(spark, sf):
    return _scored(Q.score(_view(spark, sf, "crm"), Q.crm_suite()))


@register("emr_score", FX.cte("emr") + f"""
, c AS (SELECT {_EMR_COUNTS} FROM emr), s AS (SELECT *, {_EMR_SCORE} AS sc FROM c)
SELECT rows, CAST(date_order_violations + icd10_format_errors + negative_dosage_count + blank_mandatory_count
      + cross_column_violations AS BIGINT) AS total_defects,
 round(sc, 6) AS score, sc >= 0.55 AS passed, sc >= 0.85 AS excellent FROM s""")
def emr_score(spark, sf):
    return _scored(Q.score(_view(spark, sf, "emr"), Q.emr_suite()))


@register("score_by_group", FX.cte("emr") + f"""
, c AS (SELECT ward, {_EMR_COUNTS} FROM emr GROUP BY ward), s AS (SELECT *, {_EMR_SCORE} AS sc FROM c)
SELECT ward, rows, CAST(date_order_violations + icd10_format_errors + negative_dosage_count + blank_mandatory_count
      + cross_column_violations AS BIGINT) AS total_defects,
 round(sc, 6) AS score, sc >= 0.55 AS passed, sc >= 0.85 AS excellent FROM s""")
def score_by_group(spark, sf):
    s = Q.score(_view(spark, sf, "emr"), Q.emr_suite(), by=["ward"])
    return s.select("ward", "rows", "total_defects", F.round("score", 6).alias("score"), "passed", "excellent")


@register("crm_score_by_plan", FX.cte("crm") + f"""
, c AS (SELECT plan, {_CRM_COUNTS},
   (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT plan AS p2, count(*) AS n FROM crm
     GROUP BY row_id, customer_id, email, phone, age, signup_date, plan) x WHERE x.p2 = crm.plan) AS d0
   FROM crm GROUP BY plan),
 c2 AS (SELECT c.*, coalesce(d0, 0) AS d FROM c), s AS (SELECT *, {_CRM_SCORE} AS sc FROM c2)
SELECT plan, rows, d AS duplicate_count, CAST(d + phone_format_errors + email_case_errors + age_range_violations AS BIGINT) AS total_defects,
 round(sc, 6) AS score FROM s""")
def crm_score_by_plan(spark, sf):
    """Q8 with a row-set rule per group: duplicates counted inside each plan."""
    s = Q.score(_view(spark, sf, "crm"), Q.crm_suite(), by=["plan"])
    return s.select("plan", "rows", "duplicate_count", "total_defects", F.round("score", 6).alias("score"))


def _missing_sql(cols: str, floats: tuple[str, ...] = ()) -> str:
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in floats else ''})" for c in cols.split(", "))


_CRM_COLUMNS = "row_id, customer_id, email, phone, age, signup_date, plan"
_EMR_COLUMNS = "row_id, patient_id, dob, admission_date, discharge_date, icd10_code, dosage_mg, diagnosis, ward"
_REPORT_ZERO = {f: f"CAST(0 AS BIGINT) AS {f}" for f in Q.REPORT_FIELDS}


def _report_sql(have: dict[str, str], tail: str) -> str:
    """The uniform report: ``have`` names the fields that the suite counts."""
    return "SELECT rows, " + ", ".join(f"CAST({have[f]} AS BIGINT) AS {f}" if f in have else _REPORT_ZERO[f] for f in Q.REPORT_FIELDS) + ", " + tail


@register("crm_report", FX.cte("crm") + f"""
, c AS (SELECT {_CRM_COUNTS}, {_CRM_DUPS.format(t='crm')} AS d, {_missing_sql(_CRM_COLUMNS)} AS missing FROM crm), s AS (SELECT *, {_CRM_SCORE} AS sc FROM c)
""" + _report_sql({"missing_count": "missing", "duplicate_count": "d"} | {f: f for f in ("phone_format_errors", "email_case_errors", "age_range_violations")},
                  """CAST(d + phone_format_errors + email_case_errors + age_range_violations AS BIGINT) AS total_defects,
 round(sc, 6) AS score, sc >= 0.60 AS passed, sc >= 0.90 AS excellent FROM s"""))
def crm_report(spark, sf):
    """The uniform 12-field report of the CRM suite."""
    return Q.report(_view(spark, sf, "crm"), Q.crm_suite()).withColumn("score", F.round("score", 6))


@register("retail_report", FX.cte("retail") + f"""
, c AS (SELECT {_RETAIL_COUNTS} FROM retail), s AS (SELECT *, {_RETAIL_SCORE} AS sc FROM c)
""" + _report_sql({f: f for f in ("missing_count", "sentinel_count", "price_below_zero")},
                  """CAST(price_null_count + sentinel_count + price_below_zero AS BIGINT) AS total_defects,
 round(sc, 6) AS score, sc >= 0.70 AS passed, sc >= 0.95 AS excellent FROM s"""))
def retail_report(spark, sf):
    return Q.report(_view(spark, sf, "retail"), Q.retail_suite()).withColumn("score", F.round("score", 6))


@register("emr_report", FX.cte("emr") + f"""
, c AS (SELECT {_EMR_COUNTS}, {_missing_sql(_EMR_COLUMNS)} AS missing FROM emr), s AS (SELECT *, {_EMR_SCORE} AS sc FROM c)
""" + _report_sql({"missing_count": "missing"} | {f: f for f in ("date_order_violations", "icd10_format_errors", "negative_dosage_count", "blank_mandatory_count", "cross_column_violations")},
                  """CAST(date_order_violations + icd10_format_errors + negative_dosage_count + blank_mandatory_count + cross_column_violations AS BIGINT) AS total_defects,
 round(sc, 6) AS score, sc >= 0.55 AS passed, sc >= 0.85 AS excellent FROM s"""))
def emr_report(spark, sf):
    return Q.report(_view(spark, sf, "emr"), Q.emr_suite()).withColumn("score", F.round("score", 6))


@register("emr_rules_dropped_column", FX.cte("emr") + f"""
, c AS (SELECT {_EMR_COUNTS} FROM emr)
SELECT * FROM (
 SELECT 0 AS position, 'date_order_violations' AS rule, date_order_violations AS violations, CASE WHEN date_order_violations = 0 THEN 'passed' ELSE 'failed' END AS status, 0.0::DOUBLE AS score FROM c
 UNION ALL SELECT 1, 'icd10_format_errors', icd10_format_errors, CASE WHEN icd10_format_errors = 0 THEN 'passed' ELSE 'failed' END, 0.0 FROM c
 UNION ALL SELECT 2, 'negative_dosage_count', count(*) FILTER (WHERE false), 'not_applicable', 0.0 FROM emr
 UNION ALL SELECT 3, 'blank_mandatory_count', CAST(blank_mandatory_count AS BIGINT), CASE WHEN blank_mandatory_count = 0 THEN 'passed' ELSE 'failed' END, 0.0 FROM c
 UNION ALL SELECT 4, 'cross_column_violations', cross_column_violations, CASE WHEN cross_column_violations = 0 THEN 'passed' ELSE 'failed' END, 0.0 FROM c)""")
def emr_rules_dropped_column(spark, sf):
    """A rule whose column is gone is not applicable, and the strict score is 0."""
    df = C.drop_columns(_view(spark, sf, "emr"), ["dosage_mg"])
    return Q.rule_status(df, Q.emr_suite(), strict=True)


@register("validate_dropped_price", FX.cte("retail") + """
SELECT CAST(0.0 AS DOUBLE) AS score, false AS passed, false AS excellent, count(*) AS rows FROM retail""")
def validate_dropped_price(spark, sf):
    """Without its required column the retail score is 0.0 (not clipped)."""
    df = C.drop_columns(_view(spark, sf, "retail"), ["price"])
    return Q.score(df, Q.retail_suite()).select("score", "passed", "excellent", "rows")


# ========================================================= statistic cleaners

_RETAIL_COLS = "row_id, transaction_id, category, quantity, {price} AS price, timestamp"


def _retail_out(df: DataFrame) -> DataFrame:
    return df.select("row_id", "transaction_id", "category", "quantity",
                     F.round("price", 4).alias("price"), "timestamp")


@register("impute_median", FX.cte("retail") + """
, m AS (SELECT median(price) AS v FROM retail WHERE price IS NOT NULL AND NOT isnan(price))
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price IS NULL OR isnan(price) THEN (SELECT v FROM m) ELSE price END, 4) AS price, timestamp FROM retail""")
def impute_median(spark, sf):
    return _retail_out(S.impute_missing(_view(spark, sf, "retail"), ["price"], "median"))


@register("impute_mean", FX.cte("retail") + """
, m AS (SELECT avg(price) AS v FROM retail WHERE price IS NOT NULL AND NOT isnan(price))
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price IS NULL OR isnan(price) THEN (SELECT v FROM m) ELSE price END, 4) AS price, timestamp FROM retail""")
def impute_mean(spark, sf):
    return _retail_out(S.impute_missing(_view(spark, sf, "retail"), ["price"], "mean"))


@register("impute_mode", FX.cte("retail") + """
, m AS (SELECT price AS v FROM retail WHERE price IS NOT NULL AND NOT isnan(price)
        GROUP BY price ORDER BY count(*) DESC, price ASC LIMIT 1)
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price IS NULL OR isnan(price) THEN (SELECT v FROM m) ELSE price END, 4) AS price, timestamp FROM retail""")
def impute_mode(spark, sf):
    return _retail_out(S.impute_missing(_view(spark, sf, "retail"), ["price"], "mode"))


@register("impute_constant", FX.cte("retail") + """
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price IS NULL OR isnan(price) THEN 0.0 ELSE price END, 4) AS price, timestamp FROM retail""")
def impute_constant(spark, sf):
    return _retail_out(S.impute_missing(_view(spark, sf, "retail"), ["price"], "constant", value=0.0))


@register("impute_median_by_category", FX.cte("retail") + """
, m AS (SELECT category AS cat, median(price) AS v FROM retail WHERE price IS NOT NULL AND NOT isnan(price) GROUP BY category)
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price IS NULL OR isnan(price) THEN m.v ELSE price END, 4) AS price, timestamp
FROM retail LEFT JOIN m ON retail.category IS NOT DISTINCT FROM m.cat""")
def impute_median_by_category(spark, sf):
    """C10a with per-group statistics (``by=``)."""
    return _retail_out(S.impute_missing(_view(spark, sf, "retail"), ["price"], "median", by=["category"]))


@register("impute_mode_multi", FX.cte("crm") + """
, me AS (SELECT email AS v FROM crm WHERE email IS NOT NULL GROUP BY email ORDER BY count(*) DESC, email ASC LIMIT 1),
 mp AS (SELECT phone AS v FROM crm WHERE phone IS NOT NULL GROUP BY phone ORDER BY count(*) DESC, phone ASC LIMIT 1)
SELECT row_id, customer_id, coalesce(email, (SELECT v FROM me)) AS email, coalesce(phone, (SELECT v FROM mp)) AS phone,
 age, signup_date, plan FROM crm""")
def impute_mode_multi(spark, sf):
    """C10c on two text columns at once (one stacked aggregate for both modes)."""
    return S.impute_missing(_view(spark, sf, "crm"), ["email", "phone"], "mode")


@register("sentinel_median_by_category", FX.cte("retail") + """
, m AS (SELECT category AS cat, median(price) AS v FROM retail WHERE price <> -1 AND NOT isnan(price) GROUP BY category)
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price = -1 THEN coalesce(m.v, 0.0) ELSE price END, 4) AS price, timestamp
FROM retail LEFT JOIN m ON retail.category IS NOT DISTINCT FROM m.cat""")
def sentinel_median_by_category(spark, sf):
    """C11 with per-group statistics (``by=``)."""
    return _retail_out(S.replace_sentinel(_view(spark, sf, "retail"), ["price"], -1, "median", by=["category"]))


@register("sentinel_median", FX.cte("retail") + """
, m AS (SELECT median(price) AS v FROM retail WHERE price <> -1 AND NOT isnan(price))
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price = -1 THEN coalesce((SELECT v FROM m), 0.0) ELSE price END, 4) AS price, timestamp FROM retail""")
def sentinel_median(spark, sf):
    return _retail_out(S.replace_sentinel(_view(spark, sf, "retail"), ["price"], -1, "median"))


@register("sentinel_mean", FX.cte("retail") + """
, m AS (SELECT avg(price) AS v FROM retail WHERE price <> -1 AND NOT isnan(price))
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price = -1 THEN coalesce((SELECT v FROM m), 0.0) ELSE price END, 4) AS price, timestamp FROM retail""")
def sentinel_mean(spark, sf):
    return _retail_out(S.replace_sentinel(_view(spark, sf, "retail"), ["price"], -1, "mean"))


@register("sentinel_constant", FX.cte("retail") + """
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price = -1 THEN 0.0 ELSE price END, 4) AS price, timestamp FROM retail""")
def sentinel_constant(spark, sf):
    return _retail_out(S.replace_sentinel(_view(spark, sf, "retail"), ["price"], -1, "constant"))


@register("sentinel_valid_median", FX.cte("retail") + """
, m AS (SELECT median(price) AS v FROM retail WHERE price <> -1 AND price > 0 AND NOT isnan(price))
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price = -1 THEN coalesce((SELECT v FROM m), 0.0) ELSE price END, 4) AS price, timestamp FROM retail""")
def sentinel_valid_median(spark, sf):
    """C11e: the statistic only over valid (> 0) values."""
    return _retail_out(S.replace_sentinel(_view(spark, sf, "retail"), ["price"], -1, "median",
                                          valid=lambda v: v > 0))


def _typed_sql(hole: str) -> str:
    """Integral, long beyond 2**53, decimal and float columns with ``hole`` in
    some cells, and a decimal column without; the same text in both dialects."""
    return f"""SELECT l_orderkey, l_linenumber,
 CASE WHEN l_orderkey % 7 = 0 THEN {hole} ELSE CAST(l_quantity AS INT) END AS qty,
 CASE WHEN l_orderkey % 11 = 0 THEN {hole} ELSE CAST(9007199254740993 AS BIGINT) + (l_orderkey % 5) * 2 END AS big,
 CASE WHEN l_orderkey % 13 = 0 THEN CAST({hole} AS DECIMAL(20,2)) ELSE CAST(l_extendedprice AS DECIMAL(20,2)) END AS price,
 CASE WHEN l_orderkey % 17 = 0 THEN CAST({hole} AS FLOAT) ELSE CAST(l_discount AS FLOAT) END AS disc,
 CAST(l_tax AS DECIMAL(20,2)) AS tax FROM lineitem"""


def _typed_view(spark: SparkSession, sf: str, hole: str) -> DataFrame:
    return spark.sql(_typed_sql(hole).replace("FROM lineitem", "FROM {li}"), li=load(spark, sf, "lineitem"))


def _typed_filled(bad: str) -> str:
    keep = lambda c: f"NOT ({bad.format(c=c)})"
    return f""", m AS (SELECT median(CAST(qty AS DOUBLE)) FILTER (WHERE {keep('qty')}) AS qty, median(CAST(big AS DOUBLE)) FILTER (WHERE {keep('big')}) AS big,
  median(CAST(price AS DOUBLE)) FILTER (WHERE {keep('price')}) AS price, median(CAST(disc AS DOUBLE)) FILTER (WHERE {keep('disc')}) AS disc FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN {bad.format(c='t.qty')} THEN m.qty ELSE CAST(t.qty AS DOUBLE) END AS qty,
 CASE WHEN {bad.format(c='t.big')} THEN CAST(CAST(m.big AS BIGINT) AS DECIMAL(28,8)) ELSE CAST(t.big AS DECIMAL(28,8)) END AS big,
 CASE WHEN {bad.format(c='t.price')} THEN CAST(m.price AS DECIMAL(26,8)) ELSE CAST(t.price AS DECIMAL(26,8)) END AS price,
 CASE WHEN {bad.format(c='t.disc')} THEN CAST(m.disc AS FLOAT) ELSE t.disc END AS disc, tax FROM t, m"""


def _exact(df: DataFrame) -> DataFrame:
    """Decimals as text: compared digit by digit."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("big", "price", "tax")})


def _exact_sql(sql: str) -> str:
    return f"SELECT * REPLACE (CAST(big AS VARCHAR) AS big, CAST(price AS VARCHAR) AS price, CAST(tax AS VARCHAR) AS tax) FROM ({sql})"


@register("impute_default_targets", _exact_sql(f"WITH t AS ({_typed_sql('NULL')})" + _typed_filled("{c} IS NULL")))
def impute_default_targets(spark, sf):
    """C10 without cols: every column with a missing cell; other cells and the
    whole column ``tax`` keep their exact values and type."""
    return _exact(S.impute_missing(_typed_view(spark, sf, "NULL")))


@register("sentinel_default_targets", _exact_sql(f"WITH t AS ({_typed_sql('-1')})" + _typed_filled("{c} = -1")))
def sentinel_default_targets(spark, sf):
    """C11a without cols: every column that holds the sentinel."""
    return _exact(S.replace_sentinel(_typed_view(spark, sf, "-1")))


@register("sentinel_unknown_strategy", FX.cte("retail") + """
, m AS (SELECT median(price) AS v FROM retail WHERE price IS NOT NULL AND NOT isnan(price) AND price <> -1)
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price = -1 THEN coalesce((SELECT v FROM m), 0.0) ELSE price END, 4) AS price, timestamp FROM retail""")
def sentinel_unknown_strategy(spark, sf):
    """C11d: an unknown strategy means median."""
    return _retail_out(S.replace_sentinel(_view(spark, sf, "retail"), ["price"], -1, "no_such_strategy"))


@register("impute_mode_decimal", """
WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(9 + o_orderkey % 4 AS DECIMAL(12,2)) END AS fee FROM orders),
 n AS (SELECT o_orderstatus, fee, count(*) AS c FROM o WHERE fee IS NOT NULL GROUP BY ALL),
 m AS (SELECT o_orderstatus, arg_min(fee, (-c, fee)) AS v FROM n GROUP BY 1)
SELECT o_orderkey, o_orderstatus, CAST(coalesce(fee, v) AS VARCHAR) AS fee FROM o LEFT JOIN m USING (o_orderstatus)""")
def impute_mode_decimal(spark, sf):
    """C10c over a decimal column, per group: ties go to the smaller number (9.00 before 10.00)."""
    fee = F.when(F.col("o_orderkey") % 3 != 0, (9 + F.col("o_orderkey") % 4).cast("decimal(12,2)"))
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", fee.alias("fee"))
    return S.impute_missing(df, ["fee"], "mode", by=["o_orderstatus"]).withColumn("fee", F.col("fee").cast("string"))


@register("lineitem_price_quantiles", """
SELECT l_returnflag, count(*) AS n,
 round(median(l_extendedprice), 4) AS median,
 round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
 round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag""")
def lineitem_price_quantiles(spark, sf):
    """Exact quantiles per group over the largest table (radix selection)."""
    li = load(spark, sf, "lineitem")
    q = exact_quantiles(li, "l_extendedprice", {"median": 0.5, "p10": 0.1, "p90": 0.9}, ["l_returnflag"],
                        median_names=("median",))
    return q.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("median", "p10", "p90")])


@register("lineitem_median", """
SELECT count(*) AS n, round(median(l_extendedprice), 4) AS median FROM lineitem WHERE l_extendedprice IS NOT NULL""")
def lineitem_median(spark, sf):
    """Whole-table exact median of 600k values at sf0.1 (the scale path of C10a)."""
    m = exact_median(load(spark, sf, "lineitem"), "l_extendedprice")
    return m.select("n", F.round("median", 4).alias("median"))


# ==================================================================== fills W1-W2

@register("ffill_global", FX.cte("retail") + """
SELECT row_id, transaction_id, category, quantity,
 round(last_value(price IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS price,
 timestamp FROM retail""")
def ffill_global(spark, sf):
    return _retail_out(W.forward_fill(_view(spark, sf, "retail"), ["price"], order_by="row_id",
                                      unique_order=True))


@register("ffill_partitioned", FX.cte("retail") + """
SELECT row_id, transaction_id, category, quantity,
 round(last_value(price IGNORE NULLS) OVER (PARTITION BY category ORDER BY row_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS price, timestamp FROM retail""")
def ffill_partitioned(spark, sf):
    return _retail_out(W.forward_fill(_view(spark, sf, "retail"), ["price"], order_by="row_id",
                                      partition_by=["category"], unique_order=True))


@register("bfill_global", FX.cte("retail") + """
SELECT row_id, transaction_id, category, quantity,
 round(first_value(price IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS price,
 timestamp FROM retail""")
def bfill_global(spark, sf):
    return _retail_out(W.backward_fill(_view(spark, sf, "retail"), ["price"], order_by="row_id",
                                       unique_order=True))


@register("ffill_events_value", """
SELECT event_id, user_id, event_type,
 last_value(CASE WHEN event_type = 'error' THEN NULL ELSE value END IGNORE NULLS)
   OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events""")
def ffill_events_value(spark, sf):
    """W1 on a timestamp order key, per user: error events carry the user's last value."""
    ev = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = ev.withColumn("value", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")))
    out = W.forward_fill(ev, ["value"], order_by=["ts", "event_id"], partition_by=["user_id"], unique_order=True)
    return out.select("event_id", "user_id", "event_type", "value")


@register("ffill_events_day", """
SELECT event_id, CAST(ts AS DATE) AS day,
 last_value(CASE WHEN event_type = 'error' THEN NULL ELSE value END IGNORE NULLS)
   OVER (ORDER BY CAST(ts AS DATE), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""")
def ffill_events_day(spark, sf):
    """W1 over a key with few values and a tie-break; the day as text is a key, too."""
    ev = load(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"),
                                          F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    text = ev.withColumn("day", F.col("day").cast("string"))
    out = W.forward_fill(text, ["value"], order_by=["day", "event_id"], unique_order=True)
    return out.withColumn("day", F.col("day").cast("date"))


@register("impute_ffill", FX.cte("retail") + """
SELECT row_id, transaction_id, category, quantity,
 round(last_value(price IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS price,
 timestamp FROM retail""")
def impute_ffill(spark, sf):
    """C10e through the operation, on the default block size."""
    return _retail_out(S.impute_missing(_view(spark, sf, "retail"), ["price"], "forward_fill", order_by="row_id"))


@register("impute_bfill_partitioned", FX.cte("retail") + """
SELECT row_id, transaction_id, category, quantity,
 round(first_value(price IGNORE NULLS) OVER (PARTITION BY category ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS price,
 timestamp FROM retail""")
def impute_bfill_partitioned(spark, sf):
    """C10f through the operation, within groups."""
    return _retail_out(S.impute_missing(_view(spark, sf, "retail"), ["price"], "backward_fill", order_by="row_id", by=["category"]))


@register("ffill_blocks_ties", """
SELECT l_shipdate, l_returnflag, l_linestatus, l_orderkey, l_linenumber,
 last_value(qty IGNORE NULLS) OVER (ORDER BY l_shipdate, l_returnflag, l_linestatus, l_orderkey, l_linenumber, qty NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty
FROM (SELECT *, CASE WHEN l_orderkey % 5 < 2 THEN l_quantity END AS qty FROM lineitem)""")
def ffill_blocks_ties(spark, sf):
    """W1 over blocks of 20,000 rows: few dates, ties go by the other columns."""
    df = load(spark, sf, "lineitem").select("l_shipdate", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber",
                                            F.when(F.col("l_orderkey") % 5 < 2, F.col("l_quantity")).alias("qty"))
    return W.forward_fill(df, ["qty"], order_by="l_shipdate", rows_per_block=20_000)


# ===================================================================== dedup C9

_EV = "event_id, ts, user_id, event_type, value, props"


@register("dedup_full", FX.cte("crm") + "SELECT DISTINCT * FROM crm")
def dedup_full(spark, sf):
    return D.deduplicate(_view(spark, sf, "crm"))


@register("dedup_first", f"""
SELECT {_EV} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def dedup_first(spark, sf):
    return D.deduplicate(load(spark, sf, "events"), ["user_id", "event_type"], "first", order_by="event_id")


@register("dedup_last", f"""
SELECT {_EV} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def dedup_last(spark, sf):
    return D.deduplicate(load(spark, sf, "events"), ["user_id", "event_type"], "last", order_by="event_id")


@register("dedup_none", f"""
SELECT {_EV} FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type, value) = 1""")
def dedup_none(spark, sf):
    """keep="none": every member of a duplicated (user, type, value) group is dropped."""
    return D.deduplicate(load(spark, sf, "events"), ["user_id", "event_type", "value"], "none")


@register("duplicate_rows_lineitem", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count FROM
 (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicate_rows_lineitem(spark, sf):
    """R5 on a key subset of the largest table."""
    return R.duplicate_count(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("dedup_removed", FX.cte("crm") + """
SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM crm)) AS rows_after,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM crm)) AS removed FROM crm""")
def dedup_removed(spark, sf):
    """Rows removed by full-row dedup."""
    crm = _view(spark, sf, "crm")
    return D.removed_rows(crm, D.deduplicate(crm))


# ============================================================ row-local C1-C8

_CRM_ALL = "row_id, customer_id, email, phone, age, signup_date, plan"
_PHONE_SQL = """CASE WHEN {c} IS NULL THEN NULL
 WHEN length(regexp_replace({c}, '\\D', '', 'g')) = 10 THEN '+1' || regexp_replace({c}, '\\D', '', 'g')
 WHEN length(regexp_replace({c}, '\\D', '', 'g')) = 11 AND starts_with(regexp_replace({c}, '\\D', '', 'g'), '1')
   THEN '+' || regexp_replace({c}, '\\D', '', 'g')
 ELSE {c} END"""


@register("phone_e164", FX.cte("crm") + f"""
SELECT row_id, customer_id, email, {_PHONE_SQL.format(c='phone')} AS phone, age, signup_date, plan FROM crm""")
def phone_e164(spark, sf):
    return C.standardize_phone(_view(spark, sf, "crm"))


@register("email_lower", FX.cte("crm") + """
SELECT row_id, customer_id, lower(email) AS email, phone, age, signup_date, plan FROM crm""")
def email_lower(spark, sf):
    return C.lowercase(_view(spark, sf, "crm"))


@register("phone_numeric", """
WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2125550000.0 + c_custkey WHEN 1 THEN 12125550000.0 + c_custkey
   WHEN 2 THEN 12.5 + c_custkey ELSE 77.0 END::DOUBLE AS d FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+1' || CAST(CAST(d AS BIGINT) AS VARCHAR) WHEN 1 THEN '+' || CAST(CAST(d AS BIGINT) AS VARCHAR)
   WHEN 2 THEN CAST(d AS VARCHAR) ELSE '77' END AS as_double,
 CASE c_custkey % 4 WHEN 0 THEN '+1' || CAST(CAST(d AS BIGINT) AS VARCHAR) WHEN 1 THEN '+' || CAST(CAST(d AS BIGINT) AS VARCHAR)
   WHEN 2 THEN CAST(CAST(d AS DECIMAL(14,2)) AS VARCHAR) ELSE '77' END AS as_decimal,
 CASE c_custkey % 4 WHEN 0 THEN '+1' || CAST(CAST(d AS BIGINT) AS VARCHAR) WHEN 1 THEN '+' || CAST(CAST(d AS BIGINT) AS VARCHAR)
   ELSE CAST(CAST(floor(d) AS BIGINT) AS VARCHAR) END AS as_long FROM t""")
def phone_numeric(spark, sf):
    """C1 on numbers: whole ones of 10 or 11 digits are phones, others stay as they are."""
    k = F.col("c_custkey")
    d = (F.when(k % 4 == 0, k + F.lit(2125550000.0)).when(k % 4 == 1, k + F.lit(12125550000.0))
         .when(k % 4 == 2, k + F.lit(12.5)).otherwise(F.lit(77.0)))
    df = load(spark, sf, "customer").select(k, d.alias("as_double"), d.cast("decimal(14,2)").alias("as_decimal"), F.floor(d).cast("long").alias("as_long"))
    return C.standardize_phone(df, ["as_double", "as_decimal", "as_long"])


@register("clamp_types", """
WITH t AS (SELECT o_orderkey, 9007199254740993 + CAST(o_orderkey AS BIGINT) AS big, CAST(123456789012345678.91 AS DECIMAL(20,2)) + o_orderkey AS money,
  CAST(o_orderkey % 100 AS TINYINT) AS tiny, CAST(o_orderkey AS INTEGER) AS whole FROM orders)
SELECT o_orderkey, CAST(CAST(big AS DECIMAL(28,8)) AS VARCHAR) AS big, CAST(CAST(least(money, 123456789012346000.50) AS DECIMAL(20,2)) AS VARCHAR) AS money,
 CAST(greatest(tiny, 7) AS INTEGER) AS tiny, greatest(CAST(whole AS DOUBLE), 40.5) AS whole FROM t""")
def clamp_types(spark, sf):
    """C3 by type: no digit of a long or a decimal is lost, a bound beyond a
    tinyint is none, and a bound with a fraction widens an integer."""
    k = F.col("o_orderkey")
    df = load(spark, sf, "orders").select(
        k, (k.cast("long") + F.lit(9007199254740993)).alias("big"), (F.lit("123456789012345678.91").cast("decimal(20,2)") + k).cast("decimal(20,2)").alias("money"),
        (k % 100).cast("tinyint").alias("tiny"), k.cast("int").alias("whole"))
    df = C.clamp_range(C.clamp_range(df, ["big"], min_val=0.5), ["money"], max_val=decimal.Decimal("123456789012346000.50"))
    df = C.clamp_range(C.clamp_range(df, ["tiny"], 7, 1000), ["whole"], min_val=40.5)
    return df.withColumns({"big": F.col("big").cast("string"), "money": F.col("money").cast("string"), "tiny": F.col("tiny").cast("int")})


@register("fill_blank_numeric", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 2.5 ELSE CAST(l_linenumber AS DOUBLE) END AS whole,
 CASE WHEN l_orderkey % 5 = 0 THEN '2.50000000' ELSE CAST(CAST(9007199254740993 + l_orderkey AS DECIMAL(28,8)) AS VARCHAR) END AS big,
 CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE CAST(l_linenumber AS INTEGER) END AS kept FROM lineitem""")
def fill_blank_numeric(spark, sf):
    """C7 with a number: the cell takes exactly that number, the others keep all digits."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    df = load(spark, sf, "lineitem").select(k, n, F.when(k % 7 != 0, n.cast("int")).alias("whole"), F.when(k % 5 != 0, k.cast("long") + F.lit(9007199254740993)).alias("big"),
                                            F.when(k % 3 != 0, n.cast("int")).alias("kept"))
    out = C.fill_blank(C.fill_blank(df, ["whole", "big"], 2.5), ["kept"], 7)
    return out.withColumn("big", F.col("big").cast("string"))


@register("age_clamp", FX.cte("crm") + """
SELECT row_id, customer_id, email, phone,
 CASE WHEN age IS NULL OR isnan(age) THEN NULL ELSE least(greatest(age, 18.0), 100.0) END AS age, signup_date, plan FROM crm""")
def age_clamp(spark, sf):
    return C.clamp_range(_view(spark, sf, "crm"), ["age"], 18, 100)


_CODE_SQL = """CASE WHEN {c} IS NULL THEN NULL
 WHEN regexp_matches(d, '^[A-Z]\\d{{2}}(\\.\\d{{1,2}})?$') THEN d ELSE {c} END"""
_CODE_PREP = """(SELECT *, CASE WHEN regexp_matches(s, '^[A-Z]\\d{3,4}$')
   THEN regexp_replace(s, '^([A-Z]\\d{2})(\\d{1,2})$', '\\1.\\2') ELSE s END AS d
 FROM (SELECT *, replace(upper(regexp_replace(icd10_code, '^\\s+|\\s+$', '', 'g')), ' ', '') AS s FROM emr))"""
_EMR_ALL = "row_id, patient_id, dob, admission_date, discharge_date, diagnosis, icd10_code, dosage_mg, ward"


@register("code_format", FX.cte("emr") + f"""
SELECT row_id, patient_id, dob, admission_date, discharge_date, diagnosis,
 {_CODE_SQL.format(c='icd10_code')} AS icd10_code, dosage_mg, ward FROM {_CODE_PREP}""")
def code_format(spark, sf):
    return C.fix_code_format(_view(spark, sf, "emr"))


@register("abs_dosage", FX.cte("emr") + """
SELECT row_id, patient_id, dob, admission_date, discharge_date, diagnosis, icd10_code,
 CASE WHEN dosage_mg < 0 THEN abs(dosage_mg) ELSE dosage_mg END AS dosage_mg, ward FROM emr""")
def abs_dosage(spark, sf):
    return C.abs_negative(_view(spark, sf, "emr"))


@register("fill_blank", FX.cte("emr") + f"""
SELECT row_id, CASE WHEN {_blank_sql('patient_id')} THEN 'UNKNOWN' ELSE patient_id END AS patient_id,
 dob, admission_date, discharge_date,
 CASE WHEN {_blank_sql('diagnosis')} THEN 'UNKNOWN' ELSE diagnosis END AS diagnosis,
 icd10_code, dosage_mg, ward FROM emr""")
def fill_blank(spark, sf):
    return C.fill_blank(_view(spark, sf, "emr"), ["patient_id", "diagnosis"])


def _dates_as_text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


_D = "try_strptime({c}, '%Y-%m-%d')::DATE"


@register("date_swap", FX.cte("emr") + f"""
, p AS (SELECT *, {_D.format(c='dob')} AS s, {_D.format(c='admission_date')} AS e FROM emr)
SELECT row_id, patient_id, CAST(CASE WHEN s > e THEN e ELSE s END AS VARCHAR) AS dob,
 CAST(CASE WHEN s > e THEN s ELSE e END AS VARCHAR) AS admission_date, discharge_date, diagnosis, icd10_code, dosage_mg, ward
FROM p""")
def date_swap(spark, sf):
    out = C.fix_date_order(_view(spark, sf, "emr"), "dob", "admission_date", "swap")
    return _dates_as_text(out, "dob", "admission_date")


@register("date_null_start", FX.cte("emr") + f"""
, p AS (SELECT *, {_D.format(c='dob')} AS s, {_D.format(c='admission_date')} AS e FROM emr)
SELECT row_id, patient_id, CAST(CASE WHEN s > e THEN NULL ELSE s END AS VARCHAR) AS dob,
 CAST(e AS VARCHAR) AS admission_date, discharge_date, diagnosis, icd10_code, dosage_mg, ward FROM p""")
def date_null_start(spark, sf):
    out = C.fix_date_order(_view(spark, sf, "emr"), "dob", "admission_date", "null_dob")
    return _dates_as_text(out, "dob", "admission_date")


@register("discharge_repair", FX.cte("emr") + f"""
, p AS (SELECT *, {_D.format(c='admission_date')} AS s, {_D.format(c='discharge_date')} AS e FROM emr)
SELECT row_id, patient_id, dob, CAST(CASE WHEN s > e THEN e ELSE s END AS VARCHAR) AS admission_date,
 CAST(CASE WHEN s > e THEN s ELSE e END AS VARCHAR) AS discharge_date, diagnosis, icd10_code, dosage_mg, ward FROM p""")
def discharge_repair(spark, sf):
    """The generic date-pair repair on admission/discharge."""
    out = C.fix_date_order(_view(spark, sf, "emr"), "admission_date", "discharge_date", "swap")
    return _dates_as_text(out, "admission_date", "discharge_date")


@register("drop_columns", FX.cte("emr") + """
SELECT row_id, patient_id, dob, admission_date, discharge_date, icd10_code, dosage_mg FROM emr""")
def drop_columns(spark, sf):
    return C.drop_columns(_view(spark, sf, "emr"), ["diagnosis", "ward", "no_such_column"])


_PHONE_RX = r"\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
_EMAIL_RX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@register("doc_contacts_clean", f"""
WITH p AS (SELECT doc_id, 'phone' AS kind, unnest(regexp_extract_all(text, '{_PHONE_RX}')) AS raw FROM documents),
 e AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '{_EMAIL_RX}')) AS raw FROM documents)
SELECT doc_id, kind, raw, {_PHONE_SQL.format(c='raw')} AS clean FROM p
UNION ALL SELECT doc_id, kind, raw, lower(raw) AS clean FROM e""")
def doc_contacts_clean(spark, sf):
    """C1/C2 on contacts pulled out of whole document texts."""
    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), lambda raw: F.struct(F.lit(kind).alias("kind"), raw.alias("raw")))

    both = F.concat(found("phone", _PHONE_RX), found("email", _EMAIL_RX))
    raw = load(spark, sf, "documents").select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.kind", "x.raw")
    clean = F.when(F.col("kind") == "phone", C.phone_e164_expr(F.col("raw"))).otherwise(F.lower("raw"))
    return raw.withColumn("clean", clean)


# =================================================================== profile

def _profile_sql(table: str, cols: list[tuple[str, bool]], src: str = "") -> str:
    parts = []
    for i, (c, is_float) in enumerate(cols):
        miss = f"{c} IS NULL" + (f" OR isnan({c})" if is_float else "")
        parts.append(f"SELECT {i} AS position, '{c}' AS column, count(*) FILTER (WHERE {miss}) AS null_count,"
                     f" round(count(*) FILTER (WHERE {miss}) / greatest(count(*), 1) * 100.0, 2) AS null_pct,"
                     f" count(DISTINCT CASE WHEN {miss} THEN NULL ELSE {c} END) AS unique_count FROM {table}")
    return src + "\nUNION ALL ".join(parts)


@register("profile_retail", _profile_sql("retail", [("row_id", False), ("transaction_id", False), ("category", False),
                                                   ("quantity", False), ("price", True), ("timestamp", False)],
                                         FX.cte("retail")))
def profile_retail(spark, sf):
    return P.profile(_view(spark, sf, "retail")).select("position", "column", "null_count", "null_pct", "unique_count")


@register("profile_lineitem", _profile_sql("lineitem", [
    ("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False), ("l_linenumber", False),
    ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
    ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False)]))
def profile_lineitem(spark, sf):
    return P.profile(load(spark, sf, "lineitem")).select("position", "column", "null_count", "null_pct", "unique_count")


@register("sample_rows", FX.cte("retail") + """
SELECT coalesce(CAST(row_id AS VARCHAR), 'NULL') AS row_id, coalesce(transaction_id, 'NULL') AS transaction_id,
 coalesce(category, 'NULL') AS category, coalesce(CAST(quantity AS VARCHAR), 'NULL') AS quantity,
 coalesce(CAST(price AS VARCHAR), 'NULL') AS price, coalesce(timestamp, 'NULL') AS timestamp
FROM retail ORDER BY retail.row_id LIMIT 5""")
def sample_rows(spark, sf):
    """P5: the first five rows by key, missing shown as NULL (a top-k report)."""
    return P.sample_rows(_view(spark, sf, "retail"), "row_id")


@register("sample_values", FX.cte("emr") + """
, t AS (SELECT 'diagnosis' AS "column", diagnosis AS v, row_id FROM emr WHERE diagnosis IS NOT NULL
        UNION ALL SELECT 'icd10_code', icd10_code, row_id FROM emr WHERE icd10_code IS NOT NULL
        UNION ALL SELECT 'patient_id', patient_id, row_id FROM emr WHERE patient_id IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_id) AS rn FROM t)
SELECT "column", string_agg(v, '|' ORDER BY row_id) AS sample_values FROM r WHERE rn <= 5 GROUP BY 1""")
def sample_values(spark, sf):
    """The first five non-missing values of each column by key (a top-k report)."""
    sv = P.sample_values(_view(spark, sf, "emr"), "row_id", 5, cols=["diagnosis", "icd10_code", "patient_id"])
    return sv.select("column", F.array_join("sample_values", "|").alias("sample_values"))


@register("profile_ntz", """
SELECT 'at' AS "column", 'timestamp_ntz' AS dtype, count(*) FILTER (WHERE "at" IS NULL) AS null_count, count(DISTINCT "at") AS unique_count
FROM (SELECT TIMESTAMP '2024-03-10 00:00:00' + to_minutes(CAST((epoch_ms(ts) // 1000) % 360 AS INT)) AS "at" FROM events)""")
def profile_ntz(spark, sf):
    """P3 over wall-clock times, some of which a session zone would skip."""
    ev = load(spark, sf, "events")
    minute = F.floor(X.micros(F.col("ts"), ev.schema["ts"].dataType) / F.lit(1_000_000)) % 360
    at = F.lit("2024-03-10 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))
    prof = P.profile(ev.select(at.alias("at")))
    return prof.select("column", "dtype", "null_count", "unique_count")


@register("full_report_retail", FX.cte("retail") + f"""
, c AS (SELECT {_RETAIL_COUNTS} FROM retail), s AS (SELECT *, {_RETAIL_SCORE} AS sc FROM c)
SELECT rows, missing_count, sentinel_count, round(sc, 6) AS score,
 (SELECT count(DISTINCT category) FROM retail) AS category_unique, 'string' AS category_dtype,
 (SELECT string_agg(category, '|' ORDER BY row_id) FROM (SELECT category, row_id FROM retail WHERE category IS NOT NULL ORDER BY row_id LIMIT 5)) AS category_samples,
 (SELECT string_agg(coalesce(transaction_id, 'NULL'), '|' ORDER BY row_id) FROM (SELECT transaction_id, row_id FROM retail ORDER BY row_id LIMIT 5)) AS first_rows
FROM s""")
def full_report_retail(spark, sf):
    """The full record, with types, samples and first rows."""
    rec = P.full_report(_view(spark, sf, "retail"), Q.retail_suite(), "row_id")
    cat = F.filter("column_stats", lambda c: c["column"] == "category")[0]
    return rec.select("rows", "missing_count", "sentinel_count", F.round("score", 6).alias("score"), cat["unique_count"].alias("category_unique"),
                      cat["dtype"].alias("category_dtype"), F.array_join(cat["sample_values"], "|").alias("category_samples"),
                      F.array_join(F.transform("sample_rows", lambda r: r["transaction_id"]), "|").alias("first_rows"))


@register("custom_suite_orders", """
WITH c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE o_totalprice > 200000) AS too_dear, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders)
SELECT rows, too_dear, pending, count(*) FILTER (WHERE false) AS gone, too_dear + pending AS total_defects,
 round(0.6 * (1.0 - too_dear / greatest(rows, 1)) + 0.2 * (1.0 - pending / greatest(rows, 1)) + 0.2, 6) AS score FROM c GROUP BY ALL""")
def custom_suite_orders(spark, sf):
    """Q8: a suite of user rules, one of them over a column that is not there."""
    suite = Q.Suite("orders", (Q.Weighted(R.custom("too_dear", F.col("o_totalprice") > 200000, ["o_totalprice"]), 3.0),
                               Q.Weighted(R.custom("pending", lambda d: d["o_orderstatus"] == "P", ["o_orderstatus"]), 1.0),
                               Q.Weighted(R.custom("gone", F.col("zz") > 0, ["zz"]), 1.0)), 0.5, 0.9, clip=None)
    s = Q.score(load(spark, sf, "orders"), suite)
    return s.select("rows", "too_dear", "pending", "gone", "total_defects", F.round("score", 6).alias("score"))


@register("shape_orders", """
SELECT count(*) AS rows, 6 AS n_columns FROM orders""")
def shape_orders(spark, sf):
    """Row and column counts."""
    return P.shape(load(spark, sf, "orders")).select("rows", F.col("n_columns"))


# ================================================================ plans G1-G4

@register("plan_crm", FX.cte("crm") + f"""
, d AS (SELECT DISTINCT * FROM crm)
SELECT row_id, customer_id, lower(email) AS email, {_PHONE_SQL.format(c='phone')} AS phone,
 CASE WHEN age IS NULL OR isnan(age) THEN NULL ELSE least(greatest(age, 18.0), 100.0) END AS age, signup_date, plan FROM d""")
def plan_crm(spark, sf):
    steps = [{"operation": "deduplicate"},
             {"operation": "standardize_phone", "target_columns": "phone"},
             {"operation": "lowercase_email"},
             {"operation": "clamp_range", "target_columns": ["age"], "params": {"min_val": 18, "max_val": 100}},
             {"operation": "validate"}]
    return G.apply_plan(_view(spark, sf, "crm"), steps)


@register("plan_emr", FX.cte("emr") + f"""
, a AS (SELECT *, {_D.format(c='dob')} AS s, {_D.format(c='admission_date')} AS e FROM emr),
 b AS (SELECT row_id, patient_id, CASE WHEN s > e THEN e ELSE s END AS dob, CASE WHEN s > e THEN s ELSE e END AS adm,
   discharge_date, diagnosis, icd10_code, dosage_mg, ward FROM a),
 c AS (SELECT *, replace(upper(regexp_replace(icd10_code, '^\\s+|\\s+$', '', 'g')), ' ', '') AS s2 FROM b),
 d AS (SELECT *, CASE WHEN regexp_matches(s2, '^[A-Z]\\d{{3,4}}$')
   THEN regexp_replace(s2, '^([A-Z]\\d{{2}})(\\d{{1,2}})$', '\\1.\\2') ELSE s2 END AS d2 FROM c)
SELECT row_id, CASE WHEN {_blank_sql('patient_id')} THEN 'UNKNOWN' ELSE patient_id END AS patient_id,
 CAST(dob AS VARCHAR) AS dob, CAST(adm AS VARCHAR) AS admission_date, discharge_date,
 CASE WHEN {_blank_sql('diagnosis')} THEN 'UNKNOWN' ELSE diagnosis END AS diagnosis,
 CASE WHEN icd10_code IS NULL THEN NULL WHEN regexp_matches(d2, '^[A-Z]\\d{{2}}(\\.\\d{{1,2}})?$') THEN d2 ELSE icd10_code END AS icd10_code,
 CASE WHEN dosage_mg < 0 THEN abs(dosage_mg) ELSE dosage_mg END AS dosage_mg, ward FROM d""")
def plan_emr(spark, sf):
    steps = [{"operation": "fix_date_order", "params": {"mode": "swap"}},
             {"operation": "fix_icd10"},
             {"operation": "fix_negative_dosage"},
             {"operation": "fill_mandatory", "target_columns": ["patient_id", "diagnosis"]}]
    out = G.apply_plan(_view(spark, sf, "emr"), steps)
    return _dates_as_text(out, "dob", "admission_date")


_LEDGER_SQL = FX.cte("retail") + """
, s0 AS (SELECT * FROM retail),
 m1 AS (SELECT median(price) AS v FROM s0 WHERE price <> -1 AND NOT isnan(price)),
 s1 AS (SELECT row_id, transaction_id, category, quantity,
   CASE WHEN price = -1 THEN coalesce((SELECT v FROM m1), 0.0) ELSE price END AS price, timestamp FROM s0),
 m2 AS (SELECT median(price) AS v FROM s1 WHERE price IS NOT NULL AND NOT isnan(price)),
 s2 AS (SELECT row_id, transaction_id, category, quantity,
   CASE WHEN price IS NULL OR isnan(price) THEN (SELECT v FROM m2) ELSE price END AS price, timestamp FROM s1),
 c AS (SELECT 0 AS step, 'initial' AS operation, count(*) AS rows, count(*) FILTER (WHERE price IS NULL OR isnan(price)) AS a,
        count(*) FILTER (WHERE price = -1) AS b, count(*) FILTER (WHERE price <= 0) AS z, CAST(0 AS BIGINT) AS affected FROM s0
       UNION ALL SELECT 1, 'replace_sentinel', count(*), count(*) FILTER (WHERE price IS NULL OR isnan(price)),
        count(*) FILTER (WHERE price = -1), count(*) FILTER (WHERE price <= 0),
        (SELECT count(*) FROM s0 WHERE price = -1) FROM s1
       UNION ALL SELECT 2, 'impute_missing', count(*), count(*) FILTER (WHERE price IS NULL OR isnan(price)),
        count(*) FILTER (WHERE price = -1), count(*) FILTER (WHERE price <= 0),
        (SELECT count(*) FROM s1 WHERE price IS NULL OR isnan(price)) FROM s2),
 d AS (SELECT *, CAST(a + b + z AS BIGINT) AS defects_after,
   greatest(least(0.5 * (1.0 - a / greatest(rows, 1)) + 0.3 * (1.0 - b / greatest(rows, 1)) + 0.2 * (1.0 - z / greatest(rows, 1)), 0.999), 0.001) AS sc FROM c)
SELECT step, operation, rows, lag(defects_after) OVER (ORDER BY step) AS defects_before, defects_after,
 round(sc, 6) AS score, sc >= 0.70 AS passed,
 CASE WHEN first_value(defects_after) OVER (ORDER BY step) > 0
   THEN round((first_value(defects_after) OVER (ORDER BY step) - defects_after) / first_value(defects_after) OVER (ORDER BY step) * 100.0, 2)
   ELSE 0.0 END AS reduction_pct, affected
FROM d"""


@register("ledger_retail", _LEDGER_SQL)
def ledger_retail(spark, sf):
    """Sentinels first, then nulls; one ledger row per step."""
    steps = [{"operation": "replace_sentinel", "target_columns": ["price"], "params": {"sentinel": -1}},
             {"operation": "impute_missing", "target_columns": ["price"], "params": {"strategy": "median"}}]
    _, led = G.ledger(_view(spark, sf, "retail"), steps, Q.retail_suite())
    return led.select("step", "operation", "rows", "defects_before", "defects_after",
                      F.round("score", 6).alias("score"), "passed", "reduction_pct", "affected")


@register("ledger_int_column", """
WITH t AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS qty, l_returnflag FROM lineitem)
SELECT * FROM (
 SELECT 0 AS step, 'initial' AS operation, CAST(0 AS BIGINT) AS affected, count(*) FILTER (WHERE qty IS NULL) AS defects_after, false AS failed FROM t
 UNION ALL SELECT 1, 'deduplicate', 0, count(*) FILTER (WHERE qty IS NULL), true FROM t
 UNION ALL SELECT 2, 'clamp_range', 0, count(*) FILTER (WHERE qty IS NULL), true FROM t
 UNION ALL SELECT 3, 'impute_missing', count(*) FILTER (WHERE qty IS NULL), count(*) FILTER (WHERE false), false FROM t)""")
def ledger_int_column(spark, sf):
    """Only filled cells of an integral column count as changed; steps
    that cannot run leave an error row and the table as it is."""
    qty = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity").cast("int"))
    df = load(spark, sf, "lineitem").select(qty.alias("qty"), "l_returnflag")
    suite = Q.Suite("nulls", (Q.Weighted(R.null_values("qty")),), 0.7, 0.95)
    steps = [{"operation": "deduplicate", "target_columns": ["no_such_column"]},
             {"operation": "clamp_range", "target_columns": ["l_returnflag"], "params": {"min_val": 0, "max_val": 1}},
             {"operation": "impute_missing", "target_columns": ["qty"], "params": {"strategy": "median"}}]
    _, led = G.ledger(df, steps, suite)
    return led.select("step", "operation", "affected", "defects_after", F.col("error").isNotNull().alias("failed"))


@register("ledger_runs", _LEDGER_SQL.replace("SELECT step, operation, rows, lag", "SELECT r.run_id, step, operation, rows, lag").replace(
    "OVER (ORDER BY step)", "OVER (PARTITION BY r.run_id ORDER BY step)") + ", (SELECT unnest(['a', 'b']) AS run_id) r")
def ledger_runs(spark, sf):
    """Two runs in one table; run a is written again and adds nothing."""
    from .session import scratch_path
    steps = [{"operation": "replace_sentinel", "target_columns": ["price"], "params": {"sentinel": -1}},
             {"operation": "impute_missing", "target_columns": ["price"], "params": {"strategy": "median"}}]
    path = scratch_path(spark, "ledger-table")
    _, led = G.ledger(_view(spark, sf, "retail"), steps, Q.retail_suite())
    G.append_ledger(led.where("step < 2"), path, "a")  # a run that was cut off
    for run in ("a", "b", "a"):
        G.append_ledger(led, path, run)
    return G.read_ledger(spark, path).select("run_id", "step", "operation", "rows", "defects_before", "defects_after",
                                             F.round("score", 6).alias("score"), "passed", "reduction_pct", "affected")


@register("ledger_segments", FX.cte("crm") + f"""
, s1 AS (SELECT row_id, customer_id, lower(email) AS email, phone, age, signup_date, plan FROM crm),
 s2 AS (SELECT row_id, customer_id, email, phone, CASE WHEN age IS NOT NULL THEN greatest(least(age, 100), 18) END AS age, signup_date, plan FROM s1),
 s3 AS (SELECT DISTINCT * FROM s2),
 c AS (SELECT 0 AS step, 'initial' AS operation, count(*) AS rows, {_CRM_DUPS.format(t='crm')} AS d,
   count(*) FILTER (WHERE phone IS NOT NULL AND NOT regexp_matches(phone, '^\\+1\\d{{10}}$')) AS p, count(*) FILTER (WHERE email <> lower(email)) AS e,
   count(*) FILTER (WHERE age < 18 OR age > 100) AS a, 0 AS affected FROM crm
  UNION ALL SELECT 1, 'lowercase_email', count(*), {_CRM_DUPS.format(t='s1')}, count(*) FILTER (WHERE phone IS NOT NULL AND NOT regexp_matches(phone, '^\\+1\\d{{10}}$')),
   0, count(*) FILTER (WHERE age < 18 OR age > 100), (SELECT count(*) FROM crm WHERE email <> lower(email)) FROM s1
  UNION ALL SELECT 2, 'clamp_range', count(*), {_CRM_DUPS.format(t='s2')}, count(*) FILTER (WHERE phone IS NOT NULL AND NOT regexp_matches(phone, '^\\+1\\d{{10}}$')),
   0, 0, (SELECT count(*) FROM s1 WHERE age < 18 OR age > 100) FROM s2
  UNION ALL SELECT 3, 'deduplicate', count(*), 0, count(*) FILTER (WHERE phone IS NOT NULL AND NOT regexp_matches(phone, '^\\+1\\d{{10}}$')),
   0, 0, (SELECT count(*) FROM s2) - count(*) FROM s3)
SELECT step, operation, rows, CAST(d + p + e + a AS BIGINT) AS defects_after, CAST(affected AS BIGINT) AS affected FROM c""")
def ledger_segments(spark, sf):
    """Two row-local steps observed in one write, then one that shuffles."""
    steps = [{"operation": "lowercase_email"}, {"operation": "clamp_range", "target_columns": ["age"], "params": {"min_val": 18, "max_val": 100}},
             {"operation": "deduplicate"}]
    _, led = G.ledger(_view(spark, sf, "crm"), steps, Q.crm_suite())
    return led.select("step", "operation", "rows", "defects_after", "affected")


@register("export_refused", FX.cte("retail") + """
SELECT 'refused' AS outcome, false AS there, count(*) AS rows, count(*) FILTER (WHERE price IS NULL OR isnan(price)) AS price_null_count FROM retail""")
def export_refused(spark, sf):
    """A gate that fails: the counts of the write that was thrown away, and nothing at the place."""
    from .session import exists, scratch_path
    from .sources.io import GateFailed, export
    suite = Q.retail_suite()
    strict = Q.Suite("strict", suite.rules, 0.9999, 0.99999, required=suite.required)
    path, retail = scratch_path(spark, "export-refused"), _view(spark, sf, "retail")
    try:
        export(retail, path, suite=strict)
        outcome = "written"
    except GateFailed:
        outcome = "refused"
    counts = Q.rule_counts(retail, strict).select("rows", "price_null_count")
    return counts.select(F.lit(outcome).alias("outcome"), F.lit(exists(spark, path)).alias("there"), "rows", "price_null_count")


@register("export_manifest", """
SELECT c_mktsegment, count(*) AS rows, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_mktsegment""")
def export_manifest(spark, sf):
    """S2 by manifest: a second version takes the place of the first; readers follow the manifest."""
    from .session import scratch_path
    from .sources.io import export, read_published
    df = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    path, suite = scratch_path(spark, "export-manifest"), Q.Suite("keys", (Q.Weighted(R.null_values("c_custkey")),), 0.5, 0.9)
    export(df, path, suite=suite, publish="manifest")
    export(df.where("c_custkey % 2 = 0"), path, mode="overwrite", suite=suite, publish="manifest")
    return read_published(spark, path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def _broken_csv(spark: SparkSession, sf: str) -> str:
    """customer as CSV text, some records with a word for a number, a field too many or one too few."""
    from .session import scratch_path
    k = F.col("c_custkey")
    good = F.concat_ws(",", k.cast("string"), F.col("c_mktsegment"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    line = (F.when(k % 10 == 1, F.concat_ws(",", k.cast("string"), F.col("c_mktsegment"), F.lit("n/a"))).when(k % 10 == 2, F.concat(good, F.lit(",more")))
            .when(k % 10 == 3, F.concat_ws(",", k.cast("string"), F.col("c_mktsegment"))).otherwise(good))
    path = scratch_path(spark, "broken-csv")
    load(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return path


@register("read_malformed_csv", """
SELECT c_custkey, CASE WHEN c_custkey % 10 IN (1, 3) THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) END AS balance,
 CASE WHEN c_custkey % 10 IN (1, 2, 3) THEN 'malformed_record'
   WHEN c_acctbal < 0 THEN 'negative_balance' ELSE '' END AS failed, c_custkey % 10 IN (1, 2, 3) AS has_record
FROM customer""")
def read_malformed_csv(spark, sf):
    """CSV under a declared schema; records that do not fit are flagged and kept as text."""
    from .sources.io import read_permissive
    rows = read_permissive(spark, _broken_csv(spark, sf), "c_custkey long, c_mktsegment string, balance decimal(12,2)")
    negative = F.when((F.size("failed_rules") == 0) & (F.col("balance") < 0), "negative_balance")
    failed = F.array_compact(F.array_append("failed_rules", negative))
    return rows.select("c_custkey", F.col("balance").cast("string").alias("balance"), F.array_join(failed, ",").alias("failed"), F.col("record").isNotNull().alias("has_record"))


@register("profile_schema_check", """
SELECT * FROM (VALUES ('spoiled', 'unique_count', 'missing'), ('spoiled', 'null_count', 'type'), ('spoiled', 'note', 'unknown'),
 ('spoiled', 'l_tax', 'bounds'), ('spoiled', 'l_discount', 'bounds')) AS t(report, field, problem)""")
def profile_schema_check(spark, sf):
    """A profile as it is built breaks neither the output schema nor the bounds of
    its figures; a spoiled one shows where it does."""
    whole = P.profile(load(spark, sf, "lineitem"), order_by=["l_orderkey", "l_linenumber"])
    spoiled = (whole.drop("unique_count").withColumn("null_count", F.when(F.col("column") == "l_tax", -1).otherwise(F.col("null_count")).cast("int"))
               .withColumn("null_pct", F.when(F.col("column") == "l_discount", 150.0).otherwise(F.col("null_pct"))).withColumn("note", F.lit("x")))
    out = []
    for name, prof in (("as built", whole), ("spoiled", spoiled)):
        bounds = P.profile_violations(prof.withColumn("unique_count", F.lit(0)) if "unique_count" not in prof.columns else prof)
        out += [P.schema_violations(prof).select(F.lit(name).alias("report"), "field", "problem"),
                bounds.select(F.lit(name).alias("report"), F.col("column").alias("field"), F.lit("bounds").alias("problem"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@register("export_gated", FX.cte("retail") + """
, m1 AS (SELECT median(price) AS v FROM retail WHERE price <> -1 AND NOT isnan(price)),
 s1 AS (SELECT row_id, transaction_id, category, quantity,
   CASE WHEN price = -1 THEN coalesce((SELECT v FROM m1), 0.0) ELSE price END AS price, timestamp FROM retail),
 m2 AS (SELECT median(price) AS v FROM s1 WHERE price IS NOT NULL AND NOT isnan(price))
SELECT row_id, transaction_id, category, quantity,
 round(CASE WHEN price IS NULL OR isnan(price) THEN (SELECT v FROM m2) ELSE price END, 4) AS price, timestamp FROM s1""")
def export_gated(spark, sf):
    """Clean, score, write only if the gate passes (partitioned by category), read back."""
    from .session import scratch_path
    from .sources.io import export
    retail = _view(spark, sf, "retail")
    clean = S.impute_missing(S.replace_sentinel(retail, ["price"], -1, "median"), ["price"], "median")
    path = scratch_path(spark, "export-retail")
    export(clean, path, mode="overwrite", partition_by=["category"], suite=Q.retail_suite())
    return _retail_out(spark.read.parquet(path))


# ================================================================ quarantine R16

@register("quarantine_emr", FX.cte("emr") + f"""
, f AS (SELECT row_id, concat_ws(',',
   CASE WHEN try_strptime(dob, '%Y-%m-%d') > try_strptime(admission_date, '%Y-%m-%d') THEN 'date_order_violations' END,
   CASE WHEN NOT regexp_matches(coalesce(icd10_code, ''), '^[A-Z]\\d{{2}}\\.\\d{{1,2}}$') THEN 'icd10_format_errors' END,
   CASE WHEN dosage_mg < 0 THEN 'negative_dosage_count' END,
   CASE WHEN {_blank_sql('patient_id')} OR {_blank_sql('diagnosis')} THEN 'blank_mandatory_count' END,
   CASE WHEN try_strptime(admission_date, '%Y-%m-%d') > try_strptime(discharge_date, '%Y-%m-%d') THEN 'cross_column_violations' END
 ) AS failed_rules FROM emr)
SELECT row_id, failed_rules FROM f WHERE failed_rules <> ''""")
def quarantine_emr(spark, sf):
    bad = QR.quarantine(_view(spark, sf, "emr"), Q.emr_suite())
    return bad.select("row_id", F.array_join("failed_rules", ",").alias("failed_rules"))


@register("quarantine_crm", FX.cte("crm") + f"""
, n AS (SELECT {_CRM_COLUMNS}, row_number() OVER (PARTITION BY {_CRM_COLUMNS}) AS copy FROM crm)
SELECT {_CRM_COLUMNS}, array_to_string(list_filter([CASE WHEN copy > 1 THEN 'duplicate_count' END,
  CASE WHEN phone IS NOT NULL AND NOT regexp_matches(phone, '^\\+1\\d{{10}}$') THEN 'phone_format_errors' END,
  CASE WHEN email <> lower(email) THEN 'email_case_errors' END, CASE WHEN age < 18 OR age > 100 THEN 'age_range_violations' END], lambda x: x IS NOT NULL), ',') AS failed
FROM n""")
def quarantine_crm(spark, sf):
    """R16 with a row-set rule: all copies of a row but one are flagged."""
    return QR.flag(_view(spark, sf, "crm"), Q.crm_suite()).withColumn("failed", F.array_join(QR.FLAGS, ",")).drop(QR.FLAGS)


@register("quarantine_hot_copies", """
WITH t AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS k, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE -l_tax END AS v FROM lineitem),
 n AS (SELECT k, v, row_number() OVER (PARTITION BY k, v) AS copy FROM t)
SELECT k, abs(v) AS v, count(*) FILTER (WHERE copy > 1) AS flagged, count(*) FILTER (WHERE copy = 1) AS kept FROM n GROUP BY k, v""")
def quarantine_hot_copies(spark, sf):
    """R16 where a third of all rows are copies of one: written out in pieces; rows
    with -0.0 pass as they are."""
    third = F.col("l_orderkey") % 3 == 0
    df = load(spark, sf, "lineitem").select(F.when(third, 0).otherwise(F.col("l_orderkey")).alias("k"), F.when(third, 0.0).otherwise(-F.col("l_tax")).alias("v"))
    flagged = QR.flag(df, Q.Suite("copies", (Q.Weighted(R.duplicates()),), 0.5, 0.9), piece=500)
    dup = F.size(QR.FLAGS) > 0
    return flagged.groupBy("k", F.abs("v").alias("v")).agg(F.count_if(dup).alias("flagged"), F.count_if(~dup).alias("kept"))


@register("quarantine_split_crm", FX.cte("crm") + f"""
, n AS (SELECT *, row_number() OVER (PARTITION BY {_CRM_COLUMNS}) > 1 OR coalesce(NOT regexp_matches(phone, '^\\+1\\d{{10}}$'), false)
  OR coalesce(email <> lower(email), false) OR coalesce(age < 18 OR age > 100, false) AS bad FROM crm)
SELECT bad, {_CRM_COLUMNS} FROM n""")
def quarantine_split_crm(spark, sf):
    """R16 split: the clean and the quarantined rows together are the input."""
    good, bad = QR.split(_view(spark, sf, "crm"), Q.crm_suite())
    return good.withColumn("bad", F.lit(False)).unionByName(bad.drop(QR.FLAGS).withColumn("bad", F.lit(True)))


@register("quarantine_split_counts", FX.cte("emr") + f"""
SELECT count(*) FILTER (WHERE NOT bad) AS clean_rows, count(*) FILTER (WHERE bad) AS quarantined_rows FROM
 (SELECT (try_strptime(dob, '%Y-%m-%d') > try_strptime(admission_date, '%Y-%m-%d')) IS TRUE
   OR NOT regexp_matches(coalesce(icd10_code, ''), '^[A-Z]\\d{{2}}\\.\\d{{1,2}}$')
   OR (dosage_mg < 0) IS TRUE OR {_blank_sql('patient_id')} OR {_blank_sql('diagnosis')}
   OR (try_strptime(admission_date, '%Y-%m-%d') > try_strptime(discharge_date, '%Y-%m-%d')) IS TRUE AS bad FROM emr)""")
def quarantine_split_counts(spark, sf):
    flagged = QR.flag(_view(spark, sf, "emr"), Q.emr_suite())
    bad = F.size(QR.FLAGS) > 0
    return flagged.agg(F.count_if(~bad).alias("clean_rows"), F.count_if(bad).alias("quarantined_rows"))


# ================================================================== inject S3

@register("inject_detect", I.INJECT_DETECT_SQL)
def inject_detect(spark, sf):
    """S3 then R-rules: defects injected by key arithmetic are found exactly."""
    return I.inject_detect(load(spark, sf, "customer"))


@register("inject_detect_orders", I.INJECT_ORDERS_SQL)
def inject_detect_orders(spark, sf):
    """S3 swap / date-before / bad-code / out-of-range injectors, then R9, R11, R8."""
    return I.inject_detect_orders(load(spark, sf, "orders"))


# ================================================================== streaming

@register("stream_rules_window", """
SELECT date_trunc('day', ts) AS window_start, count(*) AS rows,
 count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS value_null,
 count(*) FILTER (WHERE value < 0) AS value_negative,
 count(*) FILTER (WHERE event_type = 'error') AS error_events
FROM events GROUP BY 1""")
def stream_rules_window(spark, sf):
    """ST3: rule counts per daily window on a stream of events (bounded replay)."""
    return ST.rules_per_window(spark, sf)


@register("stream_dedup", """
SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events""")
def stream_dedup(spark, sf):
    """ST2: streaming dedup of (user, type) per day; state bounded by a watermark on the day."""
    return ST.dedup_keys(spark, sf)


@register("stream_dedup_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_watermark(spark, sf):
    """ST2: dropDuplicatesWithinWatermark on a key that repeats."""
    return ST.dedup_replay(spark, sf)


@register("stream_clean", f"""
SELECT event_id, user_id, lower(event_type) AS event_type,
 CASE WHEN value < 0 THEN abs(value) ELSE value END AS value,
 (value IS NOT NULL AND value < 0) AS was_negative
FROM events""")
def stream_clean(spark, sf):
    """ST1: row-local cleaners and a rule predicate applied to a stream."""
    return ST.clean_stream(spark, sf)


@register("stream_impute_static", """
WITH m AS (SELECT user_id AS u, avg(value) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY user_id)
SELECT event_id, user_id, event_type, round(CASE WHEN event_type = 'error' THEN m.v ELSE value END, 6) AS value
FROM events LEFT JOIN m ON events.user_id = m.u""")
def stream_impute_static(spark, sf):
    """ST4: a stream filled from statistics of a static table (stream-static join)."""
    return ST.impute_from_static(spark, sf)


@register("stream_closed_windows", """
WITH e AS (SELECT *, least(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events)::DOUBLE * 4), 3) AS part FROM events),
 w AS (SELECT * FROM e WHERE NOT (part = 0 AND event_id % 97 = 0))
SELECT 'closed' AS kind, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS rows, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS value_null,
 count(*) FILTER (WHERE value < 0) AS value_negative, count(*) FILTER (WHERE event_type = 'error') AS error_events
FROM w WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 2
UNION ALL SELECT 'late', NULL, count(*), NULL, NULL, NULL FROM e WHERE part = 0 AND event_id % 97 = 0""")
def stream_closed_windows(spark, sf):
    """ST3 in append mode: four arrivals, each read by a query started anew; late events are counted."""
    return ST.rules_of_closed_windows(spark, sf)


@register("stream_impute_versions", """
WITH e AS (SELECT *, CASE WHEN (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events)::DOUBLE * 2 >= 1 THEN 2 ELSE 1 END AS version FROM events),
 m AS (SELECT v.version, user_id, avg(value) AS v FROM e JOIN (SELECT unnest([1, 2]) AS version) v ON e.version <= v.version WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)
SELECT event_id, e.user_id, event_type, round(CASE WHEN event_type = 'error' THEN m.v ELSE value END + 1e-9, 6) AS value, CAST(e.version AS INTEGER) AS version
FROM e LEFT JOIN m ON e.user_id = m.user_id AND e.version = m.version""")
def stream_impute_versions(spark, sf):
    """ST4: two micro-batches, each filled from the version of the statistics that was newest then."""
    # means of few values may end in a 5: moved off the edge before rounding
    return ST.impute_from_versions(spark, sf).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@register("score_groupings", FX.cte("retail") + f"""
, r AS (SELECT *, CAST(timestamp AS DATE) AS day FROM retail),
 c AS (SELECT category, day, grouping(category) AS gc, grouping(day) AS gd, {_RETAIL_COUNTS} FROM r GROUP BY GROUPING SETS ((category), (day), (category, day), ()))
SELECT CASE WHEN gc = 0 AND gd = 0 THEN 'category,day' WHEN gc = 0 THEN 'category' WHEN gd = 0 THEN 'day' ELSE '' END AS grouping, category, day, rows,
 price_null_count, sentinel_count, price_below_zero, CAST(price_null_count + sentinel_count + price_below_zero AS BIGINT) AS total_defects,
 round({_clip('0.5 * (1.0 - price_null_count / greatest(rows, 1)) + 0.3 * (1.0 - sentinel_count / greatest(rows, 1)) + 0.2 * (1.0 - price_below_zero / greatest(rows, 1))')}, 6) AS score
FROM c""")
def score_groupings(spark, sf):
    """Scores by category, by day, by both and in total from one pass."""
    retail = _view(spark, sf, "retail").withColumn("day", F.col("timestamp").cast("date"))
    out = Q.score_groupings(retail, Q.retail_suite(), [["category"], ["day"], ["category", "day"], []])
    return out.select("grouping", "category", "day", "rows", "price_null_count", "sentinel_count", "price_below_zero", "total_defects", F.round("score", 6).alias("score"))


@register("score_groupings_duplicates", FX.cte("crm") + f"""
, n AS (SELECT {_CRM_COLUMNS}, row_number() OVER (PARTITION BY {_CRM_COLUMNS}) AS copy FROM crm)
SELECT CASE WHEN grouping(plan) = 0 THEN 'plan' ELSE '' END AS grouping, plan, count(*) AS rows, count(*) FILTER (WHERE copy > 1) AS duplicate_count,
 count(*) FILTER (WHERE email <> lower(email)) AS email_case_errors FROM n GROUP BY GROUPING SETS ((plan), ())""")
def score_groupings_duplicates(spark, sf):
    """R14/Q8 with a rule over whole rows: duplicates by plan and in total."""
    out = Q.score_groupings(_view(spark, sf, "crm"), Q.crm_suite(), [["plan"], []])
    return out.select("grouping", "plan", "rows", "duplicate_count", "email_case_errors")


@register("profile_state_merged", """
SELECT 'o_orderkey' AS name, count(*) AS rows, 0::BIGINT AS bad, true AS close FROM orders
UNION ALL SELECT 'o_custkey', count(*), 0, true FROM orders
UNION ALL SELECT 'o_totalprice', count(*), count(*) FILTER (WHERE o_orderkey % 9 = 0), true FROM orders
UNION ALL SELECT 'price_null', count(*), count(*) FILTER (WHERE o_orderkey % 9 = 0), true FROM orders""")
def profile_state_merged(spark, sf):
    """P3, C10a, Q8 from stored state: three batches appended, one of them twice. Counts are
    exact; distinct values and medians lie within the stated error of a full pass."""
    from .operators import state as SS
    from .session import scratch_path
    df = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    suite = Q.Suite("price", (Q.Weighted(R.null_values("o_totalprice", "price_null")),), 0.5, 0.9)
    path = scratch_path(spark, "profile-state")
    for k in (0, 1, 1, 2):
        SS.append_state(SS.batch_state(df.where(F.pmod("o_custkey", F.lit(3)) == k), f"batch {k}", suite), path)
    state = SS.read_state(spark, path)
    exact = P.profile(df).select(F.col("column"), F.col("unique_count").alias("_u"))
    cells = _stacked_ranks(df, SS.merged_profile(state))
    merged = SS.merged_profile(state).join(exact, "column").join(cells, "column")
    close = (F.abs(F.col("unique_count") - F.col("_u")) <= 0.06 * F.col("_u") + 1) & (F.abs(F.col("_rank") - 0.5) <= 0.03)
    columns = merged.select(F.col("column").alias("name"), "rows", F.col("null_count").alias("bad"), close.alias("close"))
    rules = SS.merged_counts(state).select(F.col("rule").alias("name"), "rows", F.col("violations").alias("bad"), F.lit(True).alias("close"))
    return columns.unionByName(rules)


def _stacked_ranks(df: DataFrame, merged: DataFrame) -> DataFrame:
    """Share of each column's values that are at most its merged median."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in df.columns])).alias("s")).select("s.*")
    return (cells.where("v IS NOT NULL").join(F.broadcast(merged.select("column", "median")), "column")
            .groupBy("column").agg((F.count_if(F.col("v") <= F.col("median")) / F.count(F.lit(1))).alias("_rank")))


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLE)

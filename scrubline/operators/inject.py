"""Seeded defect injection (S3) for testing rules at scale.

Rows are chosen by key arithmetic (``pmod(key, modulus) == remainder``), not by
random draws, so the same selection is reproducible in any engine and on any
partitioning. Every injector is a narrow projection except ``DuplicateRows``
(a ``unionByName`` with the selected rows).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


#: Defaults: ages on both sides of 18..100, and codes that are lower case, too short,
#: without their dot or padded.
AGE_OUTLIERS = (-12, 3, 17, 101, 118, 240)
BAD_CODES = ("k522", "m5", "R1070", "z011", " g403 ")


def _hit(key: str, mod: int, rem: int) -> Column:
    return F.pmod(F.col(key), F.lit(mod)) == F.lit(rem)


@dataclass(frozen=True)
class NullOut:
    col: str
    mod: int
    rem: int

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        typ = df.schema[self.col].dataType
        return df.withColumn(self.col, F.when(_hit(key, self.mod, self.rem), F.lit(None).cast(typ)).otherwise(F.col(self.col)))


@dataclass(frozen=True)
class SentinelOut:
    col: str
    mod: int
    rem: int
    value: float = -1

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        typ = df.schema[self.col].dataType
        return df.withColumn(self.col, F.when(_hit(key, self.mod, self.rem), F.lit(self.value).cast(typ)).otherwise(F.col(self.col)))


@dataclass(frozen=True)
class CaseUp:
    col: str
    mod: int
    rem: int

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn(self.col, F.when(_hit(key, self.mod, self.rem), F.upper(self.col)).otherwise(F.col(self.col)))


@dataclass(frozen=True)
class OutOfRange:
    """Replace the value by ``values[pmod(key, len(values))]`` on selected rows."""
    col: str
    mod: int
    rem: int
    values: tuple[float, ...] = AGE_OUTLIERS

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        typ = df.schema[self.col].dataType
        pick = F.element_at(F.array(*[F.lit(v) for v in self.values]),
                            (F.pmod(F.col(key), F.lit(len(self.values))) + 1).cast("int"))
        return df.withColumn(self.col, F.when(_hit(key, self.mod, self.rem), pick.cast(typ)).otherwise(F.col(self.col)))


@dataclass(frozen=True)
class DuplicateRows:
    mod: int
    rem: int

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        return df.unionByName(df.where(_hit(key, self.mod, self.rem)))


@dataclass(frozen=True)
class SwapCols:
    a: str
    b: str
    mod: int
    rem: int

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        h = _hit(key, self.mod, self.rem)
        return df.withColumns({self.a: F.when(h, F.col(self.b)).otherwise(F.col(self.a)),
                               self.b: F.when(h, F.col(self.a)).otherwise(F.col(self.b))})


@dataclass(frozen=True)
class BadCode:
    """Replace by a malformed form ``forms[pmod(key, len(forms))]``."""
    col: str
    mod: int
    rem: int
    forms: tuple[str, ...] = BAD_CODES

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        pick = F.element_at(F.array(*[F.lit(v) for v in self.forms]),
                            (F.pmod(F.col(key), F.lit(len(self.forms))) + 1).cast("int"))
        return df.withColumn(self.col, F.when(_hit(key, self.mod, self.rem), pick).otherwise(F.col(self.col)))


@dataclass(frozen=True)
class SignFlip:
    col: str
    mod: int
    rem: int

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn(self.col, F.when(_hit(key, self.mod, self.rem), -F.abs(F.col(self.col))).otherwise(F.col(self.col)))


@dataclass(frozen=True)
class BlankOut:
    """Blank text: ``""`` (or ``fill``) on selected rows."""
    col: str
    mod: int
    rem: int
    fill: str | None = ""

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn(self.col, F.when(_hit(key, self.mod, self.rem), F.lit(self.fill).cast("string")).otherwise(F.col(self.col)))


@dataclass(frozen=True)
class DateBefore:
    """Set ``col`` to ``days`` days before ``ref`` on selected rows (a date-order defect)."""
    col: str
    ref: str
    mod: int
    rem: int
    days: int = 1

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        moved = F.date_sub(F.to_date(F.col(self.ref)), self.days).cast(df.schema[self.col].dataType)
        return df.withColumn(self.col, F.when(_hit(key, self.mod, self.rem), moved).otherwise(F.col(self.col)))


def inject(df: DataFrame, key: str, specs: Sequence) -> DataFrame:
    """S3: apply injectors in order; ``key`` must be an integral column."""
    return reduce(lambda d, s: s.apply(d, key), specs, df)


# The query pair used by the correctness check: inject into `customer`, detect.
DETECT_SPECS = (
    NullOut("c_acctbal", 10, 3),
    SentinelOut("c_acctbal", 10, 7, -1),
    SignFlip("c_acctbal", 13, 2),
    CaseUp("c_mktsegment", 4, 1),
    BlankOut("c_name", 20, 11),
    DuplicateRows(25, 0),
)

INJECT_DETECT_SQL = """
WITH a AS (SELECT c_custkey,
   CASE WHEN c_custkey % 20 = 11 THEN '' ELSE c_name END AS c_name, c_nationkey,
   CASE WHEN c_custkey % 13 = 2 THEN -abs(CASE WHEN c_custkey % 10 = 7 THEN -1.0 WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END)
        ELSE CASE WHEN c_custkey % 10 = 7 THEN -1.0 WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END END AS c_acctbal,
   CASE WHEN c_custkey % 4 = 1 THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer),
 t AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE c_custkey % 25 = 0)
SELECT count(*) AS rows,
 count(*) FILTER (WHERE c_acctbal IS NULL OR isnan(c_acctbal)) AS acctbal_null,
 count(*) FILTER (WHERE c_acctbal = -1) AS acctbal_sentinel,
 count(*) FILTER (WHERE c_acctbal < 0) AS acctbal_negative,
 count(*) FILTER (WHERE c_mktsegment <> lower(c_mktsegment)) AS segment_case,
 count(*) FILTER (WHERE c_name IS NULL OR regexp_replace(c_name, '^\\s+|\\s+$', '', 'g') = '') AS name_blank,
 (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM t
   GROUP BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) AS duplicate_count
FROM t"""


def inject_detect(customer: DataFrame) -> DataFrame:
    """Inject the defects of ``DETECT_SPECS`` and count them back with the rules."""
    dirty = inject(customer, "c_custkey", DETECT_SPECS)
    rules = [R.null_values("c_acctbal", "acctbal_null"), R.equals_value("c_acctbal", -1, "acctbal_sentinel"),
             R.below("c_acctbal", 0.0, "acctbal_negative"), R.not_lower("c_mktsegment", "segment_case"),
             R.blank_cells(["c_name"], "name_blank")]
    counts = dirty.agg(F.count(F.lit(1)).alias("rows"), *[r.count(dirty).alias(r.name) for r in rules])
    return counts.withColumn("duplicate_count", R.duplicate_count(dirty).scalar())


# Second pair: date-order, code and range defects injected into a clean
# projection of `orders`, counted back with the EMR/CRM rules.
ORDERS_SPECS = (
    SwapCols("start_date", "end_date", 15, 4),
    DateBefore("end_date", "start_date", 23, 7, 1),
    BadCode("code", 8, 1),
    OutOfRange("age", 17, 0),
)

INJECT_ORDERS_SQL = """
WITH b AS (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date,
   CAST(CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 20 AS INT) AS VARCHAR) AS end_date,
   'B02.0' AS code, CAST(18 + o_orderkey % 60 AS DOUBLE) AS age FROM orders),
 s AS (SELECT k, CASE WHEN k % 15 = 4 THEN end_date ELSE start_date END AS start_date,
   CASE WHEN k % 15 = 4 THEN start_date ELSE end_date END AS end_date, code, age FROM b),
 d AS (SELECT k, start_date,
   CASE WHEN k % 23 = 7 THEN CAST(CAST(start_date AS DATE) - 1 AS VARCHAR) ELSE end_date END AS end_date, code, age FROM s),
 c AS (SELECT k, start_date, end_date,
   CASE WHEN k % 8 = 1 THEN CASE k % 5 WHEN 0 THEN 'k522' WHEN 1 THEN 'm5' WHEN 2 THEN 'R1070' WHEN 3 THEN 'z011' ELSE ' g403 ' END
        ELSE code END AS code,
   CASE WHEN k % 17 = 0 THEN CASE k % 6 WHEN 0 THEN -12 WHEN 1 THEN 3 WHEN 2 THEN 17 WHEN 3 THEN 101 WHEN 4 THEN 118 ELSE 240 END
        ELSE age END AS age FROM d)
SELECT count(*) AS rows,
 count(*) FILTER (WHERE CAST(start_date AS DATE) > CAST(end_date AS DATE)) AS date_order_violations,
 count(*) FILTER (WHERE NOT regexp_matches(coalesce(code, ''), '^[A-Z]\\d{2}\\.\\d{1,2}$')) AS icd10_format_errors,
 count(*) FILTER (WHERE age < 18 OR age > 100) AS age_range_violations
FROM c"""


def inject_detect_orders(orders: DataFrame) -> DataFrame:
    """Inject ``ORDERS_SPECS`` into a clean projection of orders; count them back."""
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    base = orders.select(k.alias("k"), start.cast("string").alias("start_date"),
                         F.date_add(start, (F.lit(1) + F.pmod(k, F.lit(20))).cast("int")).cast("string").alias("end_date"),
                         F.lit("B02.0").alias("code"), (F.lit(18) + F.pmod(k, F.lit(60))).cast("double").alias("age"))
    dirty = inject(base, "k", ORDERS_SPECS)
    rules = [R.date_after("start_date", "end_date", "date_order_violations"),
             R.code_format("code"), R.out_of_range("age", 18, 100, "age_range_violations")]
    return dirty.agg(F.count(F.lit(1)).alias("rows"), *[r.count(dirty).alias(r.name) for r in rules])

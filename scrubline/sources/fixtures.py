"""Dirty fixture views over the test tables (see FIXTURES.md, part 3).

The same SQL text runs in Spark and in DuckDB, so the oracle sees exactly the
rows our operators see. Defects are chosen by key arithmetic only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .io import load

RETAIL_SQL = """
SELECT o_orderkey AS row_id,
 'TXN-' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS transaction_id,
 o_orderpriority AS category,
 CAST(1 + o_orderkey % 9 AS INT) AS quantity,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS DOUBLE)
      WHEN o_orderkey % 10 = 1 THEN CAST(-1 AS DOUBLE)
      WHEN o_orderkey % 97 = 3 THEN CAST(0 AS DOUBLE)
      ELSE o_totalprice END AS price,
 CAST(o_orderdate AS STRING) AS timestamp
FROM orders
"""

CRM_SQL = """
WITH b AS (SELECT c_custkey AS k, c_nationkey AS n, lower(c_mktsegment) AS seg,
   CAST(200 + (c_custkey * 7) % 799 AS STRING) AS a,
   CAST(200 + (c_custkey * 13) % 799 AS STRING) AS p,
   CAST(1000 + (c_custkey * 17) % 8999 AS STRING) AS l FROM customer),
 r AS (SELECT k AS row_id, 'CUST-' || lpad(CAST(k AS STRING), 9, '0') AS customer_id,
   CASE WHEN k % 50 = 7 THEN CAST(NULL AS STRING)
        WHEN k % 10 < 3 THEN upper(seg || '.' || CAST(k AS STRING) || '@mail' || CAST(n AS STRING) || '.example.com')
        ELSE seg || '.' || CAST(k AS STRING) || '@mail' || CAST(n AS STRING) || '.example.com' END AS email,
   CASE WHEN k % 40 = 9 THEN CAST(NULL AS STRING)
        WHEN k % 6 = 0 THEN '(' || a || ') ' || p || '-' || l
        WHEN k % 6 = 1 THEN a || '-' || p || '-' || l
        WHEN k % 6 = 2 THEN a || '.' || p || '.' || l
        WHEN k % 6 = 3 THEN a || p || l
        WHEN k % 6 = 4 THEN '1' || a || p || l
        ELSE '+44 20 7946 0958' END AS phone,
   CAST(CASE WHEN k % 17 = 0 THEN CASE k % 6 WHEN 0 THEN -12 WHEN 1 THEN 3 WHEN 2 THEN 17 WHEN 3 THEN 101 WHEN 4 THEN 118 ELSE 240 END
        ELSE 18 + k % 62 END AS DOUBLE) AS age,
   CAST(DATE '2020-01-01' + CAST((k * 37) % 1460 AS INT) AS STRING) AS signup_date,
   CASE k % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'basic' WHEN 2 THEN 'pro' ELSE 'enterprise' END AS plan FROM b)
SELECT * FROM r UNION ALL SELECT * FROM r WHERE row_id % 12 = 0
"""

EMR_SQL = """
WITH b AS (SELECT o_orderkey AS k, o_totalprice AS amt,
   DATE '1960-01-01' + CAST((o_orderkey * 31) % 18250 AS INT) AS d0,
   DATE '2022-01-01' + CAST((o_orderkey * 17) % 730 AS INT) AS a0 FROM orders),
 s AS (SELECT k, amt, CASE WHEN k % 20 = 3 THEN a0 ELSE d0 END AS dob,
   CASE WHEN k % 20 = 3 THEN d0 ELSE a0 END AS adm, a0 FROM b)
SELECT k AS row_id,
 CASE WHEN k % 33 = 5 THEN '' ELSE 'PAT-' || lpad(CAST(k AS STRING), 9, '0') END AS patient_id,
 CAST(dob AS STRING) AS dob, CAST(adm AS STRING) AS admission_date,
 CAST(CASE WHEN k % 25 = 7 THEN adm + CAST(-1 AS INT) ELSE a0 + CAST(1 + k % 14 AS INT) END AS STRING) AS discharge_date,
 CASE WHEN k % 37 = 4 THEN CAST(NULL AS STRING) WHEN k % 41 = 6 THEN '   '
      ELSE CASE k % 4 WHEN 0 THEN 'Pneumonia' WHEN 1 THEN 'Sepsis' WHEN 2 THEN 'Stroke' ELSE 'COPD' END END AS diagnosis,
 CASE WHEN k % 8 = 1 THEN CASE k % 10 WHEN 1 THEN 'k522' WHEN 3 THEN 'm5' WHEN 5 THEN 'R1070' WHEN 7 THEN 'z011' ELSE ' g403 ' END
      ELSE CASE k % 5 WHEN 0 THEN 'A01.1' WHEN 1 THEN 'B02.0' WHEN 2 THEN 'C34.1' WHEN 3 THEN 'D50.0' ELSE 'E11.9' END END AS icd10_code,
 CASE WHEN k % 12 = 5 THEN -(amt / 1000) ELSE amt / 1000 END AS dosage_mg,
 CASE k % 3 WHEN 0 THEN 'ICU' WHEN 1 THEN 'General' ELSE 'Surgery' END AS ward
FROM s
"""

VIEWS = {"retail": (RETAIL_SQL, ("orders",)), "crm": (CRM_SQL, ("customer",)), "emr": (EMR_SQL, ("orders",))}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one dirty view (``retail``, ``crm`` or ``emr``) over ``sf_dir``.

    The base tables are passed as DataFrame parameters of ``spark.sql`` (the
    same SQL text DuckDB runs, with table names turned into placeholders), so
    no session-wide temp view is created or overwritten.
    """
    sql, tables = VIEWS[name]
    pattern = r"\b(" + "|".join(tables) + r")\b"
    return spark.sql(re.sub(pattern, r"{\1}", sql), **{t: load(spark, sf_dir, t) for t in tables})


def cte(*names: str) -> str:
    """``WITH`` prefix defining the named views, for oracle SQL."""
    parts = [f"{n} AS ({VIEWS[n][0].strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"

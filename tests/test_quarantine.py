"""Copies of hot rows, zeros with a sign, pieces."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrubline.functions import rules as R
from scrubline.operators import quarantine as QR
from scrubline.plans import suite as Q

COPIES = Q.Suite("copies", (Q.Weighted(R.duplicates()),), 0.5, 0.9)


@pytest.mark.parametrize("piece", [1, 7, 10_000])
def test_all_copies_but_one(spark, piece):
    rows = [(k % 5, None if k % 2 else "x") for k in range(100)] + [(99, "once")]
    df = spark.createDataFrame(rows, "k long, s string").repartition(3)
    got = [(r.k, r.s, len(r.failed_rules)) for r in QR.flag(df, COPIES, piece).collect()]
    assert Counter((k, s) for k, s, _ in got) == Counter(rows)
    assert Counter((k, s) for k, s, bad in got if not bad) == Counter(set(rows))


def test_a_hot_group_is_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
        out = QR.flag(df, COPIES, 100).where("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in out) == 3000 and len(out) > 1 and max(r["count"] for r in out) < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_zeros_keep_their_sign(spark):
    """-0.0 equals 0.0: one row of each group of equal rows stays, all rows come back as they were."""
    rows = [(0.0, 1.0), (-0.0, 1.0), (-0.0, 1.0), (-0.0, 2.0), (0.0, -0.0), (-0.0, -0.0), (3.0, -0.0), (None, -0.0), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    got = QR.flag(df, COPIES).collect()
    assert Counter(repr(tuple(r)[:2]) for r in got) == Counter(map(repr, rows))
    kept = Counter((str(abs(r.a)) if r.a is not None else None, abs(r.b)) for r in got if not r.failed_rules)
    assert kept == Counter({("0.0", 1.0): 1, ("0.0", 2.0): 1, ("0.0", 0.0): 1, ("3.0", 0.0): 1, (None, 0.0): 1, ("nan", 0.0): 1})
    flt = spark.createDataFrame([(-0.0,), (5.0,)], "a float")
    assert sorted(repr(r.a) for r in QR.flag(flt, COPIES).collect()) == ["-0.0", "5.0"]


def test_empty_table(spark):
    assert QR.flag(spark.createDataFrame([], "a double, s string"), COPIES).collect() == []

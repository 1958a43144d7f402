"""Range blocks by histograms: contiguous in the order, bounded, for every type."""

import datetime as dt
import decimal
import random
import string

import pytest
from pyspark.sql import functions as F

from scrubline.operators import fill as W
from scrubline.operators.ranges import blocks, codes

D = decimal.Decimal
SPECIAL = {
    "l long": [None, -(2 ** 63), 2 ** 63 - 1, -(2 ** 63) + 1, 0, -1, 1, 2, 3, 4, 5],
    "i int": [None, -(2 ** 31), 2 ** 31 - 1, 0],
    "d double": [None, float("-inf"), float("inf"), float("nan"), 0.0, -0.0, 5e-324, -5e-324, 1e-323, 1.7e308, -1.7e308, 1.0, 1.0000000000000002],
    "f float": [None, 1.5, -2.5, float("nan")],
    "s string": [None, "", "a", "a\0", "a\0b", "aaaaaaa", "aaaaaaab", "aaaaaaaa", "é", "日本", "z" * 30, "z" * 30 + "a"],
    "b boolean": [None, True, False],
    "n binary": [None, b"", b"\xff", b"\xff\x00", b"\x00" * 8],
    "c decimal(12,3)": [None, D("-1.5"), D("999999999.999"), D("0.001")],
    "w decimal(38,18)": [None, D("-0.000000000000000001"), D("12345678901234567890.5"), D("-99999999999999999999.999999999999999999"), D("0")],
    "t timestamp": [None, dt.datetime(1950, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 1, 1)],
    "y date": [None, dt.date(1, 1, 1), dt.date(2024, 2, 29)],
}


def check(df, order, size):
    """Block numbers never fall along the whole order, and no block has twice the rows."""
    got = blocks(df, order, size)
    names = order + [c for c in df.columns if c not in order]
    along = [r._blk for r in got.orderBy(*[F.col(c).asc_nulls_first() for c in names], "_blk").select("_blk").collect()]
    assert along == sorted(along) and len(along) == df.count()
    sizes = {b: along.count(b) for b in set(along)}
    assert max(sizes.values()) < 2 * size
    return sizes


@pytest.mark.parametrize("column", list(SPECIAL))
def test_codes_order_like_the_column(spark, column):
    name = column.split()[0]
    df = spark.createDataFrame([(v,) for v in SPECIAL[column] * 2], column)
    made = list(codes(df, name))
    longs, doubles = ([c for k, c in made if k == kind] for kind in ("long", "double"))
    coded = df.select(name, F.array(*longs).alias("k"), F.array(*doubles).alias("r") if doubles else F.lit(0).alias("r"))
    by_value = [repr(r[name]) for r in coded.orderBy(F.col(name).asc_nulls_first()).collect()]
    by_code = [repr(r[name]) for r in coded.orderBy("k", "r").collect()]
    plain = (lambda v: v.replace("-0.0", "0.0")) if name == "d" else str  # -0.0 and 0.0 are equal
    assert list(map(plain, by_code)) == list(map(plain, by_value))


def test_all_types_in_one_order(spark):
    rng = random.Random(5)
    rows = [tuple(rng.choice(v) for v in SPECIAL.values()) for _ in range(600)]
    df = spark.createDataFrame(rows, ", ".join(SPECIAL)).repartition(5)
    check(df, ["b", "d"], 100)


def test_crowded_and_long_text_keys_split_evenly(spark):
    """Texts of up to 3,000 letters that share their first 2,000, and few that do not."""
    rng = random.Random(6)
    head = "x" * 200
    rows = [(head + "".join(rng.choices(string.ascii_letters, k=rng.randint(0, 12))) if k % 40 else "q" * 300, k % 3) for k in range(1500)]
    df = spark.createDataFrame(rows, "s string, k long")
    assert len(check(df, ["s"], 100)) >= 10


def test_equal_rows_are_dealt_out(spark):
    """A third of all rows are copies of one row."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("v").alias("v"))
    sizes = check(df, ["k"], 100)
    assert len(sizes) >= 20


def test_blocks_of_small_and_empty_tables(spark):
    df = spark.range(10).withColumn("v", F.lit(None).cast("string"))
    assert [r._blk for r in blocks(df, ["id"], 10).collect()] == [0] * 10
    assert blocks(df.limit(0), ["id"], 10).count() == 0
    assert W.forward_fill(df.limit(0), ["v"], order_by="id").count() == 0


def test_fills_over_blocks_equal_one_window(spark):
    """Two groups, one of which holds nearly all rows; both directions."""
    df = spark.range(2500).select("id", F.when(F.col("id") % 90 == 0, "b").otherwise("a").alias("g"), (F.col("id") % 7).alias("k"),
                                  F.when(F.col("id") % 11 == 3, F.col("id").cast("double")).alias("v"))
    for fill in (W.forward_fill, W.backward_fill):
        for by in (None, "g"):
            want = fill(df, ["v"], order_by=["k", "id"], partition_by=by).collect()
            got = fill(df.repartition(6), ["v"], order_by=["k", "id"], partition_by=by, rows_per_block=200).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want))

"""Stored state, groupings, versions of statistics, append-mode windows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scrubline.functions import rules as R
from scrubline.operators import state as SS
from scrubline.plans import suite as Q
from scrubline.streaming import stream as ST

SUITE = Q.Suite("s", (Q.Weighted(R.null_values("v")), Q.Weighted(R.below("v", 0.0, "negative"))), 0.5, 0.9)


def table(spark, n=3000):
    rng = random.Random(8)
    rows = [(k, rng.choice([None, float("nan"), -0.0, 0.0, rng.gauss(5, 20)]), rng.choice(["a", "b", None]), k % 4) for k in range(n)]
    return rows, spark.createDataFrame(rows, "k long, v double, s string, g int")


def test_merged_state_equals_a_full_pass(spark, tmp_path):
    rows, df = table(spark)
    whole = SS.batch_state(df, "all", SUITE)
    for g in range(4):
        assert SS.append_state(SS.batch_state(df.where(F.col("g") == g), f"b{g}", SUITE), f"{tmp_path}/s")
    assert not SS.append_state(SS.batch_state(df.limit(5), "b1", SUITE), f"{tmp_path}/s")
    assert SS.append_state(SS.batch_state(df.limit(0), "empty", SUITE), f"{tmp_path}/s")
    state = SS.read_state(spark, f"{tmp_path}/s")
    got = {r.column: r for r in SS.merged_profile(state).collect()}
    assert {c: (r.rows, r.null_count) for c, r in got.items()} == {r.column: (r.rows, r.null_count) for r in SS.merged_profile(whole).collect()}
    numbers = sorted(v for _, v, _, _ in rows if v is not None and not math.isnan(v))
    assert got["v"].null_count == 3000 - len(numbers)
    assert abs(got["v"].unique_count - len(set(numbers))) <= 0.06 * len(set(numbers))
    assert got["v"].median == 0.0  # two thirds of the numbers are zeros
    assert got["s"].median is None and got["s"].unique_count == 2 and abs(got["k"].unique_count - 3000) < 180
    assert abs(got["k"].median - 1500) < 90
    counts = {r.rule: (r.rows, r.violations) for r in SS.merged_counts(state).collect()}
    assert counts == {"v_null": (3000, 3000 - len(numbers)), "negative": (3000, sum(x < 0 for x in numbers))}
    with pytest.raises(ValueError):
        SS.batch_state(df, "x", Q.Suite("d", (Q.Weighted(R.duplicates()),), 0.5, 0.9))


def test_groupings_equal_single_ones(spark):
    _, df = table(spark, 400)
    df = df.unionByName(df.where("g = 1"))
    suite = Q.Suite("s", (*SUITE.rules, Q.Weighted(R.duplicates())), 0.5, 0.9)
    got = Q.score_groupings(df, suite, [["s"], ["g", "s"], []])
    for by, name in ((["s"], "s"), (["g", "s"], "g,s"), ([], "")):
        want = Q.score(df, suite, by=by or None)
        cols = [*by, "rows", "v_null", "negative", "duplicate_count", "total_defects", "score", "passed"]
        a, b = (sorted(map(repr, x.select(*cols).collect())) for x in (got.where(F.col("grouping") == name), want))
        assert a == b
    assert Q.score_groupings(df.limit(0), suite, [["s"], []]).where("grouping = 's'").count() == 0
    assert Q.score_groupings(df, suite, [[]]).count() == 1
    for bad in ([["no_such"]], [], ):
        with pytest.raises(ValueError):
            Q.score_groupings(df, suite, bad)
    with pytest.raises(ValueError):
        Q.score_groupings(df, Q.Suite("d", (Q.Weighted(R.duplicates(["k"])),), 0.5, 0.9), [["s"]])


def test_a_batch_run_again_takes_its_version(spark, tmp_path):
    store = ST.VersionedStatistics(spark, str(tmp_path), "u", "v")
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None), (2, float("nan"))], "u long, v double")
    store.publish(1, rows)
    assert store.taken(0) == 1
    store.publish(2, rows.limit(1))
    assert store.taken(0) == 1 and store.taken(1) == 2
    assert [tuple(r) for r in store.means(1).collect()] == [(1, 3.0)]


def test_closed_windows_hold_every_timely_event(spark):
    sf = "/root/testdata/sf0.001"
    rows = ST.rules_of_closed_windows(spark, sf, parts=3).collect()
    late = [r.rows for r in rows if r.kind == "late"]
    ev = spark.read.parquet(f"{sf}/events.parquet")
    assert len(late) == 1 and 0 < late[0] <= ev.where("event_id % 97 = 0").count()
    assert sum(r.rows for r in rows if r.kind == "closed") + late[0] < ev.count()
    assert len({r.window_start for r in rows if r.kind == "closed"}) == len(rows) - 1  # each window once

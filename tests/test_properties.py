"""Properties: cleaners fix what their rule detects, are idempotent, and the
ordered operators do not depend on partitioning."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scrubline.operators import clean as C
from scrubline.operators import dedup as D
from scrubline.operators import fill as W
from scrubline.operators import inject as I
from scrubline.operators.quantile import exact_quantiles
from scrubline.plans import suite as Q
from scrubline.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def _counts(df, suite):
    return Q.rule_counts(df, suite).collect()[0].asDict()


def test_crm_cleaners_zero_their_rules(spark):
    crm = FX.view(spark, SF, "crm")
    before = _counts(crm, Q.crm_suite())
    assert before["duplicate_count"] > 0 and before["email_case_errors"] > 0
    out = C.clamp_range(C.lowercase(D.deduplicate(crm)), ["age"], 18, 100)
    after = _counts(out, Q.crm_suite())
    assert after["duplicate_count"] == 0 and after["email_case_errors"] == 0 and after["age_range_violations"] == 0


def test_emr_cleaners_zero_their_rules(spark):
    emr = FX.view(spark, SF, "emr")
    out = C.fill_blank(C.abs_negative(C.fix_date_order(emr)), ["patient_id", "diagnosis"])
    out = C.fix_date_order(out, "admission_date", "discharge_date")
    after = _counts(out, Q.emr_suite())
    assert after["negative_dosage_count"] == 0 and after["blank_mandatory_count"] == 0
    assert after["date_order_violations"] == 0


def test_row_local_cleaners_idempotent_and_keep_rows(spark):
    crm = FX.view(spark, SF, "crm")
    once = C.standardize_phone(C.lowercase(crm))
    twice = C.standardize_phone(C.lowercase(once))
    assert once.exceptAll(twice).count() == 0 and once.count() == crm.count()
    emr = FX.view(spark, SF, "emr")
    c1 = C.fix_code_format(emr)
    assert c1.exceptAll(C.fix_code_format(c1)).count() == 0


def test_score_monotone_in_defects(spark):
    base = [(float(i),) for i in range(1, 21)]
    scores = []
    for k in range(0, 6):
        rows = [(None,)] * k + base[k:]
        df = spark.createDataFrame(rows, "price double")
        scores.append(Q.score(df, Q.retail_suite()).collect()[0]["score"])
    assert all(a >= b for a, b in zip(scores, scores[1:]))
    assert all(0.001 <= s <= 0.999 for s in scores)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_fill_matches_plain_window_any_partitioning(spark, parts):
    rng = np.random.default_rng(parts)
    n = 3000
    vals = [None if rng.random() < 0.6 else float(x) for x in rng.normal(size=n)]
    grp = [int(g) for g in rng.integers(0, 3, n)]
    df = spark.createDataFrame(list(zip(range(n), grp, vals)), "k long, g int, v double").repartition(parts)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy("g").orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    ref = df.select("k", F.last("v", True).over(w).alias("f"), F.first("v", True).over(wb).alias("b"))
    ff = W.forward_fill(df, ["v"], order_by="k", partition_by="g", rows_per_block=97).select("k", F.col("v").alias("f"))
    bf = W.backward_fill(df, ["v"], order_by="k", partition_by="g", rows_per_block=97).select("k", F.col("v").alias("b"))
    got = ff.join(bf, "k")
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
    # global (no partition_by), many blocks
    wg = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    refg = df.select("k", F.last("v", True).over(wg).alias("v"))
    gotg = W.forward_fill(df.select("k", "v"), ["v"], order_by="k", rows_per_block=50)
    assert gotg.exceptAll(refg).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_dedup_partition_independent(spark, parts):
    ev = spark.read.parquet(f"{SF}/events.parquet").repartition(parts)
    first = D.deduplicate(ev, ["user_id", "event_type"], "first", order_by="event_id")
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    ref = ev.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    assert first.exceptAll(ref).count() == 0 and ref.exceptAll(first).count() == 0


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    for trial in range(3):
        vals = np.concatenate([rng.lognormal(3, 2, 800), -rng.exponential(5, 300), np.zeros(20),
                               rng.integers(-3, 3, 200).astype(float)])
        df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)], "v double, g int")
        qs = {"median": 0.5, "q1": 0.25, "q9": 0.9}
        row = exact_quantiles(df, "v", qs, median_names=("median",)).collect()[0]
        exp = np.quantile(vals, [0.5, 0.25, 0.9])
        assert row["median"] == pytest.approx(np.median(vals), rel=1e-12, abs=1e-12)
        assert row["q1"] == pytest.approx(exp[1], rel=1e-12) and row["q9"] == pytest.approx(exp[2], rel=1e-12)
        per = {r["g"]: r["median"] for r in exact_quantiles(df, "v", {"median": 0.5}, ["g"],
                                                               median_names=("median",)).collect()}
        for g in range(3):
            assert per[g] == pytest.approx(np.median(vals[np.arange(len(vals)) % 3 == g]), rel=1e-12, abs=1e-12)


def test_inject_detect_rates(spark):
    cust = spark.read.parquet(f"{SF}/customer.parquet")
    n = cust.count()
    got = I.inject_detect(cust).collect()[0]
    dups = cust.where("c_custkey % 25 = 0").count()
    assert got["rows"] == n + dups
    assert got["duplicate_count"] == dups
    nulls = cust.where("c_custkey % 10 = 3").count()
    nulls_dup = cust.where("c_custkey % 10 = 3 AND c_custkey % 25 = 0").count()
    assert got["acctbal_null"] == nulls + nulls_dup


def test_fill_blocks_equal_depth_on_clustered_keys(spark):
    from scrubline.operators.fill import _with_blocks
    rng = np.random.default_rng(3)
    n = 4000
    # 90% of the keys crowd into 0.1% of the key range
    keys = np.where(rng.random(n) < 0.9, rng.uniform(0, 1, n), rng.uniform(0, 1000, n))
    vals = [None if rng.random() < 0.5 else float(v) for v in rng.normal(size=n)]
    df = spark.createDataFrame([(float(k), v) for k, v in zip(keys, vals)], "k double, v double")
    sizes = [r["count"] for r in _with_blocks(df, "k", 200).groupBy("_blk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2 * 200
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", F.last("v", True).over(w).alias("v"))
    got = W.forward_fill(df, ["v"], order_by="k", rows_per_block=200)
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_filters_push_through_cleaners_and_scans_are_pruned(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    q = (C.clamp_range(C.abs_negative(li, ["l_discount"]), ["l_quantity"], 0, 10)
         .where(F.col("l_returnflag") == "R").select("l_orderkey", "l_quantity", "l_discount"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double,l_returnflag:string>" in plan
    # a suite reads only its rule columns
    counts = Q.rule_counts(spark.read.parquet(f"{SF}/customer.parquet").withColumnRenamed("c_acctbal", "price"),
                           Q.Suite("p", Q.retail_suite().rules, 0.5, 0.9, required=("price",)))
    assert "ReadSchema: struct<c_acctbal:double>" in counts._jdf.queryExecution().executedPlan().toString()


def test_fill_ties_broken_by_remaining_columns(spark):
    rng = np.random.default_rng(9)
    n = 2000
    keys = rng.integers(0, 150, n)  # many ties
    other = rng.integers(0, 10**6, n)
    vals = [None if rng.random() < 0.5 else float(x) for x in rng.normal(size=n)]
    df = spark.createDataFrame([(int(k), int(o), v) for k, o, v in zip(keys, other, vals)], "k long, o long, v double")
    w = Window.orderBy("k", "o", "v").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", "o", F.last("v", True).over(w).alias("v"))
    for parts in (1, 7):
        got = W.forward_fill(df.repartition(parts), ["v"], order_by="k", rows_per_block=100)
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_untouched_cells_keep_their_values(spark):
    """Integers beyond 2**53, decimals and floats never pass through double."""
    import decimal
    from pyspark.sql import types as T
    from scrubline.operators import stats as S
    D = decimal.Decimal
    schema = "k int, big long, d decimal(20,2), whole decimal(20,2), f float"
    rows = [(1, 9007199254740993, D("123456789012345678.91"), D("1.23"), 0.1), (None, 9007199254740995, None, D("4.56"), None), (-1, -1, D("-1.00"), D("7.89"), -1.0)]
    df = spark.createDataFrame(rows, schema)
    out = S.impute_missing(df)
    assert out.schema["whole"].dataType == T.DecimalType(20, 2) and out.schema["f"].dataType == T.FloatType()
    first = out.where("whole = 1.23").first()
    assert (first.big, first.d) == (9007199254740993, D("123456789012345678.91000000")) and first.k == 1
    out = S.replace_sentinel(df, strategy="constant", value=7)
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in df.schema.fields]
    assert out.where("whole = 7.89").first().big == 7 and out.where("whole = 1.23").first().big == 9007199254740993
    wide = S.impute_missing(df, ["k"], "constant", value=2.5)
    assert wide.where("whole = 4.56").first().k == 2.5
    import pytest
    with pytest.raises(TypeError):
        S.impute_missing(df, ["big"], "constant", value="x")


def test_ntz_in_another_zone(spark):
    """Wall-clock times that the session's zone skips or repeats stay apart."""
    import datetime as dt
    from scrubline.functions import exprs as X
    from scrubline.operators import profile as P, stats as S
    from pyspark.sql import functions as F
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = [dt.datetime(2024, 3, 10, 2, 30, 0, 123456), dt.datetime(2024, 3, 10, 3, 30), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]
        df = spark.createDataFrame([(a,) for a in at] + [(at[0],), (None,)], "t timestamp_ntz")
        assert P.profile(df).first().unique_count == 3
        back = df.where("t IS NOT NULL").select("t", X.ntz_of_micros(X.micros(F.col("t"), df.schema["t"].dataType)).alias("u")).collect()
        assert all(r.t == r.u for r in back)
        assert [r.t for r in S.impute_missing(df, ["t"], "mode").collect()].count(at[0]) == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_plans_are_checked_before_any_job(spark):
    import pytest
    from scrubline.plans import plan as G
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, s string")
    steps = [{"operation": "impute_missing", "target_columns": ["k"]}, {"operation": "deduplicate", "target_columns": ["gone"]}]
    group = "plan-check"
    spark.sparkContext.setJobGroup(group, group)
    with pytest.raises(G.PlanError):
        G.apply_plan(df, steps)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_quarantine_of_duplicates(spark):
    import pytest
    from scrubline.functions import rules as R
    from scrubline.operators import quarantine as QR
    from scrubline.plans import suite as Q
    df = spark.createDataFrame([(1, "a")] * 3 + [(None, "b")], "k int, s string")
    suite = Q.Suite("x", (Q.Weighted(R.duplicates()), Q.Weighted(R.null_values("k"))), 0.5, 0.9)
    good, bad = QR.split(df, suite)
    assert good.collect() == [(1, "a")]
    assert sorted((r.k or 0, r.failed_rules) for r in bad.collect()) == [(0, ["k_null"]), (1, ["duplicate_count"]), (1, ["duplicate_count"])]
    with pytest.raises(ValueError):
        QR.flag(df, Q.Suite("y", (Q.Weighted(R.duplicates(["k"])),), 0.5, 0.9))


def test_fill_blocks_split_equal_and_null_keys(spark):
    """One date for all rows, and NULL keys, still make blocks of about the asked size."""
    from pyspark.sql import functions as F
    from scrubline.operators import fill as W
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit("2024-01-01")).alias("day"), "id", F.when(F.col("id") % 50 == 7, F.col("id")).alias("v"))
    sizes = [r["count"] for r in W._with_blocks(df, ["day", "id"], 1000).groupBy("_blk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000
    got = {r.id: r.v for r in W.forward_fill(df, ["v"], order_by=["day", "id"], rows_per_block=1000, unique_order=True).collect()}
    last, want = None, {}
    for k in [*range(1, 20_000, 2), *range(0, 20_000, 2)]:  # NULL days first
        last = k if k % 50 == 7 else last
        want[k] = last
    assert got == want
    back = {r.id: r.v for r in W.backward_fill(df, ["v"], order_by=["day", "id"], rows_per_block=1000, unique_order=True).collect()}
    nxt, want = None, {}
    for k in [*range(19_998, -1, -2), *range(19_999, 0, -2)]:
        nxt = k if k % 50 == 7 else nxt
        want[k] = nxt
    assert back == want

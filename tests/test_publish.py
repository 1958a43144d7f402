"""Publishing, leases, the ledger table, observed segments, permissive reading."""

import os

import pytest
from pyspark.sql import functions as F

from scrubline import session
from scrubline.functions import rules as R
from scrubline.plans import plan as G
from scrubline.plans import suite as Q
from scrubline.sources import fixtures as FX
from scrubline.sources.io import GateFailed, export, read_permissive, read_published

SF = "/root/testdata/sf0.001"
GOOD = Q.Suite("k", (Q.Weighted(R.null_values("k")), Q.Weighted(R.duplicates())), 0.5, 0.9)
NEVER = Q.Suite("k", (Q.Weighted(R.null_values("k")),), 1.5, 2.0)


def table(spark, n=20):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3).alias("p"))


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


@pytest.mark.parametrize("publish", ["rename", "manifest"])
def test_written_once_and_published(spark, tmp_path, publish):
    read = read_published if publish == "manifest" else (lambda s, p: s.read.parquet(p))
    path = f"{tmp_path}/t"
    info = export(table(spark), path, suite=GOOD, partition_by=["p"], publish=publish)
    assert info["written"] and info["passed"] and info["written_metrics"]["rows"] == 20
    assert read(spark, path).count() == 20
    with pytest.raises(FileExistsError):
        export(table(spark), path, suite=GOOD, publish=publish)
    before = files(path)
    with pytest.raises(GateFailed):
        export(table(spark, 5), path, mode="overwrite", suite=NEVER, publish=publish)
    assert files(path) == before and read(spark, path).count() == 20  # the table before stays
    assert not export(table(spark, 5), path, mode="ignore", suite=GOOD, publish=publish)["written"]
    export(table(spark, 7), path, mode="overwrite", suite=GOOD, publish=publish)
    assert read(spark, path).count() == 7
    assert [f for f in os.listdir(tmp_path) if f != "t"] == []  # no staged or old folder is left
    if publish == "rename":
        export(table(spark, 2), path, mode="append", suite=GOOD)
        assert read(spark, path).count() == 9 and os.listdir(tmp_path) == ["t"]


def test_refused_export_leaves_nothing(spark, tmp_path):
    for publish in ("rename", "manifest"):
        with pytest.raises(GateFailed):
            export(table(spark), f"{tmp_path}/no", suite=NEVER, publish=publish)
    assert os.listdir(tmp_path) == []


def test_duplicates_decide_the_gate(spark, tmp_path):
    twice = table(spark).unionByName(table(spark))
    with pytest.raises(GateFailed):
        export(twice, f"{tmp_path}/t", suite=Q.Suite("d", (Q.Weighted(R.duplicates()),), 0.6, 0.9))
    assert export(twice, f"{tmp_path}/t", suite=Q.Suite("d", (Q.Weighted(R.duplicates()),), 0.5, 0.9))["score"] == 0.5


def test_leases_remove_scratch(spark):
    from scrubline.operators import fill as W
    df = spark.range(300).select("id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    with session.leased(spark) as held:
        rows = W.forward_fill(df, ["v"], order_by="id", rows_per_block=50).collect()
        assert held and any(session.exists(spark, p) for p in held)
    assert sorted((r.id, r.v) for r in rows) == [(k, k - k % 5) for k in range(300)]
    assert not any(session.exists(spark, p) for p in held)
    with pytest.raises(RuntimeError), session.leased(spark) as held:
        spark.range(3).write.parquet(session.scratch_path(spark, "x"))
        raise RuntimeError
    assert not session.exists(spark, held[0])


STEPS = [{"operation": "lowercase_email"}, {"operation": "standardize_phone"}, {"operation": "no_such"}, {"operation": "deduplicate"},
         {"operation": "impute_missing", "target_columns": ["age"], "params": {"strategy": "median"}},
         {"operation": "clamp_range", "target_columns": ["age"], "params": {"min_val": 18, "max_val": 100}},
         {"operation": "clamp_range", "target_columns": ["email"], "params": {"min_val": 1}}, {"operation": "drop_column", "target_columns": ["plan", "x"]}]


def test_segments_equal_plain_aggregates(spark):
    """Observed counts are those of an aggregate over each step, whatever is written."""
    crm = FX.view(spark, SF, "crm")
    want = None
    for mode in (False, "auto", True):
        out, led = G.ledger(crm, STEPS, Q.crm_suite(), checkpoint=mode)
        rows = [tuple(r) for r in led.orderBy("step").collect()]
        want = want or rows
        assert rows == want
        assert out.columns == [c for c in crm.columns if c != "plan"] and out.count() == rows[-1][3]
        assert sorted(map(repr, out.collect())) == sorted(map(repr, G.apply_plan(crm, [s for k, s in enumerate(STEPS) if k not in (2, 6)]).collect()))


def test_segments_write_once_per_heavy_step(spark):
    crm = FX.view(spark, SF, "crm")
    with session.leased(spark) as held:
        G.ledger(crm, STEPS, Q.emr_suite())
        copies = [p for p in held if "/ledger-" in p]
        # before deduplicate, before impute_missing, at the end; only the last is left
        assert len(copies) == 3 and [session.exists(spark, p) for p in copies] == [False, False, True]


def test_ledger_table_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    _, led = G.ledger(FX.view(spark, SF, "crm"), STEPS[:2], Q.crm_suite())
    assert [G.append_ledger(led.where("step < 1"), path, "a"), G.append_ledger(led, path, "a"), G.append_ledger(led, path, "a"), G.append_ledger(led, path, "b")] == [1, 2, 0, 3]
    assert sorted((r.run_id, r.step) for r in G.read_ledger(spark, path).collect()) == [(r, s) for r in "ab" for s in range(3)]


def test_read_permissive(spark, tmp_path):
    lines = ["1,a,2.5", "2,b,x", "3,c", "4,d,1.0,9", "", "5,,"]
    spark.createDataFrame([(v,) for v in lines], "v string").coalesce(1).write.text(f"{tmp_path}/csv")
    rows = {r.k: r for r in read_permissive(spark, f"{tmp_path}/csv", "k long, s string, v double").collect()}
    assert {k: r.failed_rules for k, r in rows.items()} == {1: [], 2: ["malformed_record"], 3: ["malformed_record"], 4: ["malformed_record"], 5: []}
    assert rows[2].record == "2,b,x" and rows[2].s == "b" and rows[1].record is None and rows[5].s is None
    flagged = read_permissive(spark, f"{tmp_path}/csv", "k long, s string, v double").select("k", F.size("failed_rules").alias("n"))
    assert {r.k: r.n for r in flagged.collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}  # also if few columns are selected
    js = ['{"k": 1, "s": "a"}', '{"k": "x"}', "{broken"]
    spark.createDataFrame([(v,) for v in js], "v string").coalesce(1).write.text(f"{tmp_path}/json")
    got = sorted((str(r.k), len(r.failed_rules)) for r in read_permissive(spark, f"{tmp_path}/json", "k long, s string", fmt="json").collect())
    assert got == [("1", 0), ("None", 1), ("None", 1)]
    with pytest.raises(ValueError):
        read_permissive(spark, f"{tmp_path}/csv", "k long, record string")
    with pytest.raises(ValueError):
        read_permissive(spark, f"{tmp_path}/csv", "k long", fmt="parquet")

"""Every registered query against its DuckDB oracle at the smallest scale."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


def test_all_queries_match_oracle(spark):
    from oracle_check import check
    res = check(spark, "/root/testdata/sf0.001")
    bad = {k: v for k, v in res.items() if v.get("error") or (v.get("oracle") and not v.get("match"))}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert [r.stage for r in rows] == ["before", "after"] or sorted(r.stage for r in rows) == ["after", "before"]
    after = [r for r in rows if r.stage == "after"][0]
    assert after.price_null_count == 0 and after.sentinel_count == 0
    assert set(E.oracle_sql()) <= set(E.queries())

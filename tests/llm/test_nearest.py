import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import nearest as N

SF = "/root/testdata/sf0.01"


def test_bounds_never_lose_a_neighbour():
    rng = np.random.default_rng(1)
    for scale in (1e-6, 1, 1e6):
        q, c = rng.normal(size=(40, 24)) * scale, np.concatenate([rng.normal(size=(500, 24)), np.eye(24)]) * scale
        c[:30] = c[30]  # ties
        got = N.best_of(np.arange(40), q, np.arange(1000, 1000 + len(c)), c, 10)
        s = np.zeros((40, len(c)))
        for d in range(24):
            s += q[:, d][:, None] * c[:, d][None, :]
        for k in range(40):
            want = sorted(zip(-s[k], range(1000, 1000 + len(c))))[:10]
            assert got[k] == [(-x, i) for x, i in want]


@pytest.mark.parametrize("qb,cb", [(2048, 8192), (3, 7)])
def test_edges(spark, monkeypatch, qb, cb):
    monkeypatch.setattr(N, "QUERY_BLOCK", qb)
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", cb)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(60)] + [(20, [9.0, 9, 9, 9]), (7, rows_of := [1.0, 0, 0, 0]), (61, rows_of), (62, rows_of)]
    bad = [(80, None), (81, [0.0] * 4), (82, [float("nan"), 1, 1, 1]), (83, [float("inf"), 1, 1, 1]), (84, [None, 1.0, 1, 1]), (85, []), (None, [1.0, 2, 3, 4]), (100, [1.0, 2])]
    floats = lambda v: v if v is None else [x if x is None else float(x) for x in v]
    df = spark.createDataFrame([(i, floats(v), "x") for i, v in rows + bad], "vec_id long, embedding array<float>, rank string")
    got = sorted(map(tuple, N.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    as32 = lambda v: [float(np.float32(x)) for x in v]
    want = []
    for q in (0, 20, 40):
        qv = min(as32(v) for i, v in rows if i == q)
        def dot(v):
            s = 0.0
            for a, b in zip(qv, as32(v)):
                s += a * b
            return s
        best = sorted((-dot(v), i) for i, v in rows if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert N.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_oracle(spark):
    from tools.oracle_check import check
    assert check(spark, SF, ["op2_nearest"])["op2_nearest"]["match"]

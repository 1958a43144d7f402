import math

from pyspark.sql import functions as F

from scrubline.llm import urls as U
from scrubline.llm.registry import ORACLES

SF = "/root/testdata/sf0.01"


def test_parsing_and_rules(spark):
    rows = [("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/"),
            ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
            ("x://h.com/fr/1", "h.com", "/fr/1", "com/fr/"), ("x://h.com/de", "h.com", "/de", None), ("http://org", "org", "", None),
            ("http://h.com?/a", "h.com", "", None), ("http://h.com#://x", "h.com", "", None), ("nothing", "", "", None), (None, "", "", None), ("://", "", "", None),
            ("a://b://c/d", "b:", "//c/d", None), ("http://ÄÉ.Com/fr/", "ÄÉ.com", "/fr/", "com/fr/")]
    df = spark.createDataFrame([(u,) for u, *_ in rows], "url string")
    text, _ = U.rule_of(F.col("h"), F.col("p"), U.RULES)
    got = df.select("url", F.coalesce(U.host_of(F.col("url")), F.lit("")).alias("h"), F.coalesce(U.path_of(F.col("url")), F.lit("")).alias("p")).select("url", "h", "p", text)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_names(spark):
    rows = [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.example.com:80", "example.com", "com"), ("localhost", "localhost", "localhost"), ("10.0.0.1", "10.0.0.1", ""), ("", "", "")]
    df = spark.createDataFrame([(h,) for h, *_ in rows], "h string")
    got = df.select("h", U.domain_of(F.col("h")).alias("d")).select("h", "d", U.suffix_of(F.col("d")))
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_shrinkage_blocks_by_lower_bound(spark):
    pages = [(i, f"http://bad.evil.net/{i}", "u") for i in range(60)] + [(100 + i, f"http://h{i % 12}.good.net/{100 + i}", "u") for i in range(60)] + [(300, "http://new.evil.net/x", "u"), (301, None, None), (0, "http://bad.evil.net/0", "again")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    labels = spark.createDataFrame([(str(i), True) for i in range(60)] + [(str(100 + i), i % 20 == 0) for i in range(60)] + [("0", False), (None, True)], "key string, bad boolean")
    key = F.regexp_extract("path", r"/([0-9]+)$", 1)
    got = {(r.page_id, r.url): r for r in U.judge(df, [], labels, F.when(key != "", key)).collect()}
    assert len(got) == 122
    assert got[5, "http://bad.evil.net/5"].verdict == "block" and got[5, "http://bad.evil.net/5"].n_labelled == 61
    assert got[110, "http://h10.good.net/110"].verdict == "allow"
    new = got[300, "http://new.evil.net/x"]
    assert new.n_labelled == 0 and new.bound < got[5, "http://bad.evil.net/5"].bound
    assert got[301, None].verdict == "allow" and got[301, None].host == ""
    assert U.judge(df.limit(0), [], labels, F.lit(None).cast("string")).count() == 0
    none = U.judge(df, [], labels.limit(0), F.when(key != "", key))
    assert none.where("verdict = 'block'").count() == 0


def test_bound_formula(spark):
    hosts = spark.createDataFrame([("a.x.com", 9, 8, 6), ("b.x.com", 9, 4, 1), ("c.y.com", 5, 5, 0), ("d.z.net", 7, 3, 3)], "host string, n_pages long, n long, bad long")
    got = {r.host: r for r in U.reputation(hosts).collect()}

    def k(groups):
        g = [(b / n, n) for n, b in groups if n >= 2]
        m = sum(p for p, _ in g) / len(g)
        v = sum((p - m) ** 2 for p, _ in g) / len(g) - m * (1 - m) * sum(1 / n for _, n in g) / len(g)
        return 1000.0 if v <= 0 else min(1000, max(1, m * (1 - m) / v - 1))
    ks, kd, kh = k([(17, 7), (3, 3)]), k([(12, 7), (5, 0), (3, 3)]), k([(8, 6), (4, 1), (5, 0), (3, 3)])
    ms = (7 + ks * .5) / (17 + ks)
    md = (7 + kd * ms) / (12 + kd)
    a, b = 6 + kh * md, 2 + kh * (1 - md)
    p = a / (a + b)
    assert math.isclose(got["a.x.com"].bound, p - U.Z * math.sqrt(p * (1 - p) / (a + b + 1)), rel_tol=1e-9)


def test_oracle(spark):
    from tools.oracle_check import check
    assert "op4_url_filter" in ORACLES and check(spark, SF, ["op4_url_filter"])["op4_url_filter"]["match"]

"""Brute force: the Column-expression cleaners and rules against a plain
Python statement of the same semantics, on generated strings (one Spark job
per batch, not per example)."""

import random
import re

from pyspark.sql import functions as F

from scrubline.functions import rules as R
from scrubline.operators import clean as C


def _py_phone(v):
    if v is None:
        return None
    d = re.sub(r"[^0-9]", "", v)
    if len(d) == 10:
        return "+1" + d
    if len(d) == 11 and d.startswith("1"):
        return "+" + d
    return v


def _py_code(v):
    if v is None:
        return None
    s = v.strip().upper().replace(" ", "")
    if re.fullmatch(r"[A-Z][0-9]{3,4}", s):
        s = s[:3] + "." + s[3:]
    return s if re.fullmatch(r"[A-Z][0-9]{2}(\.[0-9]{1,2})?", s) else v


def _gen(rng, alphabet, n=400, maxlen=16):
    out = [None]
    for _ in range(n):
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, maxlen))))
    return out


def test_phone_against_python(spark):
    rng = random.Random(11)
    vals = _gen(rng, "0123456789()-. +1x", maxlen=18)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, phone string")
    got = {r.k: r.phone for r in C.standardize_phone(df).collect()}
    assert all(got[i] == _py_phone(v) for i, v in enumerate(vals))
    bad = {r.k for r in df.where(R.phone_not_e164().predicate(df)).collect()}
    exp = {i for i, v in enumerate(vals) if v is not None and not re.match(r"^\+1[0-9]{10}$", v)}
    assert bad == exp


def test_code_against_python(spark):
    rng = random.Random(5)
    vals = _gen(rng, "aAbCdE0123456789. ", maxlen=8)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, icd10_code string")
    got = {r.k: r.icd10_code for r in C.fix_code_format(df).collect()}
    assert all(got[i] == _py_code(v) for i, v in enumerate(vals))
    bad = {r.k for r in df.where(R.code_format().predicate(df)).collect()}
    exp = {i for i, v in enumerate(vals) if not re.match(r"^[A-Z][0-9]{2}\.[0-9]{1,2}$", v or "")}
    assert bad == exp


def test_blank_and_case_against_python(spark):
    rng = random.Random(3)
    vals = _gen(rng, " \t\nabAB@.", maxlen=6)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, s string")
    blank = {r.k for r in df.where(R.blank_cells(["s"]).predicate(df)).collect()}
    assert blank == {i for i, v in enumerate(vals) if v is None or v.strip() == ""}
    upper = {r.k for r in df.where(R.not_lower("s").predicate(df)).collect()}
    assert upper == {i for i, v in enumerate(vals) if v is not None and v != v.lower()}
    low = {r.k: r.s for r in C.lowercase(df, ["s"]).collect()}
    assert all(low[i] == (None if v is None else v.lower()) for i, v in enumerate(vals))


def test_numeric_coercion_against_python(spark):
    vals = [" 1 ", "abc", "-1", "1e3", "1d", "", ".5", "5.", "+2", "inf", "-inf", "nan", "1,000", "0x10", None]

    def py(v):
        try:
            x = float(v)
        except (TypeError, ValueError):
            return None
        if x != x:
            return None
        return x
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, price string")
    from scrubline.functions import exprs as X
    got = {r.k: r.v for r in df.select("k", X.num_col(df, "price").alias("v")).collect()}
    assert all(got[i] == py(v) for i, v in enumerate(vals)), (got, [py(v) for v in vals])

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import pitman_yor as P
from scrubline.llm.common import BATCH, TIDY
from scrubline.session import exists, leased

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Contract columns of (id, text, train) rows but the model's score."""
    toks = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t, _ in rows]
    c = Counter(w for (_, _, train), ws in zip(rows, toks) if train for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, bool(tr), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, _, tr), ws in zip(rows, toks)]


def near(got, want):
    key = lambda r: (str(r[0]), r[2], r[1], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


def test_seating_follows_the_restaurant_rule():
    """Mean number of tables against customers seated one at a time."""
    rng = np.random.default_rng(1)
    customers, base, d, strength, others = np.array([1, 2, 5, 40, 300]), 0.3, 0.6, 2.0, 3.0
    fast = np.mean([P.seat(rng, customers, np.full(5, base), np.full(5, strength), d, np.full(5, others)) for _ in range(3000)], axis=0)
    slow = np.zeros(5)
    for _ in range(1500):
        for k, c in enumerate(customers):
            t = 1
            for n in range(1, c):
                new = (strength + d * (others + t)) * base
                t += rng.random() < new / (new + n - d * t)
            slow[k] += t / 1500
    assert np.allclose(fast, slow, rtol=0.06)


def test_contract_columns_and_edges(spark):
    rng = random.Random(2)
    vocab = [f"W{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choices(vocab, weights=range(50, 0, -1), k=rng.choice([0, 1, 5, 200]))), rng.random() < .8) for k in range(80)]
    rows += [(200, None, True), (201, "", False), (None, "w1 unseen É", False), (3, "w1", True), (3, "w1", True), (202, "w2 " * 20_000, False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train boolean, score string").repartition(4)
    out = P.score_texts(df, F.col("train")).collect()
    near([(r.id, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out], brute(rows))
    assert all(r.score <= 0 and math.isfinite(r.score) for r in out)
    assert P.score_texts(df.limit(0), F.col("train")).count() == 0
    none = P.score_texts(df, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in none)


def test_probabilities_sum_to_one(spark):
    """One frequent word is a context, all others are not: every step can be told
    from the scores of texts of one and two words."""
    rng = random.Random(7)
    others = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(w for _ in range(30) for w in ("a", rng.choice(others))), True) for k in range(30)]
    words = [*others, "unknown"]
    rows += [(100 + k, w, False) for k, w in enumerate(words)] + [(200 + k, f"a {w}", False) for k, w in enumerate(words)]
    rows += [(300, "", False), (301, "a", False), (302, "a a", False)]
    s = {r.id: 10 ** r.score for r in P.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), F.col("train"), most=3).collect()}
    end = s[300]
    root = [s[100 + k] / end for k in range(len(words))]
    a = 1 - sum(root) - end
    assert a > 0.2
    end_after_a = s[301] / a
    after = [s[200 + k] / a / end for k in range(len(words))] + [end_after_a, s[302] / a / end_after_a]
    assert math.isclose(sum(after), 1, rel_tol=1e-4)


def test_contexts_help(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(30)]
    follow = {w: rng.sample(vocab, 3) for w in vocab}

    def text(n):
        w = [rng.choice(vocab)]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]) if rng.random() < .9 else rng.choice(vocab))
        return " ".join(w)
    rows = [(k, text(60), k < 60) for k in range(80)]
    out = [r for r in P.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), F.col("train")).collect() if not r.train]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 500


def test_rare_words_are_contexts(spark):
    """2,000 words, each a small share of the tokens, each with one follower."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"a{j} b{j}" for j in rng.sample(range(2000), 100)), True) for k in range(100)]
    rows += [(1000 + k, " ".join(f"a{j} b{j}" for j in rng.sample(range(2000), 50)), False) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    out = [r for r in P.score_texts(df, F.col("train")).collect() if not r.train]
    # a follower costs almost nothing: half of the words are foreseen
    assert sum(r.score for r in out) > 0.65 * sum(r.base_score for r in out)


def test_shares_and_buckets_make_the_same_model(spark):
    """Dishes dealt into many buckets and shares: probabilities still sum to one,
    and with all contexts scores are those of one bucket but for sampling."""
    rng = random.Random(5)
    words = [*(f"w{k}" for k in range(40)), "unknown"]
    rows = [(k, " ".join(w for _ in range(30) for w in ("a", rng.choice(words[:-1]))), True) for k in range(30)]
    rows += [(100 + k, w, False) for k, w in enumerate(words)] + [(200 + k, f"a {w}", False) for k, w in enumerate(words)]
    rows += [(300, "", False), (301, "a", False), (302, "a a", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    many = {"bucket_tokens": 300, "share": 25, "block_words": 400}
    s = {r.id: 10 ** r.score for r in P.score_texts(df, F.col("train"), most=3, **many).collect()}
    root = [s[100 + k] / s[300] for k in range(len(words))]
    a = 1 - sum(root) - s[300]
    after = [s[200 + k] / a / s[300] for k in range(len(words))] + [s[301] / a, s[302] / s[301]]
    assert a > 0.1 and math.isclose(sum(after), 1, rel_tol=1e-4)
    one, dealt = ({r.id: r.score for r in P.score_texts(df, F.col("train"), **kind).collect()} for kind in ({}, many))
    assert abs(sum(one.values()) - sum(dealt.values())) < 0.02 * abs(sum(one.values()))


def test_block_size_does_not_matter_for_counts(spark):
    rows = [(k, f"a b{k % 3} c " * (k % 5), k % 4 > 0) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    near([(r.id, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in P.score_texts(df, F.col("train"), block_words=50).collect()], brute(rows))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs]
    out = P.op7_pitman_yor(spark, sf).collect()
    near([(r.doc_id, not r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out], brute(rows))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_steps_leave_no_files_behind(spark):
    """A written step's shuffle files go with it, and the model's tables when the
    answers are there; the settings are as before."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        it, n = files.getAllFiles().iterator(), 0
        while it.hasNext():
            n += it.next().getName().startswith("shuffle_")
        return n
    rows = [(k, f"a b{k % 3} c{k % 5} " * 5, k % 4 > 0) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    settings = {k: spark.conf.get(k) for k in (TIDY, BATCH)}
    before = shuffled()
    with leased(spark) as held:
        out = P.score_texts(df, F.col("train"))
        assert {k: spark.conf.get(k) for k in settings} == settings
        # the collected totals shuffle a few figures; no step's rows stay
        assert shuffled() - before <= 8
        there = [path.rsplit("/", 1)[1] for path in held if exists(spark, path)]
        assert any(name.startswith("lm-answers") for name in there)
        assert not any(name.startswith(("lm-dishes", "lm-pass")) for name in there)
        assert out.count() == 40


def test_pairs_of_a_block_in_little_memory():
    """Equal to one sort of all tokens' pairs, within 36 bytes a token."""
    rng = np.random.default_rng(4)
    n, words = 4_000_000, np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    codes, lengths, train = (rng.integers(0, 300, n) * rng.integers(0, 2, n)).astype(np.int32), np.array([n - 5, 1, 4], np.int32), np.array([True, False, True])
    spec = {"heads": None, "heavy": words[:1], "shares": np.array([3], np.uint64), "buckets": 7}
    tracemalloc.start()
    code, before, own, bucket, where = P._pairs(words, codes, lengths, train, spec)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    last = np.append(0, codes[:-1] + 1)
    last[[0, n - 5, n - 4]] = 0
    assert (code[where] == codes).all() and (before[where] == last).all()
    assert len(code) == len(np.unique(codes.astype(np.int64) * 301 + last))
    assert (own == np.bincount(where[np.repeat(train, lengths)], minlength=len(code))).all()
    assert (bucket == P._deal(words[code], np.append(P.END, words)[before], spec)).all() and (np.diff(bucket) >= 0).all()
    assert peak < 36 * n, peak / n
    for x in (np.zeros(0, np.int64), rng.integers(0, 50, 30_000), np.sort(rng.integers(0, 1 << 40, 30_000)).astype(np.uint64)):
        known, at = P._numbered(x, 2048)
        assert (known == np.unique(x)).all() and (known[at] == x).all()

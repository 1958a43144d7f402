import hashlib
import random
import re

import numpy as np
import pytest

from scrubline.llm import substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=50):
    """(id, n_words, n_removed, kept) straight from the contract."""
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    no = (1 << 63) - 1
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            least[key] = min(least.get(key, no), no if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k:k + size])] < (no if i is None else i):
                gone[k:k + size] = True
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(300)] + ["É", "x\x1cy"]
    make = lambda n: rng.choices(vocab, k=n)
    passages = [make(n) for n in (49, 50, 51, 74, 75, 120, 400)]
    rows = []
    for k in range(120):
        w = make(rng.choice([0, 3, 30, 60]))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            w += p[a:a + rng.choice([len(p), 60])] + make(rng.choice([0, 1, 24, 25, 26]))
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", " \t "]).join(w)))
    rep = make(60)
    rows += [(2000, None), (2001, ""), (None, " ".join(passages[6])), (None, " ".join(passages[6])), (1500, " ".join(rep * 4)), (1500, " ".join(rep)), (1, "a " * 500), (0, "a " * 49), (5, "a " * 50), (-7, " ".join(passages[5])), *rows[:3]]
    rng.shuffle(rows)
    return rows


def test_rolling_hash_is_of_the_words_alone():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 64, 300, np.uint64, endpoint=False)
    for n in (1, 25, 50):
        whole = S.rolling(h, n)
        assert len(whole) == 300 - n + 1
        assert all(S.rolling(h[k:k + n], n)[0] == whole[k] for k in (0, 7, 250))
    assert len(S.rolling(h[:10], 25)) == 0


@pytest.mark.parametrize("chunk,probes", [(1 << 20, 10_000), (3000, 300)])
def test_against_brute_force(spark, monkeypatch, chunk, probes):
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(S, "BUCKET_PROBES", probes)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_words string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in S.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows)]
    assert sorted(map(tuple, S.op10_substring_dedup(spark, sf).collect()), key=str) == sorted(want, key=str)

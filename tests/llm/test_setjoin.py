import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scrubline.llm import components as C
from scrubline.llm import setjoin as S
from scrubline.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k=3, num=9, den=10):
    """(n, component) of each row by comparing all pairs and searching the graph."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                    up[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)] + ["É", "Ça"]
    rows = []
    line = " ".join(rng.choices(vocab, k=30))
    for fam in range(12):
        base = rng.choices(vocab, k=rng.choice([3, 9, 10, 12, 30, 60, 150, 400]))
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                j = rng.randrange(len(w))
                kind = rng.random()
                if kind < .4:
                    w[j] = rng.choice(vocab)
                elif kind < .7:
                    w.insert(j, rng.choice(vocab))
                elif len(w) > 1:
                    del w[j]
            t = " ".join(w)
            rows.append((len(rows), (t + " " + line if rng.random() < .3 else t).swapcase() if rng.random() < .2 else t))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one"), (None, rows[0][1]), (0, rows[0][1]), (None, "lonely words here now")]
    return rows


def test_word_hashes_follow_words():
    texts = ["", None, " a  B\tc\n", "é🙂 x\x0by\x1cz", "aa a", "x" * 3000 + " y"]
    got = list(W.hashed(pa.array(texts), False))
    assert [len(h) for h in got] == [len(WORD.findall(t or "")) for t in texts]
    flat = {}
    for t, h in zip(texts, got):
        for w, v in zip(WORD.findall(t or ""), h):
            assert flat.setdefault(w, v) == v
    assert len(set(flat.values())) == len(flat)
    low = list(W.hashed(pa.array([" a  B\tc\n", "A b C"]), True))
    assert (low[0] == low[1]).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(k, 5) for k in (6, 9, 8)] + [(2, 2)]
    rng.shuffle(links)
    got = dict(map(tuple, C.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 7 for k in [7, *range(300, 340)])
    assert [got[k] for k in (5, 6, 8, 9, 2)] == [5, 5, 5, 5, 2]


def test_pack_round_trip():
    s = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64, endpoint=False))
    assert (S._unpack(S._pack(s)) == (s >> np.uint64(24) << np.uint64(24))).all()


@pytest.mark.parametrize("num,den,k", [(9, 10, 3), (4, 5, 2)])
def test_against_all_pairs(spark, num, den, k, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, S.jaccard_components(df, k=k, num=num, den=den).collect()), key=str)
    assert got == brute(rows, k, num, den)


def test_without_star_rounds(spark, monkeypatch):
    """The blocks alone find every link, too."""
    monkeypatch.setattr(S, "STAR_ROUNDS", 0)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.jaccard_components(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.jaccard_components(df).count() == 0


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(map(tuple, S.op3_jaccard_join(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows)


def test_links_of_near_copies_grow_with_the_group(spark, monkeypatch):
    """200 copies with one word changed, all of them linked: without pivots, the
    blocks alone must not verify all 19,900 pairs."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(200):
        w = list(base)
        w[rng.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows.append((500, "quite another text"))
    seen, verified = [], S.verified

    def counted(pairs, *args):
        seen.append(pairs.count())
        return verified(pairs, *args)
    monkeypatch.setattr(S, "STAR_ROUNDS", 0)
    monkeypatch.setattr(S, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in S.jaccard_components(df).collect()}
    assert out == {k: 0 for k in range(200)} | {500: 500}
    assert 0 < sum(seen) < 6000


def test_pivots_are_the_middles_of_their_groups(spark, monkeypatch):
    """Copies that are linked with the base only: one round with the base as the
    pivot leaves nothing to the blocks."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(150)]
    rows = [(999, " ".join(base))]
    for k in range(60):
        w = list(base)
        for j in rng.sample(range(3, 147, 4), 2):
            w[j] = f"x{k}-{j}"
        rows.append((k, " ".join(w)))
    names, written = [], S.written

    def kept(spark, df, name, *args):
        names.append((name, out := written(spark, df, name, *args)))
        return out
    monkeypatch.setattr(S, "STAR_ROUNDS", 1)
    monkeypatch.setattr(S, "written", kept)
    out = S.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {0}
    assert [df.count() for name, df in names if name == "rest"] == [0]

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrubline.llm import alignment as A
from scrubline.llm import sparse as X
from scrubline.llm import subwords as W
from scrubline.llm.wordcache import per_worker

PATHS = A.default_paths()


@pytest.fixture(scope="module")
def pair():
    return W.Pair(*PATHS, cache_words=50)


def tokens(pair, t):
    """(A's ids, B's ids) by the libraries over the whole text."""
    a, b = pair.a.encode(" " + (t or ""), add_special_tokens=False).ids, pair.b.encode(t or "")
    want = (" " + (t or "")).encode()
    spelled = all(b"".join(map(table.__getitem__, ids)) == want for table, ids in ((pair.a_bytes, a), (pair.b_bytes, b)))
    return (a, b) if t and spelled else ([], [])


def spans(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def brute(pair, rows):
    """The contract's columns, from spans of all tokens compared with each other."""
    linked, found = Counter(), []
    for i, t in rows:
        a, b = tokens(pair, t)
        sa, sb = spans(a, pair.a_bytes), spans(b, pair.b_bytes)
        links = [(x, y) for x, (s, e) in zip(a, sa) for y, (u, v) in zip(b, sb) if s < v and u < e]
        linked.update(links)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, lo = [], 0
        for hi in cuts:
            groups.append(([x for x, (s, e) in zip(a, sa) if lo < e <= hi], [y for y, (s, e) in zip(b, sb) if lo < e <= hi]))
            lo = hi
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((i, len(a), len(b), len(groups), links, sum(len(x) * len(y) for x, y in groups),
                      hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (_, y), n in linked.items():
        top[y] = max(top[y], n)
    return sorted(((i, na, nb, g, len(links), sh, sum(linked[p] == top[p[1]] for p in links), sum(linked[p] for p in links), d)
                   for i, na, nb, g, links, sh, d in found), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]
PIECES = ["a", "b", "the", "é", " ", " ", "  ", "\n", ".", ",", "!?", "'s", "▁", "<s>", "<|endoftext|>", "\x00", " ", "日", "🙂", "1", "12", "Ab", "ing", "\t",
          "　x", " \n", "(", ")", "ß", "\x1c", " ", ". ", ", ", "antidisestablishment", "É", "<0x41>"]


def texts(n=400):
    rng = random.Random(2)
    fixed = [None, "", " ", "a", " a", "a ", "a  b", "Foo. Bar, baz!", "don't we're", "▁x", "x" * 5000, "日本語" * 300, "the cat. " * 500]
    return fixed + ["".join(rng.choices(PIECES, k=rng.randint(1, 40))) for _ in range(n)] + [
        "".join(rng.choices(["the", "and", "Étre", "words", " ", ". ", ", ", "!? ", "; ", " "], k=40)) for _ in range(n)]


def test_words_equal_whole_texts(pair):
    some = texts()
    for _ in range(2):  # the second time some words are known
        na, a, nb, b = pair.encode(pa.array(some, pa.string()))
        ea, eb = np.cumsum(na), np.cumsum(nb)
        got = [(a[i - n:i].tolist(), b[j - m:j].tolist()) for i, n, j, m in zip(ea, na, eb, nb)]
        assert got == [tokens(pair, t) for t in some]
    assert sum(not x for x, _ in got) > 3 and pair.by_word


def test_without_cuts(pair, monkeypatch):
    monkeypatch.setattr(pair, "by_word", False)
    some = texts(20)
    na, a, nb, b = pair.encode(pa.array(some, pa.string()))
    assert [(n, m) for n, m in zip(na, nb)] == [tuple(map(len, tokens(pair, t))) for t in some]


def dense(m):
    out = np.zeros((m.rows, m.columns), int)
    for r in range(m.rows):
        for k in range(m.indptr[r], m.indptr[r + 1]):
            out[r, m.indices[k]] += 1 if m.data is None else m.data[k]
    return out


def matrix(rng, rows, columns, data):
    full = rng.integers(0, 3, (rows, columns)) * (rng.random((rows, columns)) < 0.3)
    r, c = np.nonzero(full)
    return X.Csr(np.append(0, np.cumsum(np.bincount(r, minlength=rows))), c, columns, full[r, c] if data else None)


def test_sparse_products_equal_dense_ones():
    rng = np.random.default_rng(4)
    for trial in range(40):
        n, k, m = rng.integers(1, 9, 3)
        a, b = matrix(rng, n, k, trial % 2), matrix(rng, k, m, trial % 3)
        assert (dense(a.transpose()) == dense(a).T).all()
        got = np.zeros((n, m), int)
        for block in (1, 5, 1000):
            got[:] = 0
            for r, c, v in X.multiply(a, b, block):
                got[r, c] = v
                assert (np.diff(r * m + c) > 0).all()
            assert (got == dense(a) @ dense(b)).all()
        assert X.expansion(a, b).tolist() == [(dense(a)[r] > 0) @ (dense(b) > 0).sum(1) for r in range(n)]


def test_overlaps_by_blocks():
    rng = np.random.default_rng(5)
    a, b = (np.unique(np.append(rng.integers(1, 400, 90), 400)) for _ in range(2))
    sa, sb = list(zip([0, *a], a)), list(zip([0, *b], b))
    want = [(x, y, min(e, v) - max(s, u)) for x, (s, e) in enumerate(sa) for y, (u, v) in enumerate(sb) if s < v and u < e]
    for block in (1, 7, 64, 1 << 20):
        assert list(zip(*(v.tolist() for v in A.overlaps(a, b, block)))) == want


def test_digests_equal_brute_force(spark, pair, monkeypatch):
    rows = list(enumerate(texts(60))) + [(3, "the cat. the cat"), (3, "the cat. the cat"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("pairs", F.lit(1)).repartition(5)
    got = A.digests(df, *PATHS).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(pair, rows)


def test_outputs(spark, pair):
    rows = list(enumerate(texts(40)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shared = defaultdict(set)
    for r in A.shared_links(df, *PATHS).collect():
        shared[r.doc_id].add((r.a, r.b))
    for r in A.align(df, *PATHS).collect():
        t = rows[r.doc_id][1]
        assert (r.a, r.b) == tokens(pair, t)
        sa, sb = spans(r.a, pair.a_bytes), spans(r.b, pair.b_bytes)
        assert all(min(sa[x][1], sb[y][1]) - max(sa[x][0], sb[y][0]) == n for x, y, n in zip(r.link_a, r.link_b, r.link_bytes))
        assert sum(r.link_bytes) == (len((" " + t).encode()) if r.a else 0)
        assert sum(r.group_a) == len(r.a) and sum(r.group_b) == len(r.b)
        want, i, j = set(), 0, 0
        for n, m in zip(r.group_a, r.group_b):
            want |= {(x, y) for x in range(i, i + n) for y in range(j, j + m)}
            i, j = i + n, j + m
        assert shared[r.doc_id] == want and set(zip(r.link_a, r.link_b)) <= want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.digests(none, *PATHS).collect() == [] and A.align(none, *PATHS).collect() == [] and A.shared_links(none, *PATHS).collect() == []


def test_query(spark, pair):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 4000]
    got = {r.doc_id: r for r in A.op13_token_alignment(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        a, b = tokens(pair, t)
        assert (got[i].n_a, got[i].n_b) == (len(a), len(b))
    for w in brute(pair, short):  # what does not depend on the other texts
        assert [got[w[0]][c] for c in ("n_groups", "n_links", "n_shared", "groups_sha256")] == [w[3], w[4], w[5], w[8]]


def test_texts_that_are_not_cut_leave_other_words_alone():
    """A text with two spaces stays whole, and an odd word leaves no letters: what
    stands for them among the words must not change the tokens of the next word."""
    pair = W.Pair(*PATHS)
    for word in ["ertiin", "êretion", "ñqueción", "írrez", "ertiing.", "zx"]:
        pair.forget()
        some = ["a  b", f"3 {word} {word}"]
        na, a, nb, b = pair.encode(pa.array(some))
        got = [(a[:na[0]].tolist(), b[:nb[0]].tolist()), (a[na[0]:].tolist(), b[nb[0]:].tolist())]
        assert got == [tokens(pair, t) for t in some], word


def test_workers_forget_words_after_a_task(spark):
    df = spark.createDataFrame([(k, f"word{k} another{k} thing") for k in range(200)], "doc_id long, text string").repartition(4)
    assert A.digests(df, *PATHS).count() == 200

    def remembered(batches):
        made = per_worker.__kwdefaults__["_made"]
        n = sum(len(c.young) + len(c.old) for key, x in made.items() if key[0].__name__ == "Pair" for c in (x.cores, x.marks, x.odd))
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], ["n"])

    assert spark.range(64).repartition(8).mapInArrow(remembered, "n long").agg(F.max("n")).first()[0] == 0

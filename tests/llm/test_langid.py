import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scrubline.llm import langid as L
from scrubline.llm.common import table

SF = "/root/testdata/sf0.01"


def brute_logp(train: str, text: str) -> list[float]:
    """Interpolated Kneser-Ney by its textbook recursion over dictionaries."""
    pad = " " * 3
    top = Counter()
    s = pad + train
    for i in range(4, len(s)):
        top[s[i - 3:i + 1]] += 1
    counts = {4: top}
    for k in (3, 2, 1):
        left = defaultdict(set)
        for g in counts[k + 1]:
            left[g[1:]].add(g[0])
        counts[k] = Counter({g: len(v) for g, v in left.items()})
    uniform = 1 / (len(counts[1]) + 1)

    def p(c, h):
        k = len(h) + 1
        own = {g: n for g, n in counts[k].items() if g[:-1] == h}
        low = p(c, h[1:]) if h else uniform
        if not own:
            return low
        n1, n2 = (sum(v == j for v in counts[k].values()) for j in (1, 2))
        d = min(max(n1 / max(n1 + 2 * n2, 1), .1), .9)
        return max(own.get(h + c, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * low

    t = pad + text
    return [math.log(p(t[i], t[i - 3:i])) for i in range(4, len(t))]


def test_probabilities_equal_brute_force():
    rng = random.Random(1)
    train = " " + "".join(rng.choices("abcde ", weights=[5, 4, 3, 2, 1, 3], k=400)).strip()
    train = " " + " ".join(train.split())
    key, n = np.unique(L.grams(*L.codes([train])), return_counts=True)
    model = L.kneser_ney(key, np.zeros(len(key), np.int64), n, ["x"])
    for text in ("abc dea", "zzz ab", "eeee d", "a"):
        x, m = L.codes([text])
        got = model.logprobs(L.grams(x, m))[:, 0]
        want = brute_logp(train, " " + text)
        assert np.allclose(got, want, atol=1e-5)


def test_scores_do_not_depend_on_the_batch():
    texts = ["Hello,  world 12", "", "été là", "...", "x" * 5000, " a b "]
    key, n = np.unique(L.grams(*L.codes(["hello world etats la"])), return_counts=True)
    model = L.kneser_ney(key, np.zeros(len(key), np.int64), n, ["x"])
    together, m = model.entropies(texts)
    for k, t in enumerate(texts):
        alone, one = model.entropies([t])
        assert m[k] == one[0] and np.allclose(alone[0], together[k])
    assert m.tolist() == [12, 0, 6, 0, 5000, 4]


@pytest.fixture(scope="module")
def result(spark):
    return L.op1_language_id(spark, SF).toPandas()


def test_held_out_accuracy(spark, result):
    docs = table(spark, SF, "documents").select("doc_id", "lang").toPandas()
    both = result.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    held = both[both.held_out & both.lang.notna()]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() >= 0.98
    assert both.score.between(0, 1).all() and both.rejected.mean() < 0.01


def test_edge_cases_and_rejection(spark):
    docs = table(spark, SF, "documents")
    model = L.train(docs, docs_per_lang=100)
    rng = random.Random(2)
    noise = " ".join("".join(rng.choices("qxzjkvwyh", k=9)) for _ in range(300))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "12 -- !", None), (3, noise, "c")],
                               "doc_id long, text string, lang_pred string")
    got = {(r.doc_id, r.text): r for r in L.identify(df, model).collect()}
    assert len(got) == 4
    for k in ((1, None), (2, ""), (2, "12 -- !")):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert got[3, noise].rejected and got[3, noise].lang_pred != "und"
    clean = L.identify(docs.limit(300), model).where("rejected").count()
    assert clean == 0
    assert L.identify(df.limit(0), model).count() == 0
    empty = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.identify(df, empty).collect()} == {"und"}

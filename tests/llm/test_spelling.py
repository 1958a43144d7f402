import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scrubline.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(vocab, factor=10):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    form, near = {}, {}
    for w in vocab:
        close = [x for x in vocab if one_edit(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= factor * vocab[w] else None
    out = set()
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], vocab.get(form[w])))
    return out


def words_of(rows, noise=31):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def grouped(spark, vocab, **kw):
    rows = spark.createDataFrame(list(vocab.items()), "word string, n long")
    return {tuple(r) for r in S.group(rows, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def variants(rng, word, letters):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1:], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1:]])


def test_groups_equal_brute_force(spark):
    """Many words over few letters, equal halves, runs, chains of forms."""
    rng = random.Random(11)
    vocab = {"aaaaaaa": 5, "aaaaaaaa": 60, "aaaaaaaaa": 700, "abababab": 9000, "abababb": 3, "ÿéàabcd": 4, "ÿéàabce": 44}
    base = ["".join(rng.choices("abé", k=rng.randint(7, 11))) for _ in range(60)]
    for w in base:
        for _ in range(4):
            w = variants(rng, w, "abé")
            if len(w) >= 7:
                vocab[w] = rng.choice([1, 2, 3, 20, 200, 3000])
    want = brute(vocab)
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of two forms
    assert grouped(spark, vocab) == want


def test_words_beyond_the_levels(spark):
    """The same words with tries of few levels, and very long words."""
    rng = random.Random(12)
    vocab = {}
    for _ in range(25):
        w = "".join(rng.choices("ab", k=rng.randint(7, 16)))
        vocab[w] = rng.randint(1, 900)
        for _ in range(3):
            w = variants(rng, w, "ab")
            if len(w) >= 7:
                vocab[w] = rng.randint(1, 900)
    want = brute(vocab)
    for levels in (3, 4, 6, 9):
        assert grouped(spark, vocab, levels=levels) == want
    long = "".join(rng.choices("abcdefgh", k=3000))
    vocab = {long: 50, long[:-1]: 2, long[1:]: 3, long[:1500] + "z" + long[1500:]: 4, long[:31] + "z" + long[32:]: 5, long[:40] + "z" + long[41:2999] + "q": 6,
             long[:2000] + "y" + long[2001:]: 7, "aaaaaaa": 1}
    assert grouped(spark, vocab) == brute(vocab)


def test_hashes_are_those_of_the_letters():
    """A node depends on the prefix alone, a tail on the suffix alone."""
    words = ["abcabcab", "zzabcabcabzz", "abcabca", "ÿ"]
    for backwards in (False, True):
        sp = S.Spelled(words, backwards)
        seen = {}
        for w, text in enumerate(sp.words):
            for p in range(len(text) + 1):
                one = np.array([w]), np.array([p])
                assert seen.setdefault(("node", text[:p]), sp.node(*one)[0]) == sp.node(*one)[0]
                assert seen.setdefault(("tail", text[p:]), sp.tail(*one)[0]) == sp.tail(*one)[0]
        assert len(set(seen.values())) == len(seen)
        assert seen["tail", ""] == 0


def test_vocabulary(spark):
    rng = random.Random(13)
    letters = "abcDEFéÉß×÷ÿÀ"
    rows = [(k % 40, " ".join("".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(30)) + " Wordsword wordsword, wordsword9") for k in range(60)]
    rows += [(None, "nullnull nullnull NULLNULL"), (3, None), (4, ""), (5, "12 !? \n"), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = {r.word: r.n for r in S.vocabulary(docs).collect()}
    assert got == words_of(rows) and got["wordsword"] > 100


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, word string, n long")
    assert S.group(S.vocabulary(docs)).collect() == []
    assert grouped(spark, {"lonelyone": 2}) == {("lonelyone", None, "lonelyone", 2, 0, None)}
    # ties: the smallest word among neighbours of equal n
    assert ("abcdefg", "abcdefh", "abcdefh", 1, 2, 10) in grouped(spark, {"abcdefg": 1, "abcdefi": 10, "abcdefh": 10})


@pytest.mark.parametrize("n", [200])
def test_common_prefix_grows_linearly(spark, n):
    """Words that share all but their last letters: pairs are those one edit apart."""
    vocab = {f"prefixprefix{chr(97 + k % 26)}{chr(97 + k // 26)}": 1 + k for k in range(n)}
    assert grouped(spark, vocab) == brute(vocab)

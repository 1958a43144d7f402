import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrubline.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def ids_of(enc, text):
    return list(memoryview(enc.encode(text)).cast("I"))


def texts():
    rng = random.Random(5)
    fixed = ["", " ", "Hello,  World!! don't we're I'LL 123 4a5", "<|startoftext|>Hi<|endoftext|><|startoftext|>", "a<|endoftext|>b",
             "ΑΣ ΟΔΟΣ σς İstanbul ẞ ǅ é ́x", "tab\tvt\x0bfs\x1cgs\x1dx\x1fy z\xa0w　q", "!" * 5000, "é" * 3000, "日本語テキスト" * 200, "😀👍🏽 ‍ x̀́",
             "a" * 20000, "ab" * 9000 + "!?" * 4000, "\x00\x01\x7f­", "x'sy 's 'S 'T 're’s", "<|startoftext", "٣٤٥ ½ ²"]
    alphabet = "abcdeinthsor .,!'\n\t0123ÉéñüßΣσ日́🙂<|>"
    return fixed + ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(300)]


def test_encode_equals_library(lib):
    enc = B.Encoder(B.load(PATH), cache_words=50)
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids_of(enc, t) == want, t[:80]
        assert B.decode_ids(enc.bpe, enc.encode(t)) == lib.decode(want, skip_special_tokens=False)


def test_transducer_emits_only_stable_tokens():
    bpe = B.load(PATH)
    rng = random.Random(3)
    for alphabet in (b"ab", b"!?.", b"aeinrst", bytes(range(256))):
        data = bytes(rng.choices(alphabet, k=bpe.lookahead * 3 + 500))
        t = B.Transducer(bpe, step=64)
        got = [*t.feed(data), *t.end()]
        assert got == bpe.merge([*(bpe.inner[b] for b in data[:-1]), bpe.final[data[-1]]])


def test_lookahead_of_small_merge_lists_against_brute_force():
    """No continuation may change a token that ends ``lookahead`` before the end."""
    from itertools import product
    rng = random.Random(9)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        for _ in range(rng.randint(1, 6)):
            p = (rng.choice(tokens), rng.choice(tokens))
            if p[0] + p[1] not in tokens:
                merges.append(p)
                tokens.append(p[0] + p[1])
        look = B.sufficient_lookahead(merges)

        def seg(s):
            s = list(s)
            for u, v in merges:
                out = []
                for x in s:
                    if out and out[-1] == u and x == v and not isinstance(out[-1], Done):
                        out[-1] = Done(u + v)
                    else:
                        out.append(x)
                s = [str(x) for x in out]
            return s

        for n in range(1, 8):
            for w in map("".join, product("ab", repeat=n)):
                ends = lambda s: [sum(map(len, s[:k + 1])) for k in range(len(s))]
                here = [e for e in ends(seg(w)) if e <= n - look]
                for more in map("".join, product("ab", repeat=3)):
                    assert [e for e in ends(seg(w + more)) if e <= n - look][:len(here)] == here


class Done(str):
    """A token made by the merge now applied."""


def test_byte_decoder_is_incremental():
    bpe = B.load(PATH)
    enc = B.Encoder(bpe)
    d, got = B.ByteDecoder(bpe), ""
    for i in ids_of(enc, "naïve 日本語 🙂 x"):
        got += d.feed(i)
    assert got + d.end() == "naïve 日本語 🙂 x "


def test_columns_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "Hi there", None), (2, "Hi there", "z")],
                               "doc_id long, text string, token_ids string")
    out = B.decode(B.encode(df, PATH), PATH, joined=False).orderBy("decoded").select("doc_id", F.octet_length("token_ids"), "decoded").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 0, ""), (2, 0, ""), (None, 8, "hi there "), (2, 8, "hi there ")], key=str)
    assert B.digests(df.limit(0), PATH).count() == 0


def test_query_against_library(spark, lib):
    import hashlib
    import struct
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = B.op8_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()

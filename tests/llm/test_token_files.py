import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_bpe import texts
from tokenizers import Tokenizer

from scrubline.llm import token_files as K
from scrubline.llm import wordcache as W

PATH = K.default_path()


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def whole(lib, t):
    return lib.encode(t or "", add_special_tokens=False).ids


def test_word_encoder_equals_library(lib):
    rng = random.Random(3)
    alphabet = "abcXYZéÉßÿÀ×÷' \u0085 \x1c \t\n019.,!<|>İΣ́日"
    some = [None, *texts(), *("".join(rng.choices(alphabet, k=rng.randint(0, 200))) for _ in range(400)), "x" * 300_000, "it's I'LL l'été"]
    enc = W.WordEncoder(PATH, cache_words=40)
    for _ in range(2):  # the second time some words are known
        n, ids = enc.encode(pa.array(some, pa.string()))
        end = np.cumsum(n)
        assert [ids[e - k:e].tolist() for e, k in zip(end, n)] == [whole(lib, t) for t in some]
    assert max(len(enc.words.young), len(enc.words.old), len(enc.pieces.young)) <= 40


def test_other_builds_go_through_the_library(lib):
    enc = W.WordEncoder(PATH.replace("word_bpe_49k", "byte_bpe_50k"))
    assert not enc.by_word
    n, ids = enc.encode(pa.array(["Hello  world", None], pa.string()))
    assert n.tolist() == [len(ids), 0]


def test_slices_cover_all_rows():
    arr = pa.array(["a" * (k % 7) for k in range(10_000)])
    got = [(k, len(s)) for k, s in W.slices(arr)]
    assert [k for k, _ in got] == np.cumsum([0, *(n for _, n in got[:-1])]).tolist() and sum(n for _, n in got) == 10_000
    assert [len(s) for _, s in W.slices(pa.array(["x" * W.SLICE_BYTES * 2, "y", "z"]))] == [1, 2]
    assert list(W.slices(pa.array([], pa.string()))) == []


ROWS = [(5, "five five", "en"), (3, None, None), (None, "null id", "de"), (3, "three", "fr"), (3, "three", "fr"), (-1, "", "en"),
        (9, "long word " * 5000, "en"), (7, "été <|endoftext|> ok", None)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    out = {}
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    for encoding in ("dictionary", "delta"):
        path = str(tmp_path_factory.mktemp("tokens") / encoding)
        K.write(df, path, PATH, keep=["lang"], encoding=encoding, page_rows=2)
        out[encoding] = path
    return out


def test_rows_and_starts(spark, written, lib):
    for path in written.values():
        rows = sorted(K.read(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
        at = 0
        for r in rows:
            assert (r.start, r.n_tokens) == (at, len(r.tokens))
            at += r.n_tokens
        got = sorted((str(r.doc_id), r.tokens, str(r.lang)) for r in rows)
        assert got == sorted((str(i), [*whole(lib, t), 2], str(la)) for i, t, la in ROWS)


def test_layout(spark, written):
    import glob
    for encoding, path in written.items():
        kinds = set()
        for f in glob.glob(f"{path}/tokens/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    col = meta.row_group(g).column(c)
                    assert col.has_column_index and col.has_offset_index
                    if col.path_in_schema == "tokens.list.element":
                        kinds |= set(col.encodings)
                    if col.path_in_schema in ("doc_id", "start"):
                        assert "DELTA_BINARY_PACKED" in col.encodings
        assert ("RLE_DICTIONARY" in kinds) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in kinds) == (encoding == "delta")


def test_row_groups_follow_their_size(spark, tmp_path):
    """Group sizes are held in the file, not only asked for."""
    import glob
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma", "x", "yy", "12"], k=300))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    groups = {}
    for size in (64 << 10, 64 << 20):
        K.write(df, f"{tmp_path}/{size}", PATH, row_group_bytes=size, page_bytes=8 << 10, page_rows=100)
        groups[size] = sum(pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{tmp_path}/{size}/tokens/*.parquet"))
    assert groups[64 << 10] > groups[64 << 20]


def test_selective_reads(spark, written):
    path = written["dictionary"]
    rows = sorted(K.read(spark, path).collect(), key=lambda r: r.start)
    stream = [i for r in rows for i in r.tokens]
    for lo, hi in ((0, 1), (3, 12), (0, len(stream)), (len(stream) - 2, len(stream) + 9), (7, 7), (20_000, 30_000)):
        cut = sorted(K.span(spark, path, lo, hi).collect(), key=lambda r: r.start)
        assert [i for r in cut for i in r.tokens] == stream[lo:hi]
        assert all(r.tokens == stream[r.start:r.start + r.n_tokens] for r in cut)
    assert sorted(r.doc_id for r in K.documents(spark, path, ids=[3, 9]).collect()) == [3, 3, 3, 9]
    assert sorted(r.doc_id for r in K.documents(spark, path, first=4, last=7).collect()) == [5, 7]
    plan = K.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.split("ReadSchema: ")[1].split("\n")[0].replace("n_tokens", "")
    plan = K.documents(spark, path, ids=[3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan


def test_crc(spark, written):
    rows = K.read(spark, written["delta"]).select("tokens", K.ids_crc32("tokens").alias("c")).collect()
    assert all(r.c == zlib.crc32(struct.pack(f"<{len(r.tokens)}I", *r.tokens)) for r in rows)


def test_hot_id_is_split(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    try:
        assert K.encode(df, PATH).select("part").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    K.write(none, f"{tmp_path}/none", PATH)
    assert K.read(spark, f"{tmp_path}/none").count() == 0 and K.parts(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        K.write(none.withColumn("start", F.lit(1)), f"{tmp_path}/x", PATH, keep=["start"])
    with pytest.raises(ValueError):
        K.write(none, f"{tmp_path}/x", PATH, encoding="plain")


def test_query(spark, lib):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in K.op12_token_files(spark, sf).collect()}
    at = 0
    for k in sorted(docs):
        ids = [*whole(lib, docs[k]), 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(got) == len(docs)

import hashlib
import struct

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from scrubline.llm import secrets
from scrubline.llm.common import written
from test_decontam import ITEM
from test_setjoin import brute

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    """A small corpus with one case for each stage, among clean documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(300).collect()
    base = next(r for r in some if 100 < len((r.text or "").split()) < 400)
    near = base.text + " tail"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some]
    rows += [(10_000, "qxzj kvwq zxqj " * 300, None, "s", 1), (10_001, None, None, None, None), (10_002, near, "en", "s", 1),
             (10_003, f"{base.text[:200]} {ITEM}", base.lang, "s", 1), (10_004, f"{some[0].text[:150]} token = 'abcdefgh12345678'", some[0].lang, "s", 1)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in P.STAGES[:-1]:
        path = f"{sf}/{name}"
        stage(spark, df, sf).write.parquet(path)
        df = spark.read.parquet(path)
        assert df.columns == docs.columns
        left[name] = {r.doc_id: r.text for r in df.collect()}
    first = left["language_id"]
    assert 10_000 not in first and 10_001 not in first
    assert set(first) >= {r.doc_id for r in some if r.text and any(c.isalpha() for c in r.text)}
    keep = {i for i, _, c in brute([(k, t) for k, t in first.items()], 5, 4, 5) if c == i}
    assert set(left["jaccard_join"]) == keep and 10_002 not in keep
    assert 10_003 in keep and 10_003 not in left["decontaminate"]
    assert set(left["secrets"]) == set(left["decontaminate"])
    assert left["secrets"][10_004].endswith("[secret]'")
    assert secrets.scan(df, secrets.BASE[1:]).where(F.size("spans") > 0).count() == 0
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = {r.doc_id: r for r in P.STAGES[-1][1](spark, df, sf).collect()}
    assert set(last) == set(left["secrets"])
    for k, t in left["secrets"].items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert last[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_near_copies_of_five_words(spark):
    """96 words, two changed far apart: 82 of 102 five-word shingles shared
    (0.804), 88 of 100 of three words (0.88, below op3's threshold)."""
    words = [f"w{k}" for k in range(96)]
    near, far = list(words), list(words)
    for k in (30, 60):
        near[k] = f"x{k}"
    for k in (20, 40, 60):
        far[k] = f"y{k}"
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(far), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.jaccard_join(spark, docs, "").collect()) == [1, 3]


def test_empty_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_written_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])
    df = spark.range(0, 100, 1, 2).mapInArrow(sizes, "n long")
    got = [r.n for r in written(spark, df, "batches", 7).collect()]
    assert sum(got) == 100 and max(got) == 7
    assert max(r.n for r in df.collect()) == 50

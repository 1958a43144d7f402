"""A corpus pipeline: STAGES are (name, function) pairs; each function takes
(spark, docs, sf_dir) and returns a DataFrame that the next one gets as docs,
written as Parquet in between. All but the last return the columns of documents.

1. language_id: texts that the language models reject leave.
2. jaccard_join: of each component of near copies (Jaccard similarity of 0.8 or
   more on five-word shingles) the smallest id stays.
3. decontaminate: documents that hold a benchmark item leave.
4. secrets: spans are replaced by a mark, n_chars follows the text.
5. bpe: token ids and what they decode to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import bpe, decontam, langid, secrets, setjoin
from scrubline.llm.common import fold, table, written

#: The last stage shares its executors with what the others left there, so it keeps
#: the ids of fewer words than op8; texts go to Python in small batches in all stages.
CACHED_WORDS, BATCH_ROWS = 100_000, 1024
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models are learned from the labelled texts of the stage's own input."""
    model = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    return langid.identify(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose id is their component's id stay; rows without an id, too."""
    parts = setjoin.jaccard_components(docs, k=5, num=4, den=5)
    gone = parts.where("component_id IS NOT NULL AND doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("leaked")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(secrets.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given = docs.select("doc_id", "lang", "source", "text")
    done = bpe.round_trip(given, bpe.default_path(), keep_text=False, cache_words=CACHED_WORDS)
    return done.select("doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontaminate", decontaminate), ("secrets", redact_secrets), ("bpe", encode)]
#: Language models and byte-pair encoding have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reduce(lambda df, stage: written(spark, stage[1](spark, df, sf_dir), f"stage-{stage[0]}", BATCH_ROWS), STAGES, docs)

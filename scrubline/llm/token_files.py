"""Token files: ids as Parquet list columns, laid out for selective reads.

A token set is a folder of two tables.

``tokens``: a row a document in ascending order of (id, text hash), a file a
range of ids. Columns: ``part`` (number of the file's range), the id,
``start`` (ids of the part before this document), ``n_tokens``, ``tokens``
(``array<int>``), and metadata columns that the caller keeps. The layout is set:

- ``encoding="dictionary"`` gives the list values a dictionary and bit-packed
  indices (a vocabulary of up to 262,144 ids fits a dictionary page of 1 MB);
  ``"delta"`` writes them as DELTA_BINARY_PACKED. The sorted columns ``id`` and
  ``start`` are always delta packed, which suits their small steps;
- row groups of ``row_group_bytes`` bound what a reader holds, pages of
  ``page_rows`` documents bound what it decodes; the column and offset indexes
  that the writer adds for every page let a filter on id or start skip pages.

``parts``: a row a file range with its first and last id, its documents and tokens,
and ``base``, the number of ids in all parts before it. A document's position
in the whole stream of ids is ``base + start``; so no pass over all documents,
and no global window, is needed to number them.

Reading: :func:`documents` (rows of given ids or a range of ids: filters on the id
reach the scan), :func:`span` (ids lo..hi of the stream: ``parts`` names the
files, a filter on part and start the pages) and :func:`metadata` (never reads
``tokens``).

Scale: texts are range-partitioned by (id, text hash), so that equal ids (a third
of all rows may carry one id) are split like others; boundaries come from
Spark's sample of those two numbers. Encoding follows that one shuffle. ``parts``
holds one row a file; numbering them is the only single task, over files, not rows.

Edge cases: a null or empty text -> the end id alone; a null id sorts first;
rows of equal id are ordered by their text's hash, equal rows may stand in
either order; an empty table -> empty files, no parts; kept columns named like
those of the format raise ValueError. A text of any length is one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.session import scratch_path

from .common import small, table
from .wordcache import WordEncoder, per_worker, slices

END_ID = 2
#: Layout of the files.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS, DICTIONARY_BYTES = 32 << 20, 1 << 20, 512, 1 << 20
_OWN = ("part", "start", "n_tokens", "tokens")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int | None = END_ID,
           keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the ``tokens`` table, in the order in which they are to be written."""
    clash = sorted({id, *keep} & set(_OWN)) + [c for c in keep if c == id]
    if clash:
        raise ValueError(f"columns named like those of the format: {clash}")
    dealt = df.select(F.col(id), *keep, F.col(text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    ordered = dealt.repartitionByRange(F.col(id).asc_nulls_first(), "_hash").sortWithinPartitions(F.col(id).asc_nulls_first(), "_hash")
    given = ordered.select(F.spark_partition_id().alias("part"), id, *keep, "_text")
    kept = [f for f in given.schema.fields if f.name in (id, *keep)]
    out = T.StructType([T.StructField("part", T.IntegerType()), kept[0], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("tokens", T.ArrayType(T.IntegerType())), *kept[1:]])
    names = [f.name for f in kept]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = per_worker(WordEncoder, tokenizer), 0
        for batch in batches:
            for k, texts in slices(batch.column("_text")):
                n, flat = encoder.encode(texts)
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(n), end_id)
                    n = n + 1
                total = np.append(0, np.cumsum(n))
                tokens = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat.astype(np.int32)))
                cut = batch.slice(k, len(texts))
                first, *rest = [cut.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [cut.column("part"), first, pa.array(at + total[:-1]), pa.array(n.astype(np.int64)), tokens, *rest],
                    ["part", names[0], "start", "n_tokens", "tokens", *names[1:]])
                at += int(total[-1])

    return given.mapInArrow(rows, out)


def write(df: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int | None = END_ID,
          keep: Sequence[str] = (), encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
          page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, codec: str = "zstd") -> None:
    """Encode ``df`` and write it as a token set under ``path``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding!r}")
    spark = df.sparkSession
    (encode(df, tokenizer, id, text, end_id, keep).write
     .option("compression", codec)
     .option("parquet.writer.version", "v2")  # delta packed integers wherever there is no dictionary
     .option("parquet.enable.dictionary", "true")
     .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES))
     .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
     .option(f"parquet.enable.dictionary#{id}", "false").option("parquet.enable.dictionary#start", "false")
     .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes))
     .option("parquet.page.row.count.limit", str(page_rows))
     .parquet(f"{path}/tokens"))
    sums = (spark.read.parquet(f"{path}/tokens").groupBy("part")
            .agg(F.min(id).alias("first_id"), F.max(id).alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{path}/parts")


def parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ``tokens`` table with ``start`` counted over the whole set; columns
    that the caller does not select are not read."""
    base = small(parts(spark, path).select("part", "base"), 1_000_000)
    rows = spark.read.parquet(f"{path}/tokens")
    return rows.join(base, "part").withColumn("start", F.col("base") + F.col("start")).drop("base")


def documents(spark: SparkSession, path: str, ids: Sequence | None = None, first=None, last=None, id: str = "doc_id") -> DataFrame:
    """Documents of the given ids, or of first <= id <= last (either may be left out)."""
    rows = read(spark, path)
    if ids is not None:
        rows = rows.where(F.col(id).isin(list(ids)))
    if first is not None:
        rows = rows.where(F.col(id) >= F.lit(first))
    return rows if last is None else rows.where(F.col(id) <= F.lit(last))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path).drop("tokens")


def span(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Ids lo (counted from 0) to hi (exclusive) of the whole stream: a row a
    document that holds some of them, ``start`` and ``tokens`` cut to the span."""
    inside = parts(spark, path).where((F.col("base") < F.lit(hi)) & (F.col("base") + F.col("n_tokens") > F.lit(lo)))
    rows = spark.read.parquet(f"{path}/tokens").join(small(inside.select("part", "base"), 1_000_000), "part")
    start, end = F.col("base") + F.col("start"), F.col("base") + F.col("start") + F.col("n_tokens")
    held = rows.where((start < F.lit(hi)) & (end > F.lit(lo)))
    skip = F.greatest(F.lit(lo) - start, F.lit(0))
    size = F.least(end, F.lit(hi)) - start - skip
    cut = held.withColumns({"tokens": F.slice("tokens", (skip + 1).cast("int"), size.cast("int")), "start": start + skip, "n_tokens": size})
    return cut.drop("base")


@F.arrow_udf(T.LongType())
def ids_crc32(lists: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    flat = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
    end = lists.offsets.to_numpy().astype(np.int64)
    end = (end - end[0]) * 4
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(end[:-1], end[1:])], pa.int64())


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, default_path())
    return read(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("tokens").alias("ids_crc32"))

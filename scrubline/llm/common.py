"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline.session import scratch_path

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


#: Spark's setting by which an execution's shuffle files go when it ends, and the rows of an Arrow batch.
TIDY, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _settings(spark: SparkSession, values: dict) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(spark: SparkSession, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: later
    jobs, and tasks retried after a lost executor, all see the same rows. The
    write's shuffle files go with it. ``batch``: rows of an Arrow batch at most,
    for Python functions over wide rows."""
    return written_at(spark, df, scratch_path(spark, name), batch)


def written_at(spark: SparkSession, df: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    """``written`` to a given path, for callers that remove it themselves."""
    with _settings(spark, {TIDY: "true"} | ({BATCH: str(batch)} if batch else {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Hand a Python worker's free memory back to the system: workers live on
    for later stages, and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``max_rows`` rows in
    it; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bounded_sample(df: DataFrame, by: str, per_group: int, seed_cols: list[str]) -> DataFrame:
    """At most ``per_group`` rows of each value of ``by``, those of the smallest
    hash of ``seed_cols``: repeatable, and independent of partitions. Groups
    are thinned by the hash first, so about three times the bound is shuffled,
    whatever the size of the group. Rows whose ``by`` is null take no part."""
    h = F.xxhash64(*[F.col(c) for c in seed_cols])
    sizes = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_size"))
    # share of the hash range that keeps 3x the bound (plus slack) in expectation
    cut = sizes.select(by, F.least(F.lit(1.0), F.lit(3.0 * per_group + 100) / F.col("_size")).alias("_share"))
    u = (h.cast("double") / F.lit(2.0 ** 64)) + F.lit(0.5)
    thin = df.withColumn("_h", h).withColumn("_u", u).join(small(cut), by).where("_u <= _share")
    w = Window.partitionBy(by).orderBy("_h", *seed_cols)
    return (thin.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_group)
            .drop("_rank", "_h", "_u", "_share"))


#: A key with at least one in HEAVY rows is joined by broadcast (at most HEAVY such keys).
HEAVY, SALTS = 1000, 64


def split_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``left`` with ``right`` (one row a key, ``count`` its rows in
    ``left``, ``total`` all rows), safe when one key holds most rows: heavy keys
    are joined by broadcast, and their rows then pass the shuffled join of the
    others under salts made of ``spread``. ``right`` must not clash with ``left``."""
    new = [c for c in right.columns if c not in (*on, count)]
    is_heavy = F.col(count) * HEAVY >= F.lit(total)
    heavy = right.where(is_heavy).select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_heavy_{c}") for c in new])
    light = right.where(~is_heavy).select(*on, F.lit(0).alias("_salt"), *new)
    near = left.join(F.broadcast(heavy), on, "left")
    salt = F.when(F.col("_hit"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    both = near.withColumn("_salt", salt).join(light, [*on, "_salt"], "left")
    return both.select(*left.columns, *[F.coalesce(f"_heavy_{c}", c).alias(c) for c in new])

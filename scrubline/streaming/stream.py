"""Structured Streaming variants (ST1-ST4).

Row-local cleaners and rule predicates are plain Column expressions, so they
run on a streaming DataFrame unchanged (ST1). Dedup (ST2) and windowed rule
counts (ST3) keep state bounded by a watermark on event time. Statistics for a
stream come from a static table through a stream-static join (ST4) - never from
an aggregate over the unbounded stream.

The query helpers replay the ``events`` table as a file stream with
``trigger(availableNow=True)``, write to a sink under the cluster's checkpoint
folder and return the sink read back as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..functions import rules as R
from ..operators import clean as C
from ..session import exists, scratch_path
from ..sources.io import table_path


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The ``events`` table as a stream; ``ts`` becomes a session-zone timestamp
    (watermarks reject TIMESTAMP_NTZ)."""
    path = table_path(sf_dir, "events")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    name = path.rsplit("/", 1)[-1]
    if all(f.rstrip("/").endswith("/" + name) for f in spark.read.schema(schema).parquet(path).inputFiles()):
        # a single file, by Spark's own listing: a file stream watches its folder
        reader = reader.option("pathGlobFilter", name)
        src = path[:-len(name) - 1]
    else:
        src = path  # a table folder of part files (the usual layout on a cluster)
    return reader.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(query_df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan to completion over what is available; read the sink back."""
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    w = query_df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "complete":
        # complete mode: each micro-batch carries the whole result; keep the last one
        def write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = w.outputMode("complete").foreachBatch(write).start()
    else:
        q = w.outputMode("append").format("parquet").option("path", out).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def window_rule_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 day",
                       time_col: str = "ts") -> DataFrame:
    """ST3 as a streaming DataFrame: rule counts per tumbling event-time window.

    With the watermark, ``outputMode("append")`` emits each window once it can
    no longer change and drops its state - the mode for an endless stream.
    ``complete`` keeps every window and suits bounded replays only.
    """
    ev = stream.withWatermark(time_col, delay)
    nulls = R.null_values("value", "value_null").predicate(ev)
    neg = R.below("value", 0.0, "value_negative").predicate(ev)
    return ev.groupBy(F.window(time_col, window)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(nulls).alias("value_null"),
        F.count_if(neg).alias("value_negative"), F.count_if(F.col("event_type") == "error").alias("error_events"))


def rules_per_window(spark: SparkSession, sf_dir: str, window: str = "1 day", delay: str = "1 day",
                     mode: str = "complete") -> DataFrame:
    """ST3 over a replay of ``events``: complete mode (every window, as the
    batch oracle) or append mode (windows the watermark has closed)."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    # event times are wall-clock (TIMESTAMP_NTZ): window them as UTC instants so
    # day windows start at wall-clock midnight whatever the session time zone
    ev = events_stream(spark, sf_dir).withColumn("ts", F.from_utc_timestamp("ts", tz))
    agg = window_rule_counts(ev, window, delay)
    res = _run(agg, spark, "rules-window", mode=mode)
    start = F.to_utc_timestamp(F.col("window.start"), tz).cast("timestamp_ntz")
    return res.select(start.alias("window_start"), "rows", "value_null", "value_negative", "error_events")


def dedup_within_watermark(stream: DataFrame, keys, time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """ST2 as a streaming DataFrame: drop events repeating a key within the
    late-data bound. State per key lives only until the watermark passes the
    first occurrence plus ``delay``."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: keep one event per (user, type, day); state is dropped once the
    watermark passes the day, so it stays bounded on an endless stream."""
    ev = events_stream(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    d = ev.withWatermark("day", "1 day").dropDuplicates(["user_id", "event_type", "day"])
    res = _run(d.select("user_id", "event_type", "day"), spark, "dedup")
    return res.select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day"))


def dedup_replay(spark: SparkSession, sf_dir: str, delay: str = "3650 days") -> DataFrame:
    """ST2 over a replay: one event of each (user, type); the late-data bound
    covers the whole table, so the keys equal those of the batch."""
    ev = events_stream(spark, sf_dir).select("user_id", "event_type", "ts")
    return _run(dedup_within_watermark(ev, ["user_id", "event_type"], delay=delay).select("user_id", "event_type"), spark, "dedup-within")


def clean_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: cleaners and a rule predicate on a stream, no state."""
    ev = events_stream(spark, sf_dir)
    flagged = ev.withColumn("was_negative", R.below("value", 0.0).predicate(ev))
    cleaned = C.abs_negative(C.lowercase(flagged, ["event_type"]), ["value"])
    res = _run(cleaned.select("event_id", "user_id", "event_type", "value", "was_negative"), spark, "clean")
    return res


def impute_from_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: error events take their user's mean value from the static table."""
    static = spark.read.parquet(table_path(sf_dir, "events"))
    v = F.col("value")
    means = (static.where(v.isNotNull() & ~F.isnan(v)).groupBy("user_id")
             .agg(F.avg("value").alias("_mean")))
    kept = scratch_path(spark, "impute-static-means")  # once, not in every micro-batch
    means.write.parquet(kept)
    means = spark.read.parquet(kept)
    ev = events_stream(spark, sf_dir)
    joined = ev.join(means, "user_id", "left")
    out = joined.select("event_id", "user_id", "event_type",
                        F.round(F.when(F.col("event_type") == "error", F.col("_mean")).otherwise(v), 6).alias("value"))
    return _run(out, spark, "impute-static")


def _by_time(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """``events`` with ``_part``: which of ``parts`` equal spans of time an event lies in."""
    ev = spark.read.parquet(table_path(sf_dir, "events"))
    t = X.micros(F.col("ts"), X.dtype_of(ev, "ts"))
    lo, hi = ev.agg(F.min(t), F.max(t)).first()
    share = (t - F.lit(lo)) / F.lit(float(max((hi or 0) - (lo or 0), 1)))
    return ev.withColumn("_part", F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int"))


def rules_of_closed_windows(spark: SparkSession, sf_dir: str, parts: int = 4, late_every: int = 97, delay: str = "1 day") -> DataFrame:
    """ST3 in append mode over files that arrive one after another. After each arrival the query
    is started anew from its checkpoint and ends when it has read what is there, so open windows
    and the watermark live on in the state store only. A window is written once, when the
    watermark closes it; events of closed windows are late and are dropped.

    Here ``events`` arrives in spans of time; of the first span every ``late_every``-th event comes with the
    last one. Rows: ``kind`` ``closed`` with a window's counts, and one ``late`` with
    the number of late events: those that arrived and are neither in a closed window nor
    in the windows that the state store still holds open.
    """
    tz = spark.conf.get("spark.sql.session.timeZone")
    ev = _by_time(spark, sf_dir, parts)
    dealt = ev.withColumn("_part", F.when((F.col("_part") == 0) & (F.col("event_id") % late_every == 0), parts - 1).otherwise(F.col("_part")))
    src, out, ckpt = (scratch_path(spark, f"closed-windows-{n}") for n in ("in", "out", "ckpt"))
    schema = ev.drop("_part").schema
    for part in range(parts):
        dealt.where(F.col("_part") == part).drop("_part").write.mode("append").parquet(src)
        # wall-clock times windowed as UTC instants, whatever the session time zone
        stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), tz))
        query = (window_rule_counts(stream, "1 day", delay).writeStream.outputMode("append").trigger(availableNow=True)
                 .option("checkpointLocation", ckpt).format("parquet").option("path", out).start())
        query.awaitTermination()
    closed = spark.read.parquet(out)
    opened = spark.read.format("statestore").load(ckpt)
    # a window's state holds its aggregates in their order, the number of rows first
    fields = opened.schema["value"].dataType.fields
    state = F.col("value").cast(T.StructType([T.StructField(f"_{k}", f.dataType) for k, f in enumerate(fields)]))
    held = opened.agg(F.coalesce(F.sum(state["_0"]), F.lit(0)).alias("n")).scalar()
    seen = closed.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).scalar()
    none = F.lit(None).cast("long")
    late = dealt.agg((F.count(F.lit(1)) - seen - held).cast("long").alias("rows")).select(
        F.lit("late").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("window_start"), "rows",
        none.alias("value_null"), none.alias("value_negative"), none.alias("error_events"))
    start = F.to_utc_timestamp(F.col("window.start"), tz).cast("timestamp_ntz")
    return closed.select(F.lit("closed").alias("kind"), start.alias("window_start"), "rows", "value_null", "value_negative", "error_events").unionByName(late)


class VersionedStatistics:
    """ST4 with statistics that are refreshed while a stream runs: versions of a table of
    means per key under ``path``, and for each micro-batch the version that it took. A
    batch takes the newest version that is there when it is first run; run again
    after a failure, it takes the same one, so its rows come out the same."""

    def __init__(self, spark: SparkSession, path: str, key: str, value: str):
        self.spark, self.path, self.key, self.value = spark, path.rstrip("/"), key, value

    def publish(self, version: int, rows: DataFrame) -> None:
        v = F.col(self.value)
        means = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(self.key).agg(F.avg(v).alias("_mean"))
        means.write.mode("overwrite").parquet(f"{self.path}/means/version={version}")

    def taken(self, batch_id: int) -> int:
        """The version of a micro-batch, recorded when it is first asked for."""
        at = f"{self.path}/taken/batch={batch_id}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            newest = self.spark.read.parquet(f"{self.path}/means").agg(F.max("version").cast("int").alias("version"))
            newest.coalesce(1).write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at).first()["version"]

    def means(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/means/version={version}")


def impute_from_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 over two micro-batches: the first half of the time takes statistics of that
    half, the second half those of both, published in between. Each batch
    writes a folder of its own, whole or not at all, so a batch run twice counts once."""
    ev = _by_time(spark, sf_dir, 2)
    src, out, ckpt, stats = (scratch_path(spark, f"impute-versions-{n}") for n in ("in", "out", "ckpt", "stats"))
    schema = ev.drop("_part").schema
    store = VersionedStatistics(spark, stats, "user_id", "value")

    def fill(batch: DataFrame, batch_id: int) -> None:
        version = store.taken(batch_id)
        joined = batch.join(store.means(version), "user_id", "left")
        value = F.when(F.col("event_type") == "error", F.col("_mean")).otherwise(F.col("value"))
        (joined.select("event_id", "user_id", "event_type", value.alias("value"), F.lit(version).alias("version"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    for part in range(2):
        store.publish(part + 1, ev.where(F.col("_part") <= part))
        ev.where(F.col("_part") == part).drop("_part").write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", ckpt).foreachBatch(fill).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")

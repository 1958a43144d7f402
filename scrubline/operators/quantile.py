"""Exact quantiles and modes that stay bounded per task at any scale.

Spark's built-in ``median``/``percentile``/``mode`` keep a map of every distinct
value of a group inside one aggregation buffer; for a whole-table statistic the
final merge is one task holding all distinct values. Here the exact order
statistic is found by *radix selection* over an order-preserving split of each
double into three integer digits:

* ``d1`` - sign, binary exponent and top 10 fraction bits (at most ~4.3M values),
* ``d2`` - the next 21 fraction bits (at most 2M values),
* ``d3`` - the last 21 fraction bits (at most 2M values).

Ordering doubles equals ordering ``(d1, d2, d3)`` lexicographically. Each level
is a map-side-combined ``groupBy(group, digit).count()`` (a key holding a third
of all rows collapses to one partial row per map task), a running sum over at
most ~4.3M rows per group and target, and a filter keeping the bucket where the
wanted rank falls; the next level only counts rows of the chosen bucket (a join
on the digits against a table of at most ``groups x targets`` rows, each used
once so no level is recomputed). Three levels pin the exact value. Every step is deterministic, so a recomputed task
after an executor loss yields the same rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_MASK21 = (1 << 21) - 1
_INF = float("inf")


def with_order_digits(df: DataFrame, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Add ``_v`` (the value, -0.0 as 0.0) and three long digits ``_d1, _d2,
    _d3`` whose lexicographic order equals the order of ``_v``.

    ``value`` must be a non-NULL, non-NaN double column. The digits are built
    in staged projections so that each intermediate (exponent, fraction bits)
    is computed once per row instead of being re-inlined into every digit.
    """
    v = F.col(value) + F.lit(0.0)
    s1 = df.select(*keep, v.alias("_v"), F.abs(v).alias("_a"))
    finite_pos = (F.col("_a") > 0) & (F.col("_a") < F.lit(_INF))
    s2 = s1.select(*keep, "_v", "_a", F.when(finite_pos, F.col("_a")).otherwise(F.lit(1.0)).alias("_s"))
    s3 = s2.select(*keep, "_v", "_a", "_s", F.floor(F.log2("_s")).cast("int").alias("_e0"))
    s4 = s3.select(*keep, "_v", "_a", "_s", "_e0", (F.col("_s") / F.pow(F.lit(2.0), F.col("_e0"))).alias("_r0"))
    # log2 may be off by one next to powers of two; correct so that 1 <= m < 2
    e = F.when(F.col("_r0") >= 2.0, F.col("_e0") + 1).when(F.col("_r0") < 1.0, F.col("_e0") - 1).otherwise(F.col("_e0"))
    s5 = s4.select(*keep, "_v", "_a", "_s", e.alias("_e"))
    frac = ((F.col("_s") / F.pow(F.lit(2.0), F.col("_e")) - F.lit(1.0)) * F.lit(float(1 << 52))).cast("long")
    s6 = s5.select(*keep, "_v", "_a", "_e", frac.alias("_f"))
    inf = F.col("_a") == F.lit(_INF)
    zero = F.col("_a") == 0
    neg = F.col("_v") < 0
    mag = ((F.when(inf, F.lit(1100)).otherwise(F.col("_e")) + F.lit(1100)).cast("long") * F.lit(1024)
           + F.when(inf, F.lit(0)).otherwise(F.shiftright("_f", 42)))
    mid = F.shiftright("_f", 21).bitwiseAND(F.lit(_MASK21))
    low = F.col("_f").bitwiseAND(F.lit(_MASK21))
    flat = zero | inf
    return s6.select(
        *keep, "_v",
        F.when(zero, F.lit(0)).when(neg, -mag).otherwise(mag).cast("long").alias("_d1"),
        F.when(flat, F.lit(0)).when(neg, F.lit(_MASK21) - mid).otherwise(mid).cast("long").alias("_d2"),
        F.when(flat, F.lit(0)).when(neg, F.lit(_MASK21) - low).otherwise(low).cast("long").alias("_d3"))


def _aliased_on(keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        c = F.col(f"_L.{k}").eqNullSafe(F.col(f"_R.{k}"))
        cond = c if cond is None else cond & c
    return cond


#: A selection or statistics table of at most this many rows is broadcast.
MAX_BROADCAST_ROWS = 100_000


def settled(small: DataFrame) -> DataFrame:
    """A derived table written once to the shared scratch folder, counted, and
    marked for broadcast if it is small enough, so that the big side of its join
    is not shuffled; a larger one is joined by a shuffle. Runs one job."""
    spark = small.sparkSession
    path = scratch_path(spark, "settled")
    small.write.parquet(path)
    kept = spark.read.schema(small.schema).parquet(path)
    return F.broadcast(kept) if kept.count() <= MAX_BROADCAST_ROWS else kept


def _targets_in_bucket(data: DataFrame, sel: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    """Pair every row of a chosen bucket with the rank targets that chose it.

    ``sel`` holds at most ``len(targets)`` rows per group, so with bounded
    groups it is broadcast, and otherwise if a count finds it small; each data
    row outside the chosen buckets is dropped by the join. ``sel`` is used
    exactly once, so no level of the selection is recomputed.
    """
    # bounded: at most len(targets) rows per group
    sel = F.broadcast(sel) if bounded else settled(sel)
    data_cols = [c for c in data.columns if c not in keys]
    sel_cols = [c for c in sel.columns if c not in keys]
    return data.alias("_L").join(sel.alias("_R"), _aliased_on(keys), "inner").select(
        *[F.col(f"_L.{c}").alias(c) for c in keys], *[F.col(f"_L.{c}").alias(c) for c in data_cols],
        *[F.col(f"_R.{c}").alias(c) for c in sel_cols])


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float],
                    group_cols: Sequence[str] = (), bounded_groups: bool = False,
                    median_names: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group.

    Returns one row per group that has at least one non-NULL value, with
    ``group_cols``, ``n`` (non-NULL count) and one double column per entry of
    ``quantiles``. Names in ``median_names`` use the mean of the two middle
    values (``(lo + hi) / 2``), as a median does.

    ``bounded_groups`` declares that the number of groups is known to be small
    (e.g. one group per column of a table), which lets the selection tables be
    broadcast explicitly; otherwise AQE chooses the join from runtime sizes.
    """
    if df.isStreaming:
        raise ValueError("exact quantiles are batch-only: use them inside writeStream.foreachBatch")
    G = list(group_cols)
    bounded = bounded_groups or not G
    v = F.col(value).cast("double")
    data = with_order_digits(df.where(v.isNotNull() & ~F.isnan(v)).select(*G, v.alias("_x")), "_x", G)

    # ---- level 1: histogram over d1, rank targets from the group size
    h1 = data.groupBy(*G, "_d1").agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(*G) if G else Window.partitionBy()
    w1 = wg.orderBy("_d1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h1 = h1.withColumn("_cum", F.sum("_c").over(w1)).withColumn("_n", F.sum("_c").over(wg))
    targets = []
    for name, q in quantiles.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        targets.append(F.struct(F.lit(f"{name}__lo").alias("tag"), (F.floor(pos) + 1).cast("long").alias("rank")))
        targets.append(F.struct(F.lit(f"{name}__hi").alias("tag"), (F.ceil(pos) + 1).cast("long").alias("rank")))
    t1 = h1.withColumn("_t", F.explode(F.array(*targets)))
    sel1 = (t1.where((F.col("_cum") - F.col("_c") < F.col("_t.rank")) & (F.col("_t.rank") <= F.col("_cum")))
            .select(*G, F.col("_t.tag").alias("_tag"), F.col("_n"),
                    (F.col("_t.rank") - (F.col("_cum") - F.col("_c"))).alias("_r"), "_d1"))

    # ---- level 2: inside the chosen d1 bucket, histogram over d2 (per target)
    keys1 = G + ["_d1"]
    j2 = (_targets_in_bucket(data.select(*keys1, "_d2"), sel1, keys1, bounded)
          .groupBy(*G, "_tag", "_n", "_r", "_d1", "_d2").agg(F.count(F.lit(1)).alias("_c")))
    w2 = Window.partitionBy(*G, "_tag").orderBy("_d2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j2 = j2.withColumn("_cum", F.sum("_c").over(w2))
    sel2 = (j2.where((F.col("_cum") - F.col("_c") < F.col("_r")) & (F.col("_r") <= F.col("_cum")))
            .select(*G, "_tag", "_n", (F.col("_r") - (F.col("_cum") - F.col("_c"))).alias("_r"), "_d1", "_d2"))

    # ---- level 3: inside the chosen (d1, d2) bucket, histogram over d3 = exact value
    keys2 = G + ["_d1", "_d2"]
    j3 = (_targets_in_bucket(data.select(*keys2, "_d3", "_v"), sel2, keys2, bounded)
          .groupBy(*G, "_tag", "_n", "_r", "_d3").agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_val")))
    w3 = Window.partitionBy(*G, "_tag").orderBy("_d3").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j3 = j3.withColumn("_cum", F.sum("_c").over(w3))
    picked = j3.where((F.col("_cum") - F.col("_c") < F.col("_r")) & (F.col("_r") <= F.col("_cum")))

    # ---- pivot the picked order statistics back to one row per group
    outs = [F.max("_n").alias("n")]
    for name in quantiles:
        outs.append(F.max(F.when(F.col("_tag") == f"{name}__lo", F.col("_val"))).alias(f"{name}__lo"))
        outs.append(F.max(F.when(F.col("_tag") == f"{name}__hi", F.col("_val"))).alias(f"{name}__hi"))
    wide = picked.groupBy(*G).agg(*outs)
    final = [F.col(g) for g in G] + [F.col("n")]
    for name, q in quantiles.items():
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        if name in median_names:
            val = (lo + hi) / F.lit(2.0)
        else:
            pos = (F.col("n") - 1) * F.lit(float(q))
            val = lo + (hi - lo) * (pos - F.floor(pos))
        final.append(val.alias(name))
    return wide.select(*final)


def exact_median(df: DataFrame, value: str, group_cols: Sequence[str] = (),
                 bounded_groups: bool = False, name: str = "median") -> DataFrame:
    """Exact median (mean of the two middle values for an even count)."""
    return exact_quantiles(df, value, {name: 0.5}, group_cols, bounded_groups, median_names=(name,))


def approx_median(df: DataFrame, value: str, group_cols: Sequence[str] = (),
                  accuracy: int = 10_000, name: str = "median") -> DataFrame:
    """``percentile_approx`` variant: one pass, bounded sketch, rank error <= n/accuracy."""
    v = F.col(value).cast("double")
    clean = df.where(v.isNotNull() & ~F.isnan(v))
    aggs = [F.count(F.lit(1)).alias("n"), F.percentile_approx(v, 0.5, accuracy).alias(name)]
    return clean.groupBy(*group_cols).agg(*aggs) if group_cols else clean.agg(*aggs).where(F.col("n") > 0)

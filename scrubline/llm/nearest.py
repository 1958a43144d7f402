"""Nearest neighbours by a block matrix join.

Vectors are cut into int8 codes with a scale each. Blocks of queries meet blocks
of candidates in a grid; the product of two code blocks (whole numbers, exact in
floating point) gives every inner product up to a bound on the quantisation
error: with x = x' + e_x, |x.y - x'.y'| <= |x| |e_y| + |e_x| |y'|. Pairs whose
upper bound falls below the k-th largest lower bound of their query are out; the
survivors are computed in double precision from the original vectors. Each cell
keeps a heap of its k best per query, and a ranked merge over the cells gives
the result, which is therefore exact (recall 1).

The grid's cells are keyed by (dimension, query block, candidate block), so no
task holds more than one block of either kind; block sizes are constants and the
number of blocks follows the row counts.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors are only compared
with those of their own length; rows that share a query's id are its own; a
repeated query id stands once, with its smallest vector; repeated candidates
each count; fewer than k candidates -> all of them; ties -> the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, QUERY_BLOCK, CANDIDATE_BLOCK = 20, 2048, 8192


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


_PART = "dim int, cell int, ids binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, cell, id, vector) rows into one row per dim, cell and batch."""
    for b in batches:
        dim, cell, ids = (b.column(k).to_numpy() for k in range(3))
        vectors = b.column(3)
        flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(dim)))
        order = np.lexsort((cell, dim))
        out = []
        edge = np.flatnonzero(np.append(True, (dim[order][1:] != dim[order][:-1]) | (cell[order][1:] != cell[order][:-1]))) if len(order) else []
        for a, z in zip(edge, [*edge[1:], len(order)]):
            rows = order[a:z]
            m = flat[offsets[rows][:, None] + np.arange(dim[rows[0]])]
            out.append((int(dim[rows[0]]), int(cell[rows[0]]), ids[rows].tobytes(), m.astype(np.float64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                         ["dim", "cell", "ids", "vectors"])


def codes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of what they stand for, norm of the error)."""
    scale = np.abs(m).max(1) / 127
    q = np.rint(m / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near ** 2).sum(1)), np.sqrt(((m - near) ** 2).sum(1))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best_of(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best (score, id) among the candidates."""
    q8, qs, qn, qe = codes(q)
    c8, cs, cn, ce = codes(c)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    found: list[list[tuple[float, int]]] = []
    norm = np.sqrt((q ** 2).sum(1))
    ct = c8.astype(exact).T
    for a in range(0, len(q), 256):
        s = slice(a, a + 256)
        near = (q8[s].astype(exact) @ ct).astype(np.float64) * qs[s][:, None] * cs[None, :]
        # the last term covers rounding of the sums above
        bound = norm[s][:, None] * ce[None, :] + qe[s][:, None] * cn[None, :] + 1e-9 * (norm[s][:, None] * (cn + ce)[None, :])
        own = qids[s][:, None] == cids[None, :]
        low = np.where(own, -np.inf, near - bound)
        if low.shape[1] > k:
            floor = np.partition(low, -k, axis=1)[:, -k]
        else:
            floor = np.full(len(low), -np.inf)
        i, j = np.nonzero((near + bound >= floor[:, None]) & ~own)
        score = _dot(q[s][i], c[j])
        edge = np.searchsorted(i, np.arange(len(low) + 1))
        for r in range(len(low)):
            pairs = zip((-score[edge[r]:edge[r + 1]]).tolist(), cids[j[edge[r]:edge[r + 1]]].tolist())
            found.append([(-x, v) for x, v in heapq.nsmallest(k, pairs)])
    return found


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, id_col, score): the k rows of the largest inner product
    with each query row, the query's own rows left out."""
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.size(vec_col).alias("dim"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("_q"))
    n = rows.groupBy().agg(F.count("*").alias("n"), F.count_if("_q").alias("q")).first()
    n_cand, n_query = max(1, -(-n.n // CANDIDATE_BLOCK)), max(1, -(-n.q // QUERY_BLOCK))
    deal = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("cell")
    pack = lambda df, blocks: df.select("dim", deal(blocks), "id", "v").mapInArrow(_pack, _PART)
    once = rows.where("_q").groupBy("dim", "id").agg(F.min("v").alias("v"))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = pack(once, n_query).withColumnRenamed("cell", "qcell").withColumn("ccell", every(n_cand))
    candidates = pack(rows, n_cand).withColumnRenamed("cell", "ccell").withColumn("qcell", every(n_query))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        if not (q.num_rows and c.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dim = q["dim"][0].as_py()
        ids = lambda t: np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t["ids"]])
        mat = lambda t: np.concatenate([np.frombuffer(x.as_py(), np.float64).reshape(-1, dim) for x in t["vectors"]])
        qids = ids(q)
        best = best_of(qids, mat(q), ids(c), mat(c), k)
        return pa.table({"query_id": pa.array(np.repeat(qids, [len(b) for b in best]), pa.int64()),
                         "id": pa.array([i for b in best for _, i in b], pa.int64()), "score": pa.array([s for b in best for s, _ in b], pa.float64())})

    keys = ["dim", "qcell", "ccell"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(cell, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
            list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {K}
"""

"""Cross-tokenizer alignment by token-byte incidence matrices.

Each of two tokenizers cuts the bytes of a text (a space before it) into tokens: its
matrix has a row a token and a column a byte. With A and B in compressed sparse rows,
Gustavson's row products A·Bᵀ give the *overlap links*: the value at (a, b) is the number of bytes
that both tokens cover. Places where both end a token cut the text into *groups*;
with the token-group matrices the products G_A·G_Bᵀ give the *shared-group links*, all
pairs within one group. A slice of texts is one block-diagonal product, done a block
of rows at a time, so memory stays bounded for texts of any length.

:func:`align` returns a text's ids, links and groups, :func:`shared_links` the
pairs of a group. :func:`digests` adds what needs the whole corpus: how often each
pair of ids is linked anywhere, and which of B's ids' pairs are their most frequent.

Exchange. A slice's links are numbered by its distinct id pairs. Only those pairs
and their numbers are counted over the corpus (combined in each task, then by pair), joined with
the counts, and sent back to the slice: a pair costs a row a slice, however often it is linked, and
no table of all pairs is broadcast or collected. Slices are written once, with their
links; a lost executor reads them again.

Memory. Texts reach Python in batches of BATCH_ROWS rows. A worker remembers a bounded
number of words, and none of them after its task: workers live on beside the later
shuffles, which need the executor's memory themselves.

Edge cases: a text that is null, empty or whose tokens do not spell it byte for byte
(U+2581 in it, say) has no tokens: zeros and '' as digest; repeated rows -> a row
each, and their links count each time; a null id is kept; an empty table -> no rows;
other columns of the input are left out of the results and never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sparse
from .common import small, table, written
from .subwords import Pair
from .wordcache import per_worker, slices

#: Rows and bytes of a slice, and rows of an Arrow batch of texts.
SLICE_ROWS, SLICE_BYTES, BATCH_ROWS = 2048, 1 << 20, 4096


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Aligned:
    """Texts of a slice. Tokens are numbered through it; each array ends with a text."""
    n_a: np.ndarray        # tokens of each text
    n_b: np.ndarray
    a: np.ndarray          # ids
    b: np.ndarray
    link_a: np.ndarray     # tokens that share bytes, in order
    link_b: np.ndarray
    link_bytes: np.ndarray
    group_a: np.ndarray    # the group of each token
    group_b: np.ndarray
    n_groups: np.ndarray   # groups of each text

    def text_of_a(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_a)), self.n_a)

    def n_links(self) -> np.ndarray:
        return np.bincount(self.text_of_a()[self.link_a], minlength=len(self.n_a))

    def incidence(self) -> tuple[sparse.Csr, sparse.Csr]:
        """The token-group matrices of A and B."""
        groups = int(self.n_groups.sum())
        return sparse.members(self.group_a, groups), sparse.members(self.group_b, groups)


def overlaps(a_end: np.ndarray, b_end: np.ndarray, block: int = sparse.BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonzero entries of A·Bᵀ (tokens of A, of B, bytes shared) for tokens that end at
    the given places, by blocks of A's rows that cover about ``block`` bytes."""
    out = []
    first = 0
    while first < len(a_end):
        lo = int(a_end[first - 1]) if first else 0
        last = max(int(np.searchsorted(a_end, lo + block, "right")), first + 1)
        hi = int(a_end[last - 1])
        b0, b1 = np.searchsorted(b_end, lo, "right"), np.searchsorted(b_end, hi, "left") + 1
        left, right = sparse.spans(a_end[first:last], lo, hi), sparse.spans(b_end[b0:b1], lo, hi).transpose()
        out += [(r + first, c + b0, v) for r, c, v in sparse.multiply(left, right, block)]
        first = last
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 3


def align_slice(pair: Pair, texts: pa.Array) -> Aligned:
    n_a, a, n_b, b = pair.encode(texts)
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    link_a, link_b, shared = overlaps(a_end, b_end)
    # texts end where both end, so no group reaches over two texts
    joint = a_end[np.isin(a_end, b_end, assume_unique=True)]
    text_end = np.append(0, a_end)[np.cumsum(n_a)]
    until = np.searchsorted(joint, text_end, "right")
    return Aligned(n_a, n_b, a, b, link_a, link_b, shared, np.searchsorted(joint, a_end), np.searchsorted(joint, b_end), np.diff(np.append(0, until)))


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _until_end(batches: Iterator[pa.RecordBatch], pair: Pair) -> Iterator[pa.RecordBatch]:
    """The task's batches; then the pair forgets its words."""
    try:
        yield from batches
    finally:
        pair.forget()


def align(df: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a text: its id; a, b (ids); link_a, link_b (positions of tokens that
    overlap) and link_bytes; group_a, group_b (tokens of each group)."""
    given = df.select(F.col(id), F.col(text).alias("_text"))
    names = ["a", "b", "link_a", "link_b", "link_bytes", "group_a", "group_b"]
    schema = T.StructType([given.schema[0], *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = per_worker(Pair, a_path, b_path)
        for batch in _until_end(batches, pair):
            for k, texts in slices(batch.column(1), SLICE_ROWS, SLICE_BYTES):
                x = align_slice(pair, texts)
                links, groups = x.n_links(), int(x.n_groups.sum())
                a0, b0 = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
                lists = [_lists(x.a, x.n_a), _lists(x.b, x.n_b), _lists(x.link_a - np.repeat(a0, links), links), _lists(x.link_b - np.repeat(b0, links), links),
                         _lists(x.link_bytes, links), *[_lists(np.bincount(g, minlength=groups), x.n_groups) for g in (x.group_a, x.group_b)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(texts)), *lists], [id, *names])

    return given.mapInArrow(rows, schema)


def shared_links(df: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a, b): positions of each two tokens of one group, by G_A·G_Bᵀ. Texts of
    one id stay apart by ``row``, a number of the text in the result."""
    given = df.select(F.col(id), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([given.schema[0], T.StructField("row", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = per_worker(Pair, a_path, b_path)
        for batch in _until_end(batches, pair):
            for k, texts in slices(batch.column(1), SLICE_ROWS, SLICE_BYTES):
                x = align_slice(pair, texts)
                left, right = x.incidence()
                a0, b0, text_of = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b, x.text_of_a()
                for a, b, _ in sparse.multiply(left, right.transpose()):
                    t = text_of[a]
                    at = pa.array(t + k)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array((a - a0[t]).astype(np.int32)),
                                                      pa.array((b - b0[t]).astype(np.int32))], [id, "row", "a", "b"])

    return given.mapInArrow(rows, schema)


class Speller:
    """Groups of a slice as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, pair: Pair):
        self.a = {s: np.array([f"{k}{s}" for k in range(len(pair.a_bytes))], object) for s in ",|"}
        self.b = {s: np.array([f"{k}{s}" for k in range(len(pair.b_bytes))], object) for s in (",", ";", "")}

    def digests(self, x: Aligned) -> list[str]:
        """sha256 of each text's groups; '' for a text without tokens."""
        groups = int(x.n_groups.sum())
        a_before, b_before = (np.append(0, np.cumsum(np.bincount(g, minlength=groups))) for g in (x.group_a, x.group_b))
        item = np.empty(len(x.a) + len(x.b), object)
        item[np.arange(len(x.a)) + b_before[x.group_a]] = self.a[","][x.a]
        item[np.arange(len(x.b)) + a_before[x.group_b + 1]] = self.b[","][x.b]
        last_a, last_b = a_before[1:] - 1, b_before[1:] - 1
        item[last_a + b_before[:-1]] = self.a["|"][x.a[last_a]]
        item[last_b + a_before[1:]] = self.b[";"][x.b[last_b]]
        end = np.cumsum(x.n_a + x.n_b)
        some = np.flatnonzero(x.n_b)
        item[end[some] - 1] = self.b[""][x.b[np.cumsum(x.n_b)[some] - 1]]
        start = end - x.n_a - x.n_b
        return [hashlib.sha256("".join(item[s:e].tolist()).encode()).hexdigest() if e > s else "" for s, e in zip(start, end)]


def _speller(a_path: str, b_path: str) -> Speller:
    return Speller(per_worker(Pair, a_path, b_path))


_COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def _sliced(df: DataFrame, a_path: str, b_path: str, id: str, text: str) -> DataFrame:
    """Rows of texts (their figures, and for each link the number of its pair of ids
    within the slice) and one row a slice (its pairs and how often each is linked)."""
    given = df.select(F.spark_partition_id().alias("_part"), F.col(id), F.col(text).alias("_text"))
    long = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("slice", T.LongType()), given.schema[1], *[T.StructField(n, T.LongType()) for n in _COUNTED],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType()),
                           T.StructField("pairs", long), T.StructField("n", long)])
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, speller, at = per_worker(Pair, a_path, b_path), per_worker(_speller, a_path, b_path), 0
        for batch in _until_end(batches, pair):
            ids = batch.column(1)
            for k, texts in slices(batch.column(2), SLICE_ROWS, SLICE_BYTES):
                x = align_slice(pair, texts)
                coded = pc.dictionary_encode(pa.array(x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b]))
                number, pairs = coded.indices.to_numpy(), coded.dictionary
                number = number.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
                links, packed = x.n_links(), number.tobytes()
                stop = (np.cumsum(links) * number.itemsize).tolist()
                left, right = x.incidence()
                shared = np.bincount(x.text_of_a(), weights=sparse.expansion(left, right.transpose()), minlength=len(texts)).astype(np.int64)
                n, name = len(texts), pa.array([(int(batch.column(0)[0].as_py()) << 32) + at] * (len(texts) + 1))
                at += 1
                none = pa.nulls(n, pa.list_(pa.int64()))
                texts_rows = [name.slice(0, n), ids.slice(k, n), *[pa.array(v.astype(np.int64)) for v in (x.n_a, x.n_b, x.n_groups, links)], pa.array(shared),
                              pa.array(speller.digests(x)), pa.array([packed[s:e] for s, e in zip([0, *stop], stop)], pa.binary()), none, none]
                yield pa.RecordBatch.from_arrays(texts_rows, names)
                how_often = pa.array([np.bincount(number, minlength=len(pairs)).astype(np.int64)], pa.list_(pa.int64()))
                own = [name.slice(n, 1), pa.nulls(1, ids.type), *[pa.nulls(1, pa.int64())] * len(_COUNTED), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()),
                       pa.array([pairs.to_numpy()], pa.list_(pa.int64())), how_often]
                yield pa.RecordBatch.from_arrays(own, names)

    return given.mapInArrow(rows, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best) over (pair, n) rows: totals, and whether a pair's total is the highest of its B id."""
    total = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("_b", F.expr("pair & 4294967295"))
    top = total.groupBy("_b").agg(F.max("n").alias("_top"))
    return total.join(small(top, 1_000_000), "_b").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def digests(df: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a text: id, n_a, n_b, n_groups, n_links, n_shared (shared-group links),
    n_best, count_sum, groups_sha256."""
    spark = df.sparkSession
    sliced = written(spark, _sliced(df, a_path, b_path, id, text), "alignment-slices", BATCH_ROWS)
    pairs = sliced.where("pairs IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "_p"))
    pairs = pairs.select("slice", "at", F.col("_p.pairs").alias("pair"), F.col("_p.n").alias("n"))
    counts = written(spark, pair_counts(pairs.select("pair", "n")), "alignment-pairs")
    back = pairs.select("slice", "at", "pair").join(small(counts, 500_000), "pair").select(F.col("slice").alias("of"), "at", "n", "best")
    texts = sliced.where("pairs IS NULL").drop("pairs", "n")
    kept = [f for f in texts.schema.fields if f.name not in ("slice", "links")]
    out = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def score(rows: pa.Table, own: pa.Table) -> pa.Table:
        n, best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        at = own.column("at").to_numpy()
        n[at], best[at] = own.column("n").to_numpy(), own.column("best").to_numpy(zero_copy_only=False)
        kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
        links = [np.frombuffer(b, kind) for b in rows.column("links").to_pylist()]
        found = rows.select([f.name for f in kept])
        return found.append_column("n_best", pa.array([int(best[x].sum()) for x in links], pa.int64())).append_column(
            "count_sum", pa.array([int(n[x].sum()) for x in links], pa.int64()))

    done = texts.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(score, out)
    return done.select(id, *_COUNTED, "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_paths())

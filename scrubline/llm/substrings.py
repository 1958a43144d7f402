"""Removal of repeated passages by fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document. A window is repeated
when a document with a smaller id holds the same words; every word that a
repeated window covers is removed.

1. Anchors. Every document's non-overlapping blocks of ``BLOCK`` = WINDOW / 2
   words are indexed by a rolling hash, and every rolling block of every
   document probes the index: two equal windows hold a whole block of either
   one. Documents are dealt into chunks and hashes into buckets; a row carries
   the packed probes of one (chunk, bucket), 4 bytes each, sorted and without
   repetition, so a passage that a third of all documents share costs one probe
   a chunk. A chunk gets back the hashes that another chunk has indexed, and
   finds those within itself on its own.
2. Extension. Around its hits each chunk takes the windows that hold one: runs of
   them are the maximal exact repeats (and a few false ones, as 4-byte hashes may
   agree by chance). Their 64-bit hashes go, packed in the same way, with the
   chunk's smallest document id to a bucket, which answers with smaller ids.
3. Removal. Windows with a smaller id elsewhere become word spans. Only texts
   that have spans (found by a fixed-size bit table, then exactly) are shuffled
   to meet them.

Each task holds one chunk (about ``CHUNK_BYTES`` of text, or one longer text) or
one bucket (about ``BUCKET_PROBES`` probes), never a group of documents. Chunks
and buckets are numbers made from hashes, so that retried tasks do the same.

Edge cases: null, empty or short texts (under WINDOW words) lose nothing; a null
id is larger than all others; rows of equal ids never remove each other's words;
repeated rows each get a row; tables without rows give none; other columns are
kept, and outputs replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed as PK
from . import words as W
from .common import table, written

WINDOW = 50
BLOCK = WINDOW // 2
CHUNK_BYTES, BUCKET_PROBES = 4 << 20, 1_000_000
FILTER_BITS = 20
_B = np.uint64(0xD1342543DE82EF95)
_NO_ID = (1 << 63) - 1


def _inverse(x: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) & ((1 << 64) - 1)
    return y


_B_INV = np.uint64(_inverse(int(_B)))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words at each position, from running sums."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h) - 1, _B))), dtype=np.uint64)
    down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _B_INV))), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    return W.mix((total[size:] - total[:n]) * down)


def _anchors(buckets: int):
    """Rows (bucket, chunk, probes, blocks) of one chunk's texts."""
    names = ["bucket", "chunk", "probes", "blocks"]

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        probes, blocks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for part in docs["text"].chunks:
            for h in W.hashed(part, False):
                if len(h) >= WINDOW:
                    k = PK.keys(rolling(h, BLOCK), buckets)
                    probes.append(k)
                    blocks.append(k[::BLOCK])
        c = key[0].as_py()
        packed = [{b: low.tobytes() for b, _, low, _ in PK.cells(np.full(len(k), c), k)} for k in (np.concatenate(probes), np.concatenate(blocks))]
        rows = [(b, c, low, packed[1].get(b, b"")) for b, low in packed[0].items()]  # a block is a probe, too
        return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names)

    return run


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """For one bucket: to each chunk, its probes that another chunk has indexed."""
    chunk = rows["chunk"].to_numpy()
    blocks = [np.frombuffer(v.as_py(), np.uint32) for v in rows["blocks"]]
    low = np.concatenate(blocks)
    owner = np.repeat(chunk, [len(v) for v in blocks])
    order = np.lexsort((owner, low))
    low, owner = low[order], owner[order]
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(low)) - 1
    known, least, most = low[first], owner[first], owner[last]
    out = []
    for c, v in zip(chunk, rows["probes"]):
        p = np.frombuffer(v.as_py(), np.uint32)
        hit, at = PK.find(known, p)
        hit[hit] = (least[at[hit]] != c) | (most[at[hit]] != c)
        if hit.any():
            out.append((int(c), p[hit].tobytes()))
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()),
                     "hits": pa.array([h for _, h in out], pa.binary())})


def _candidates(buckets: int):
    """For one chunk: the windows that hold a hit, as runs and hashes."""
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        told = [np.frombuffer(h.as_py(), np.uint32).astype(np.uint64) | (np.uint64(b.as_py()) << np.uint64(32)) for b, h in zip(hits["bucket"], hits["hits"])]
        told = np.unique(np.concatenate(told)) if told else np.zeros(0, np.uint64)
        words, roll = [], []
        for chunk in docs["text"].chunks:
            words += [h if len(h) >= WINDOW else h[:0] for h in W.hashed(chunk, False)]
        roll = [rolling(h, BLOCK) for h in words]
        # blocks of this chunk, with the first and the last document that has them
        own = [r[::BLOCK] for r in roll]
        doc = np.repeat(np.arange(len(own)), [len(r) for r in own])
        value = np.concatenate(own) if own else np.zeros(0, np.uint64)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(value)) - 1
        known, least, most = value[first], doc[first], doc[last]
        run_doc, run_at, run_len, hashes = [], [], [], []
        for d, (h, r) in enumerate(zip(words, roll)):
            if not len(h):
                continue
            hit, _ = PK.find(told, PK.keys(r, buckets))
            here, at = PK.find(known, r)
            hit |= here & ((least[at] != d) | (most[at] != d)) if len(known) else False
            if not hit.any():
                continue
            n = len(h) - WINDOW + 1
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(hit)))
            cand = upto[BLOCK + 1:BLOCK + 1 + n] > upto[:n]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], cand.view(np.int8), [0]))))
            run_doc += [d] * (len(edge) // 2)
            run_at += edge[::2].tolist()
            run_len += (edge[1::2] - edge[::2]).tolist()
            hashes.append(rolling(h, WINDOW)[cand])
        if not hashes:
            return pa.table({k: pa.array([], t) for k, t in _CAND})
        raw = lambda v, t: np.asarray(v, t).tobytes()
        used, at = np.unique(run_doc, return_inverse=True)
        ids, keys = docs["id"].to_numpy()[used], docs["k1"].to_numpy()[used]
        row = [docs["chunk"][0].as_py(), raw(ids, np.int64), raw(keys, np.int64), raw(at, np.int32), raw(run_at, np.int32), raw(run_len, np.int32), np.concatenate(hashes).tobytes()]
        return pa.table({k: pa.array([v], t) for (k, t), v in zip(_CAND, row)})

    return run


_CAND = [("chunk", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("run_doc", pa.binary()), ("run_at", pa.binary()), ("run_len", pa.binary()), ("hashes", pa.binary())]


def _row(b: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, ...]:
    """(ids, keys, document of each run, start, length, hash of each window)."""
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint64)
    return tuple(np.frombuffer(b[name][k].as_py(), t) for (name, _), t in zip(_CAND[1:], kinds))


def _least(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with the smallest id of each."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    first = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
    return hashes[first], ids[first]


def _ask(buckets: int):
    """Rows (bucket, chunk, hashes, ids): each chunk's windows and smallest ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, _, run_doc, _, run_len, hashes = _row(b, k)
                h, low = _least(hashes, ids[np.repeat(run_doc, run_len)])
                bucket = (h % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, h, low = bucket[order], h[order], low[order]
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = [*edge[1:], len(h)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edge], pa.int32()), pa.array([b["chunk"][k].as_py()] * len(edge), pa.int32()),
                     pa.array([h[x:y].tobytes() for x, y in zip(edge, ends)], pa.binary()), pa.array([low[x:y].tobytes() for x, y in zip(edge, ends)], pa.binary())],
                    ["bucket", "chunk", "hashes", "ids"])
    return run


def _smaller(rows: pa.Table) -> pa.Table:
    """For one bucket: to each chunk, its windows that a smaller id holds elsewhere."""
    parts = [(c.as_py(), np.frombuffer(h.as_py(), np.uint64), np.frombuffer(i.as_py(), np.int64)) for c, h, i in zip(rows["chunk"], rows["hashes"], rows["ids"])]
    known, low = _least(np.concatenate([h for _, h, _ in parts]), np.concatenate([i for _, _, i in parts]))
    out = []
    for c, h, i in parts:
        best = low[np.searchsorted(known, h)]
        less = best < i
        if less.any():
            out.append((c, h[less].tobytes(), best[less].tobytes()))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()), "hashes": pa.array([x[1] for x in out], pa.binary()), "ids": pa.array([x[2] for x in out], pa.binary())})


def _spans(cand: pa.Table, told: pa.Table) -> pa.Table:
    """For one chunk: the word spans that repeated windows cover."""
    out = []
    more = [(np.frombuffer(h.as_py(), np.uint64), np.frombuffer(i.as_py(), np.int64)) for h, i in zip(told["hashes"], told["ids"])]
    rows = [_row(cand, k) for k in range(cand.num_rows)]
    known, low = _least(np.concatenate([*(h for h, _ in more), *(r[5] for r in rows), np.zeros(0, np.uint64)]),
                        np.concatenate([*(i for _, i in more), *(r[0][np.repeat(r[2], r[4])] for r in rows), np.zeros(0, np.int64)]))
    for ids, keys, run_doc, run_at, run_len, hashes in rows:
        doc = np.repeat(run_doc, run_len)
        at = np.arange(len(hashes)) - np.repeat(np.cumsum(run_len) - run_len, run_len) + np.repeat(run_at, run_len)
        bad = low[np.searchsorted(known, hashes)] < ids[doc]
        doc, at = doc[bad], at[bad]
        if not len(doc):
            continue
        new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + WINDOW))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        for d in np.unique(doc):
            own = doc[first] == d
            out.append((int(ids[d]), int(keys[d]), [{"a": int(a), "b": int(b) + WINDOW} for a, b in zip(at[first[own]], at[last[own]])]))
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.table({"id": pa.array([x[0] for x in out], pa.int64()), "k1": pa.array([x[1] for x in out], pa.int64()), "spans": pa.array([x[2] for x in out], kind)})


def repeated_spans(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, k1, spans): word spans [a, b) to remove from each text that has any;
    id is null-free (null -> the largest long), k1 the text's hash."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(1, -(-size // CHUNK_BYTES))
    buckets = max(1, -(-size // (6 * BUCKET_PROBES)))  # a word is about six bytes
    rows = docs.select(*_key(id_col, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("id", "k1"), F.lit(chunks)).cast("int").alias("chunk"), "id", "k1", "text")
    cells = rows.groupBy("chunk").applyInArrow(_anchors(buckets), "bucket int, chunk int, probes binary, blocks binary")
    hits = cells.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, hits binary")
    kind = ", ".join(f"{k} {'int' if t == pa.int32() else 'binary'}" for k, t in _CAND)
    cand = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_candidates(buckets), kind)
    cand = written(spark, cand, "repeat-candidates")
    asked = cand.mapInArrow(_ask(buckets), "bucket int, chunk int, hashes binary, ids binary")
    told = asked.groupBy("bucket").applyInArrow(_smaller, "chunk int, hashes binary, ids binary")
    spans = cand.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_spans, "id long, k1 long, spans array<struct<a:int,b:int>>")
    return written(spark, spans.dropDuplicates(["id", "k1"]), "repeat-spans")


def _key(id_col: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k1")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with kept_text (words that stay, joined by one space), n_words
    and n_removed."""
    new = ["kept_text", "n_words", "n_removed"]
    kept = [c for c in docs.columns if c not in new]
    spans = repeated_spans(docs, id_col, text)
    bucket = F.shiftrightunsigned("k1", 64 - FILTER_BITS)
    some = np.zeros(1 << FILTER_BITS, bool)
    some[spans.select(bucket.alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)] = True

    @F.arrow_udf("boolean")
    def may(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in parts:
            yield pa.array(some[(arr.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])

    @F.arrow_udf("kept_text string, n_words long, n_removed long")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
        for texts, which in parts:
            done = [_cut(t.as_py(), s.as_py()) for t, s in zip(texts, which)]
            yield pa.array(done, kind)

    keyed = docs.select(*kept, *[c.alias(f"_{n}") for c, n in zip(_key(id_col, text), ("id", "k1"))])
    marked = keyed.withColumn("_may", may("_k1"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    plain = marked.where(~F.col("_may")).withColumn("spans", none)
    met = marked.where("_may").join(spans.withColumnsRenamed({"id": "_id", "k1": "_k1"}), ["_id", "_k1"], "left").withColumn("spans", F.coalesce("spans", none))
    both = plain.select(*kept, "spans").unionByName(met.select(*kept, "spans"))
    out = both.select(*kept, cut(F.coalesce(F.col(text), F.lit("")), "spans").alias("_c"))
    return out.select(*kept, *[F.col(f"_c.{c}").alias(c) for c in new])


def _cut(text: str, spans: list[dict]) -> dict:
    words = text.encode("utf-8").split()  # splits at the six ASCII white-space bytes
    n = len(words)
    if spans:
        keep, at = [], 0
        for s in spans:
            keep += words[at:s["a"]]
            at = s["b"]
        words = keep + words[at:]
    return {"kept_text": b" ".join(words).decode("utf-8"), "n_words": n, "n_removed": n - len(words)}


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + {WINDOW - 1}], ' ') AS v FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS k FROM w)),
first AS (SELECT v, min(doc_id) AS d FROM win GROUP BY v),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(k, k + {WINDOW})))) AS g FROM win JOIN first USING (v) WHERE d < doc_id GROUP BY doc_id),
kept AS (SELECT doc_id, ws, coalesce(len(g), 0) AS r, CASE WHEN g IS NULL THEN ws ELSE
  list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(g, i))), lambda i: ws[i]) END AS kw FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(kw, ' '), '')) AS kept_sha256 FROM kept
"""

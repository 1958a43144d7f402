"""N-gram Jaccard join by set-relation skipping.

Each text is the set of its word shingles (64-bit hashes). Texts of equal sets
are one node. Two nodes link when their Jaccard similarity reaches a threshold
num/den; the result is each text's component.

Order. Shingles are sorted from rare to frequent. Documents are dealt into chunks
and shingles into buckets; buckets count in how many texts each shingle is and
tell the chunks those of two and more (by four bytes of the hash: two shingles
that share them share a count, the same for all texts, which any fixed order may).

Index lists. Linked sets share a shingle within their prefixes (the first
n - ceil(t n) + 1 shingles). Only shingles of two and more texts have lists, of
(node, size, position). The first shingle that two sets share leaves at most the
shorter rest to be shared, so positions bound the overlap. Lists are kept in
blocks by position, and two blocks whose best positions and sizes cannot reach
the overlap are skipped whole.

Set relations. Links only matter up to components, so a set that is linked to a
list's pivot takes over the pivot's answers: in a few rounds each node is
compared with one pivot of its lists (linear in the lists' length) and components
are contracted. Pairs of different components that still pass are then compared
by blocks: first each entry's nearest only, contracted again while links are
found, so that a group of near copies costs links in proportion to its entries,
and in the end all that remain, each at the first shingle that it shares. Each set carries a
parity sketch: bit b is the parity of its shingles that hash to b. The bits in
which two sketches differ never exceed the sets' symmetric difference; pairs
beyond the allowed difference are skipped, and what remains is verified on the
full sets. No link is lost and none is guessed.

A group of near copies is never in one task: lists are cut into blocks of about
``BLOCK`` entries, and copies of one set are one node.

Edge cases: null, empty or blank text -> no shingle, a component of its own; a
text with fewer words than a shingle -> its whole sequence is one shingle; ids
may repeat or be null: a component's id is the smallest id that is not null
(null if there is none); rows are kept one for one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed as PK
from . import words as W
from .common import split_join, table, trim, written
from .components import components

PARITY_BITS, CHUNK_BYTES, BUCKET_SHINGLES = 1024, 4 << 20, 1_000_000
BLOCK, STAR_ROUNDS, NEAREST_ROUNDS = 64, 5, 4
#: Rows of an Arrow batch where a row holds whole sets, or two blocks of lists.
SET_ROWS, BLOCK_ROWS = 512, 16


def _counts(k: int, buckets: int):
    """Rows (bucket, chunk, low, n): the shingles of one chunk's texts."""
    names, types = ["bucket", "chunk", "low", "n"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        parts = [np.zeros(0, np.uint64)]
        for part in docs["text"].chunks:
            parts += [PK.keys(np.unique(W.shingles(h, k)), buckets) for h in W.hashed(part, True)]
        all_keys, c = np.concatenate(parts), key[0].as_py()
        del parts
        rows = [(b, c, low.tobytes(), n.tobytes() if n.max() > 1 else b"") for b, _, low, n in PK.cells(np.full(len(all_keys), c), all_keys)]
        del all_keys
        trim()
        return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)

    return run


def _repeated(key: tuple, rows: pa.Table) -> pa.Table:
    """For one bucket: to each chunk, its shingles of two and more texts and in
    how many texts they are."""
    lows = [np.frombuffer(v.as_py(), np.uint32) for v in rows["low"]]
    counts = [np.frombuffer(v.as_py(), np.uint32) if len(v.as_py()) else np.ones(len(x), np.uint32) for v, x in zip(rows["n"], lows)]
    low, where = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts))
    known, total = low[total > 1], total[total > 1].astype(np.uint32)
    out = []
    for c, x in zip(rows["chunk"].to_pylist(), lows):
        hit, at = PK.find(known, x)
        if hit.any():
            out.append((c, x[hit].tobytes(), total[at[hit]].tobytes()))
    del where
    trim()
    return pa.table({"chunk": pa.array([c for c, _, _ in out], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()),
                     "low": pa.array([x for _, x, _ in out], pa.binary()), "n": pa.array([n for _, _, n in out], pa.binary())})


def _node(sets: np.ndarray) -> np.int64:
    """Identity of a set: a hash of its sorted shingles."""
    with np.errstate(over="ignore"):
        return W.mix(np.array([W.mix(sets ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(sets))], np.uint64)).view(np.int64)[0]


_FEATURE = [("id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())),
            ("parity", pa.list_(pa.int64())), ("shingles", pa.binary())]


def _features(k: int, buckets: int, num: int, den: int):
    """For one chunk: node and size of each text; and, for texts with repeated
    shingles in their prefix, those with positions, the sketch and the set."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        key = [np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) | (np.uint64(b.as_py()) << np.uint64(32)) for b, x in zip(told["bucket"], told["low"])]
        count = [np.frombuffer(x.as_py(), np.uint32) for x in told["n"]]
        key, first = np.unique(np.concatenate([*key, np.zeros(0, np.uint64)]), return_index=True)
        count = np.concatenate([*count, np.zeros(0, np.uint32)])[first]
        out = []
        for chunk, ids in zip(docs["text"].chunks, docs["id"].chunks):
            for i, h in zip(ids.to_pylist(), W.hashed(chunk, True)):
                s = np.unique(W.shingles(h, k))
                if not len(s):
                    out.append((i, None, 0, [], [], [], b""))
                    continue
                hit, at = PK.find(key, PK.keys(s, buckets))
                size = len(s) - -(-num * len(s) // den) + 1
                # shingles of one text come first; the repeated ones follow by count
                again = np.flatnonzero(hit)
                lone = len(s) - len(again)
                by = again[np.lexsort((s[again], count[at[again]]))][:max(0, size - lone)]
                if not len(by):
                    out.append((i, _node(s), len(s), [], [], [], b""))
                    continue
                bits = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                out.append((i, _node(s), len(s), s[by].view(np.int64), np.arange(lone, lone + len(by), dtype=np.int32), np.packbits(bits.astype(np.uint8)).view(np.int64), _pack(s)))
        del key, count
        trim()
        return pa.table({name: pa.array([r[j] for r in out], t) for j, (name, t) in enumerate(_FEATURE)})
    return run


def features(docs: DataFrame, id_col: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """One row a text: id, node (null for empty sets), n, tokens and pos (the
    repeated shingles of its prefix), parity and shingles (if it has any)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // (6 * BUCKET_SHINGLES)))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), body), F.lit(chunks)).cast("int").alias("chunk"), F.col(id_col).cast("long").alias("id"), body.alias("text"))
    counted = rows.groupBy("chunk").applyInArrow(_counts(k, buckets), "bucket int, chunk int, low binary, n binary")
    told = counted.groupBy("bucket").applyInArrow(_repeated, "chunk int, bucket int, low binary, n binary")
    made = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _features(k, buckets, num, den), "id long, node long, n int, tokens array<long>, pos array<int>, parity array<long>, shingles binary")
    return written(docs.sparkSession, made, "set-features")


def need(n1: Column, n2: Column, num: int, den: int) -> Column:
    """Smallest overlap that links sets of these sizes: the whole-number ceiling
    of num (n1 + n2) / (num + den)."""
    return _div((n1 + n2) * num + (num + den - 1), num + den)


def _div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def _passes(x: str, y: str, num: int, den: int) -> Column:
    """Size and position filters over two list entries."""
    c = lambda s, f: F.col(f"{s}.{f}")
    least = need(c(x, "n"), c(y, "n"), num, den)
    return (F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) >= least) & (F.least(c(x, "n"), c(y, "n")) >= least)


def _near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, na, b, nb) whose sketches do not exclude a link."""
    both = (pairs.join(sketches.select(F.col("node").alias("a"), F.col("parity").alias("_pa")), "a")
            .join(sketches.select(F.col("node").alias("b"), F.col("parity").alias("_pb")), "b"))
    differ = F.aggregate(F.zip_with("_pa", "_pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    return both.where(differ <= F.col("na") + F.col("nb") - 2 * need(F.col("na"), F.col("nb"), num, den)).select("a", "na", "b", "nb")


def _pack(s: np.ndarray) -> bytes:
    """The top 40 bits of sorted shingles."""
    return s.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


@F.arrow_udf(T.IntegerType())
def _overlap(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array([len(np.intersect1d(_unpack(a.as_py()), _unpack(b.as_py()), assume_unique=True)) for a, b in zip(x, y)], pa.int32())


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, na, b, nb) whose sets reach the threshold."""
    left = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "_sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"node": "b", "shingles": "_sb"}), "b")
    shared = both.select("a", "b", "na", "nb", _overlap("_sa", "_sb").alias("_i"))
    return shared.where(F.lit(den) * F.col("_i") >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("_i"))).select("a", "b")


def links_and_components(docs: DataFrame, id_col: str, text: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(features of each row, (node, comp) of linked nodes)."""
    spark = docs.sparkSession
    feats = features(docs, id_col, text, k, num, den)
    some = feats.where(F.size("tokens") > 0)
    nodes = some.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "pos")])
    posts = (nodes.select("node", "n", F.col("pos")[0].alias("lone"), F.explode(F.arrays_zip("pos", "tokens")).alias("x"))
             .select("node", "n", "lone", F.col("x.pos").alias("pos"), F.col("x.tokens").alias("token")))
    lists = posts.groupBy("token").agg(F.count("*").alias("len")).where("len > 1")
    live = written(spark, posts.join(lists, "token"), "set-lists")
    there = live.select("node").distinct()
    sets = written(spark, some.join(there, "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in ("tokens", "parity", "shingles")]), "sets")
    comp = spark.createDataFrame([], "node long, comp long")
    links = spark.createDataFrame([], "a long, b long")

    def open_lists(comp: DataFrame) -> DataFrame:
        """Entries, with components, of the lists that hold more than one component."""
        cc = live.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = cc.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
        return cc.join(mixed, "token", "left_semi")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        found = written(spark, _near(pairs, sets, num, den), name)
        return written(spark, verified(found, sets.select("node", "shingles"), num, den), f"{name}-links", SET_ROWS)

    fields = ["node", "n", "pos", "comp"]
    for turn in range(STAR_ROUNDS):
        rows = open_lists(comp)
        # first the sets with the smallest share of shingles of their own: an edit makes such shingles, so these are the middles of their groups
        by = F.col("lone") / F.col("n") if turn == 0 else F.xxhash64("node", F.lit(turn))
        pivots = rows.groupBy("token").agg(F.min(F.struct(by.alias("h"), *fields)).alias("y"))
        cand = rows.select("token", F.struct(*fields).alias("x")).join(pivots, "token").where((F.col("x.comp") != F.col("y.comp")) & _passes("x", "y", num, den))
        # one pivot a node: that of most of its lists, then the first by h
        met = cand.groupBy(F.col("x.node").alias("a"), F.col("x.n").alias("na"), "y.h", "y.node", "y.n").agg((-F.count("*")).alias("lists"))
        star = met.groupBy("a", "na").agg(F.min(F.struct("lists", "h", "node", "n")).alias("y"))
        more = check(star.select("a", "na", F.col("y.node").alias("b"), F.col("y.n").alias("nb")), f"star-{turn}")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        comp = components(links)

    # what is left: pairs of different components, by blocks of each list. First each
    # entry's nearest one in a block only, while that finds links; then all that remain.
    for turn in range(NEAREST_ROUNDS + 1):
        every = turn == NEAREST_ROUNDS or (turn > 0 and more.isEmpty())
        found = written(spark, _met(spark, open_lists(comp), sets, num, den, every), "rest", BLOCK_ROWS)
        more = written(spark, verified(found.where("a IS NOT NULL"), sets.select("node", "shingles"), num, den), "rest-links", SET_ROWS)
        links = links.unionByName(more)
        if every or found.where("a IS NULL").isEmpty():
            break
        comp = components(links)
    return feats, components(links)


def _met(spark: SparkSession, rows: DataFrame, sets: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """Pairs (a, na, b, nb) of different components that pass the filters, of the
    entries of each two blocks of a list: with ``every`` all of them, otherwise
    each entry's nearest; a row of nulls tells that some were left out."""
    rows = rows.join(sets.select("node", "parity", "tokens"), "node")
    rows = rows.withColumn("before", F.slice("tokens", 1, F.array_position("tokens", F.col("token")).cast("int") - 1)).drop("tokens")
    cut = F.greatest(F.lit(1), F.ceil(F.col("len") / F.lit(BLOCK)))
    blocks = (rows.withColumn("band", F.floor(F.col("pos") / 8)).withColumn("part", F.pmod(F.xxhash64("node"), cut))
              .groupBy("token", "band", "part").agg(
                  F.collect_list(F.struct("node", "n", "pos", "comp", "parity", "before")).alias("rows"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("n").alias("low"), F.max("n").alias("high")))
    blocks = written(spark, blocks, "set-blocks")
    p, q = blocks.alias("p"), blocks.alias("q")
    order_of = lambda s: F.struct(F.col(f"{s}.band"), F.col(f"{s}.part"))
    least = need(F.col("p.low"), F.col("q.low"), num, den)
    may = (F.least("p.rest", "q.rest") >= least) & (F.col("p.high") * den >= F.col("q.low") * num) & (F.col("q.high") * den >= F.col("p.low") * num)
    met = p.join(q, (F.col("p.token") == F.col("q.token")) & (order_of("p") <= order_of("q")) & may)

    @F.arrow_udf("array<struct<a:long,na:int,b:long,nb:int>>")
    def survivors(x: pa.Array, y: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("na", pa.int32()), ("b", pa.int64()), ("nb", pa.int32())]))
        return pa.array([_survivors(a.as_py(), b.as_py(), num, den, every) for a, b in zip(x, y)], kind)

    return met.select(F.explode(survivors("p.rows", "q.rows")).alias("s")).select("s.*").distinct()


def _survivors(x: list[dict], y: list[dict], num: int, den: int, every: bool = True) -> list[dict]:
    """Pairs of entries of two blocks, in different components, that pass. Without
    ``every``, where they outnumber the entries: for each entry the pair whose
    sketches are likest, and a row of nulls for those left out."""
    cols = lambda rows, f: np.array([r[f] for r in rows], np.int64)
    nx, ny, px, py, cx, cy, ix, iy = cols(x, "n"), cols(y, "n"), cols(x, "pos"), cols(y, "pos"), cols(x, "comp"), cols(y, "comp"), cols(x, "node"), cols(y, "node")
    both = nx[:, None] + ny[None, :]
    least = -(-num * both // (num + den))
    ok = (cx[:, None] != cy[None, :]) & (np.minimum((nx - px)[:, None], (ny - py)[None, :]) >= least) & (np.minimum(nx[:, None], ny[None, :]) >= least)
    i, j = np.nonzero(ok)
    if not len(i):
        return []
    sx, sy = (np.array([r["parity"] for r in rows], np.int64).view(np.uint64) for rows in (x, y))
    spare = (both - 2 * least)[i, j] - np.bitwise_count(sx[i] ^ sy[j]).sum(1, dtype=np.int64)
    keep, out = np.flatnonzero(spare >= 0), []
    if not every and len(keep) > len(x) + len(y):
        best = keep[np.argsort(-spare[keep], kind="stable")]
        nearest = np.union1d(*(best[np.unique(side[best], return_index=True)[1]] for side in (i, j)))
        if len(nearest) < len(keep):
            out = [{"a": None, "na": None, "b": None, "nb": None}]
        keep = nearest
    else:
        # a pair belongs to the list of the first shingle that it shares
        earlier = [set(r["before"]) for r in x], [set(r["before"]) for r in y]
        keep = np.array([m for m in keep if earlier[0][i[m]].isdisjoint(earlier[1][j[m]])], np.int64)
    return out + [{"a": int(min(ix[a], iy[b])), "na": int(nx[a] if ix[a] < iy[b] else ny[b]), "b": int(max(ix[a], iy[b])), "nb": int(ny[b] if ix[a] < iy[b] else nx[a])}
                  for a, b in zip(i[keep], j[keep])]


def jaccard_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id. Sets
    link when |intersection| * den >= |union| * num."""
    feats, comp = links_and_components(docs.select(id_col, text), id_col, text, k, num, den)
    spark = docs.sparkSession
    members = feats.groupBy("node").agg(F.min("id").alias("low"))
    grouped = members.where("node IS NOT NULL").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = grouped.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = written(spark, grouped.join(lowest, "comp").select("node", "component_id"), "set-components")
    # copies of one set may be a third of all rows: those join by broadcast
    sizes = feats.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows"))
    right = written(spark, named.join(sizes, "node"), "set-classes")
    some = feats.where("node IS NOT NULL").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "node")
    total = some.count()
    out = split_join(some, right, ["node"], "rows", total, F.col(id_col)).select(id_col, "n_shingles", "component_id")
    none = feats.where("node IS NULL").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(none)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON reach.r = e.x)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

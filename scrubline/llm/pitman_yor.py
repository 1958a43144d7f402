"""Text scores from a hierarchical Pitman-Yor language model.

Restaurants. The root restaurant serves words of any context over a uniform
base of V + 1 words (one stands for all unknown ones). Every word that a training
token follows is a context with a restaurant of its own, whose parent is the
root; only the first token of a text is a customer of the root itself. A
customer of a context restaurant who opens a table sends one customer to the root.

Seating. Given the number of tables of each restaurant, dishes (words) are
independent, so the (word, context) counts are dealt into buckets by word, and a
bucket's task holds the tables of its words in all restaurants. A word of more
than ``SHARE`` training tokens is dealt out by context as well; its shares know
of each other's tables as of the last pass, and one share seats it at the root. A
sweep takes all customers of a dish out and seats them again, one after the other,
by the Chinese-restaurant rule; the wait until the next new table of a Polya urn
is geometric with a beta-distributed rate, so a sweep costs as many steps as there
are tables, not customers. ``PASSES`` passes over the buckets each run some sweeps
and then exchange the restaurants' table totals: a bucket sends its own totals to
the restaurants' buckets and gets those of all buckets back, packed. The last pass
averages the predictive probabilities of its ``SWEEPS`` samples, each with its own
totals. Random numbers come from the bucket's number, so a retried task draws
the same ones. Discounts are fitted by the counts of counts.

Scoring. Texts are dealt into blocks as they are read. A block keeps its texts as
positions in its own list of distinct words, asks once for each of its distinct
(word, context) pairs, packed by bucket, and gets their probabilities back in the
same order, whatever the number of texts. All counts cover all training texts.

Disk. Each step is written by a job of its own, whose shuffle files go with it;
a pass's table goes when the next one is there, the model's when the answers are.

Edge cases: null text -> only the end token; empty tables -> no rows; without
training texts V = N = 0 and every probability is 1; a context that no training
token follows gives the root's probabilities; ids may repeat or be null; output
columns replace columns of the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.session import remove, scratch_path

from . import words as W
from .common import fold, table, trim, written, written_at

PASSES, SWEEPS, STRENGTH = 2, 4, 1.0
#: Tokens of a bucket on average, and training tokens from which a word has several shares.
BUCKET_TOKENS, SHARE = 2_000_000, 500_000
#: Words of a block; a longer text is a block of its own.
BLOCK_WORDS = 5_000_000
#: Rows of an Arrow batch of texts, values numbered at a time, and tokens scored at a time.
BATCH_ROWS, NUMBERED, SCORED = 1024, 1 << 19, 1 << 20
END = np.uint64(0x9AE16A3B2F90404F)


def blocks(texts: DataFrame, block_words: int) -> DataFrame:
    """One row a block of the (id, train, text) rows: words (distinct hashes),
    counts (training tokens of each), ids, train, lengths, codes (compressed)
    and tokens (how many)."""
    def emit(parts: list[np.ndarray], ids: list, train: list) -> pa.RecordBatch:
        size = np.array([len(p) for p in parts], np.int32)
        hashes = np.concatenate(parts)
        parts.clear()
        word, code = _numbered(hashes)
        del hashes
        count = np.bincount(code[np.repeat(np.array(train, bool), size)], minlength=len(word)).astype(np.int32)
        key = hashlib.blake2b(digest_size=8)
        for part in (word, code, size, count):
            key.update(part)
        row = [int.from_bytes(key.digest(), "little", signed=True), word.view(np.int64).tobytes(), count.tobytes(), pa.array(ids, pa.int64()).to_pylist(), train, size.tobytes(),
               _zip(code), len(code)]
        del word, code, count
        trim()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _BLOCK)], [n for n, _ in _BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, train, total = [], [], [], 0
        for b in batches:
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), W.hashed(b.column(2), True)):
                if total and total + len(h) >= block_words:
                    yield emit(parts, ids, train)
                    parts, ids, train, total = [], [], [], 0
                parts.append(np.append(h, END))
                ids.append(i)
                train.append(t)
                total += len(h) + 1
        if parts:
            yield emit(parts, ids, train)

    return texts.mapInArrow(run, "block long, words binary, counts binary, ids array<long>, train array<boolean>, lengths binary, codes binary, tokens long")


_BLOCK = [("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("codes", pa.binary()), ("tokens", pa.int64())]


def _zip(a: np.ndarray) -> bytes:
    """An array compressed by byte planes (all first bytes, all second ones, ...)."""
    a = np.ascontiguousarray(a)
    raw = a.reshape(-1, 1).view(np.uint8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unzip(b: bytes, kind: type) -> np.ndarray:
    size, item = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.Codec("zstd").decompress(b[8:], decompressed_size=size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(item, -1).T).view(kind).ravel()


def _numbered(x: np.ndarray, most: int = NUMBERED) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, index of each of ``x`` among them), about ``most``
    values at a time by ranges: a sort holds several arrays of its input's length."""
    sample = np.sort(x[::512])
    edges = np.unique(sample[max(most >> 9, 1)::max(most >> 9, 1)])
    known, where, total = [], np.empty(len(x), np.int32), 0
    for k in range(len(edges) + 1):
        some = np.ones(len(x), bool) if k == 0 else x >= edges[k - 1]
        if k < len(edges):
            some &= x < edges[k]
        at = np.flatnonzero(some)
        del some
        values, index = np.unique(x[at], return_inverse=True)
        where[at] = index + total
        total += len(values)
        known.append(values)
    return np.concatenate(known), where


def _rows(rows: list[tuple], kind: list) -> pa.Table:
    return pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate(kind)})


def _find(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index in the sorted ``known`` of each of ``x``, or -1."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def _deal(w: np.ndarray, u: np.ndarray, spec: dict) -> np.ndarray:
    """Bucket of each pair: by its word; a heavy word's pairs by context, too."""
    h, at = w.copy(), _find(spec["heavy"], w)
    some = np.flatnonzero(at >= 0)
    h[some] = W.mix(h[some] + np.uint64(1) + W.mix(u[some]) % spec["shares"][at[some]])
    return (W.mix(h) % np.uint64(spec["buckets"])).astype(np.int32)


def _pairs(words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, train: np.ndarray, spec: dict):
    """Distinct (code of the word, context, training tokens, bucket) of a block in the order of
    the buckets, and the pair of each token. A context is 0 for the root, else code + 1."""
    before = np.append(np.int32(0), codes[:-1] + np.int32(1))
    before[np.cumsum(lengths) - lengths] = 0
    if spec["heads"] is not None:
        before[~np.append(True, _find(spec["heads"], words) >= 0)[before]] = 0
    key = codes.astype(np.int64)
    key *= len(words) + 1
    key += before
    del before
    pair, where = _numbered(key)
    del key
    own = np.bincount(where[np.repeat(train, lengths)], minlength=len(pair)).astype(np.int32)
    code, before = (part.astype(np.int32) for part in np.divmod(pair, len(words) + 1))
    del pair
    contexts, bucket = np.append(END, words), np.empty(len(code), np.int32)
    for a in range(0, len(code), NUMBERED):
        bucket[a:a + NUMBERED] = _deal(words[code[a:a + NUMBERED]], contexts[before[a:a + NUMBERED]], spec)
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    where = rank[where]
    del rank
    return code[order], before[order], own[order], bucket[order], where


def _cuts(a: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)) if len(a) else np.zeros(1, np.int64)


_ASK = [("block", pa.int64()), ("bucket", pa.int32()), ("w", pa.binary()), ("k", pa.binary()), ("u", pa.binary()), ("ui", pa.binary()), ("c", pa.binary())]


def _asks(spec: dict):
    """Rows (block, bucket, words, pairs of each, distinct contexts, those of the
    pairs by index, training counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                trim()
                block, words, _, _, train, lengths, codes = _block(b, j)
                code, before, c, bucket, _ = _pairs(words, codes, lengths, train, spec)
                del codes, _
                cut, contexts = _cuts(bucket), np.append(END, words)
                for lo, hi in zip(cut[:-1], cut[1:]):
                    at = _cuts(code[lo:hi])
                    ctx, ui = np.unique(contexts[before[lo:hi]], return_inverse=True)
                    row = (block, int(bucket[lo]), _zip(words[code[lo:hi][at[:-1]]]), _zip(np.diff(at).astype(np.int32)), _zip(ctx), _zip(ui.astype(np.int32)), _zip(c[lo:hi]))
                    yield from _rows([row], _ASK).to_batches()
    return run


def _block(b: pa.RecordBatch | pa.Table, k: int):
    raw = lambda name, t: np.frombuffer(b[name][k].as_py(), t)
    lengths = raw("lengths", np.int32)
    return (b["block"][k].as_py(), raw("words", np.uint64), raw("counts", np.int32), b["ids"][k].as_py(), np.array(b["train"][k].as_py(), bool), lengths, _unzip(b["codes"][k].as_py(), np.int32))


def seat(rng: np.random.Generator, customers: np.ndarray, base: np.ndarray, strength: np.ndarray, discount: float, others: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers have been seated anew: a new table
    weighs (strength + discount * all tables) * base, where all tables are
    ``others`` plus the dish's own."""
    tables = np.minimum(customers, 1).astype(np.int64)
    seated = tables.copy()
    active = np.flatnonzero(customers > 1)
    while len(active):
        t, n = tables[active], seated[active]
        new = np.maximum((strength[active] + discount * (others[active] + t)) * base[active], 1e-12)
        rate = np.maximum(rng.beta(new, n - discount * t), 1e-12)
        wait = np.minimum(rng.geometric(rate), np.int64(1) << 40)
        seated[active] = n + wait
        opens = seated[active] <= customers[active]
        tables[active[opens]] += 1
        active = active[opens & (seated[active] < customers[active])]
    return tables


#: Rows of a bucket: its dishes and who asked for them (to = -1), and the totals
#: of its contexts for the restaurants' buckets ``to``.
_DISH = [("bucket", pa.int32()), ("to", pa.int32()), ("w", pa.binary()), ("ctx", pa.binary()), ("wi", pa.binary()), ("ui", pa.binary()), ("c", pa.binary()),
         ("blocks", pa.binary()), ("sizes", pa.binary()), ("asked", pa.binary()), ("t", pa.binary()), ("n", pa.binary()), ("heavy", pa.binary()), ("sums", pa.list_(pa.float64()))]
_DISH_DDL = "bucket int, to int, w binary, ctx binary, wi binary, ui binary, c binary, blocks binary, sizes binary, asked binary, t binary, n binary, heavy binary, sums array<double>"
#: Rows of a pass: a bucket's state (to = -1) and the totals as above.
_PASS = [("bucket", pa.int32()), ("to", pa.int32()), ("ctx", pa.binary()), ("t", pa.binary()), ("n", pa.binary()), ("c0", pa.binary()), ("t0", pa.binary()), ("heavy", pa.binary()), ("sums", pa.list_(pa.float64()))]
_PASS_DDL = "bucket int, to int, ctx binary, t binary, n binary, c0 binary, t0 binary, heavy binary, sums array<double>"


def _home(ctx: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix(ctx ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(buckets)).astype(np.int32)


def _sent(bucket: int, ctx: np.ndarray, t: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    """(bucket, to, contexts, tables (a row a sample), customers) by home; ``ctx`` is in order of homes."""
    to = _home(ctx, buckets)
    cut = _cuts(to)
    return [(bucket, int(to[lo]), _zip(ctx[lo:hi]), _zip(t[:, lo:hi]), _zip(n[lo:hi])) for lo, hi in zip(cut[:-1], cut[1:])]


def _dishes(spec: dict):
    """A bucket's rows from all blocks' asks."""
    def run(key: tuple, asks: pa.Table) -> pa.Table:
        trim()
        bucket = key[0].as_py()
        get = lambda name, kind: [_unzip(v.as_py(), kind) for v in asks[name]]
        ctxs, uis, c = get("u", np.uint64), get("ui", np.int32), get("c", np.int32)
        sizes = np.array([len(x) for x in uis], np.int64)
        w = np.concatenate([np.repeat(x, k) for x, k in zip(get("w", np.uint64), get("k", np.int32))])
        c = np.concatenate(c)
        words, wi = np.unique(w, return_inverse=True)
        ctx = np.unique(np.concatenate(ctxs))
        ui = np.concatenate([np.searchsorted(ctx, x)[i] for x, i in zip(ctxs, uis)])
        order = np.argsort(_home(ctx, spec["buckets"]), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ctx = ctx[order]
        pair, asked = np.unique(wi * len(ctx) + rank[ui], return_inverse=True)
        wi, ui = pair // len(ctx), pair % len(ctx)
        n = np.bincount(asked, weights=c, minlength=len(pair)).astype(np.int64)
        root = ctx[ui] == END
        some = (n > 0) & ~root
        sums = [float(n[root].sum()), float(some.sum()), float((n[some] == 1).sum()), float((n[some] == 2).sum())]
        heavy = _heavy(bucket, words, spec, [np.bincount(wi, weights=np.where(root, n, np.minimum(n, 1)), minlength=len(words))])
        i32 = lambda a: _zip(a.astype(np.int32))
        out = [(bucket, -1, _zip(words), _zip(ctx), i32(np.diff(wi, prepend=0)), i32(ui), _zip(n), _zip(asks["block"].to_numpy()), _zip(sizes), i32(asked), None, None, heavy, sums)]
        for b, to, x, t, k in _sent(bucket, ctx, np.bincount(ui, weights=some, minlength=len(ctx)).astype(np.int64)[None], np.bincount(ui, weights=n, minlength=len(ctx)).astype(np.int64), spec["buckets"]):
            out.append((b, to, None, x, None, None, None, None, None, None, t, k, None, None))
        return _rows(out, _DISH)
    return run


def _heavy(bucket: int, words: np.ndarray, spec: dict, figures: list[np.ndarray]) -> bytes:
    """(bucket, heavy word, figures...) of the bucket's shares."""
    at = _find(spec["heavy"], words)
    some = np.flatnonzero(at >= 0)
    return np.stack([np.full(len(some), bucket), at[some], *[f[some] for f in figures]], 1).astype(np.float64).tobytes() if len(some) else b""


def _totals(key: tuple, rows: pa.Table) -> pa.Table:
    """Over the totals sent to one restaurants' bucket: to each bucket the sums."""
    ctx = [_unzip(v.as_py(), np.uint64) for v in rows["ctx"]]
    known, at = np.unique(np.concatenate(ctx), return_inverse=True)
    t = np.concatenate([_unzip(v.as_py(), np.int64).reshape(-1, len(x)) for v, x in zip(rows["t"], ctx)], 1)
    n = np.bincount(at, weights=np.concatenate([_unzip(v.as_py(), np.int64) for v in rows["n"]])).astype(np.int64)
    t = np.stack([np.bincount(at, weights=x) for x in t]).astype(np.int64)
    cut = np.cumsum([len(x) for x in ctx])
    out = [(b, key[0].as_py(), _zip(t[:, at[hi - len(x):hi]]), _zip(n[at[hi - len(x):hi]])) for b, x, hi in zip(rows["bucket"].to_pylist(), ctx, cut)]
    return _rows(out, [("bucket", pa.int32()), ("to", pa.int32()), ("t", pa.binary()), ("n", pa.binary())])


def _told(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tables (a row a sample) and customers of a bucket's contexts."""
    rows = sorted((r for r in told.select(["to", "t", "n"]).to_pylist() if r["to"] >= 0), key=lambda r: r["to"])
    n = [_unzip(r["n"], np.int64) for r in rows]
    return np.concatenate([_unzip(r["t"], np.int64).reshape(-1, len(x)) for r, x in zip(rows, n)], 1), np.concatenate(n)


def _dish(dish: pa.Table):
    raw = lambda name, kind: _unzip(dish[name][0].as_py(), kind)
    return dish["bucket"][0].as_py(), raw("w", np.uint64), raw("ctx", np.uint64), np.cumsum(raw("wi", np.int32)), raw("ui", np.int32), raw("c", np.int64)


def _gibbs(spec: dict, last: bool):
    """Over a bucket's dishes and its contexts' totals: the rows of a pass, with
    the sum of its sweeps' tables or with ``last`` those of each kept sweep."""
    def run(dish: pa.Table, told: pa.Table) -> pa.Table:
        bucket, words, ctx, wi, ui, c = _dish(dish)
        t_of, _ = _told(told)
        d0, d1, v1 = spec["d0"], spec["d1"], spec["vocabulary"] + 1.0
        root = ctx[ui] == END
        direct = np.bincount(wi, weights=np.where(root, c, 0), minlength=len(words))
        some = np.flatnonzero(~root & (c > 0))
        w, u, c1 = wi[some], ui[some], c[some]
        rest, seats = np.zeros(len(words)), np.ones(len(words), bool)
        at = _find(spec["heavy"], words)
        for k in np.flatnonzero(at >= 0):
            rest[k] = spec["all"][at[k]] - spec["own"][bucket, at[k]]
            seats[k] = spec["first"][at[k]] == bucket
        others = t_of[0][u] / spec["scale"]
        rng = np.random.default_rng([bucket, spec["pass"]])
        t1 = np.minimum(c1, 1)
        own = direct + np.bincount(w, weights=t1, minlength=len(words))
        t0 = np.minimum(own + rest, 1).astype(np.int64)
        kept: list[tuple] = []
        for sweep in range(2 * SWEEPS if last else SWEEPS):
            p0 = (own + rest - d0 * t0 + (STRENGTH + d0 * spec["root_tables"]) / v1) / (STRENGTH + spec["root_customers"])
            t1 = seat(rng, c1, p0[w], np.full(len(w), STRENGTH), d1, np.maximum(others - t1, 0))
            own = direct + np.bincount(w, weights=t1, minlength=len(words))
            t0 = seat(rng, np.rint(own + rest).astype(np.int64), np.full(len(words), 1 / v1), np.full(len(words), STRENGTH), d0, np.maximum(spec["root_tables"] - t0, 0))
            if not last or sweep >= SWEEPS:
                kept.append((t1, own, t0))
        t = np.stack([np.bincount(u, weights=x[0], minlength=len(ctx)) for x in kept])
        c0, tables = np.stack([x[1] for x in kept]).astype(np.int64), np.stack([x[2] for x in kept])
        if not last:
            t = t.sum(0)[None]
            heavy, sums = _heavy(bucket, words, spec, [c0.mean(0)]), [c0.sum() / len(kept), tables[:, seats].sum() / len(kept)]
            state = (None, None, None)
        else:
            heavy = _heavy(bucket, words, spec, [*c0, *tables])
            sums = [*c0.sum(1).astype(float), *tables[:, seats].sum(1).astype(float)]
            pair = np.zeros(len(c), np.int64)
            pair[some] = sum(x[0] for x in kept)
            state = (_zip(pair), _zip(c0), _zip(tables))
        out = [(bucket, -1, None, state[0], None, state[1], state[2], heavy, sums)]
        out += [(*r, None, None, None, None) for r in _sent(bucket, ctx, t.astype(np.int64), np.bincount(ui, weights=c, minlength=len(ctx)).astype(np.int64), spec["buckets"])]
        return _rows(out, _PASS)
    return run


_ANSWER = [("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.binary()), ("p", pa.binary())]


def _answers(spec: dict):
    """To each block that asked: training tokens of each word, and log10 (four
    bytes, seven digits) of each pair's predictive probability, averaged over the samples."""
    def run(dish: pa.Table, told: pa.Table) -> pa.Table:
        bucket, words, ctx, wi, ui, c = _dish(dish)
        d0, d1, v1 = spec["d0"], spec["d1"], spec["vocabulary"] + 1.0
        t_of, n_of = _told(told)
        state = next(r for r in told.select(["to", "t", "c0", "t0"]).to_pylist() if r["to"] < 0)
        c0, t0 = (_unzip(state[k], np.int64).reshape(SWEEPS, -1).copy() for k in ("c0", "t0"))
        n = np.bincount(wi, weights=c, minlength=len(words)).astype(np.int64)
        at = _find(spec["heavy"], words)
        some = np.flatnonzero(at >= 0)
        if len(some):
            n[some], c0[:, some], t0[:, some] = spec["heavy_n"][at[some]], spec["heavy_c0"][:, at[some]], spec["heavy_t0"][:, at[some]]
        p0 = (c0 - d0 * t0 + (STRENGTH + d0 * spec["totals_t0"][:, None]) / v1) / (STRENGTH + spec["totals_c0"][:, None])
        mixed = sum((STRENGTH + d1 * t_of[s][ui]) * p0[s][wi] for s in range(SWEEPS)) / SWEEPS
        p = (c - d1 * _unzip(state["t"], np.int64) / SWEEPS + mixed) / (STRENGTH + n_of[ui])
        p = np.log10(np.where(ctx[ui] == END, p0.mean(0)[wi], p))
        sizes, asked = _unzip(dish["sizes"][0].as_py(), np.int64), _unzip(dish["asked"][0].as_py(), np.int32)
        out = []
        for block, part in zip(_unzip(dish["blocks"][0].as_py(), np.int64).tolist(), np.split(asked, np.cumsum(sizes)[:-1])):
            w = wi[part]
            out.append((block, bucket, _zip(n[w[_cuts(w)[:-1]]]), _zip(p[part].astype(np.float32))))
        return _rows(out, _ANSWER)
    return run


def _discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 else 0.5


def _scores(spec: dict):
    """Scores of the texts of a block from its answers (bucket, n, p)."""
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k, _ in _SCORE}
        # equal blocks have one key and equal answers
        got = {r["bucket"]: (r["n"], r["p"]) for r in answers.select(["bucket", "n", "p"]).to_pylist()}
        for k in range(block.num_rows):
            trim()
            _, words, _, ids, train, lengths, codes = _block(block, k)
            code, _, _, bucket, where = _pairs(words, codes, lengths, train, spec)
            n, lp = np.zeros(len(words), np.int64), np.zeros(len(code))
            cut = _cuts(bucket)
            for lo, hi in zip(cut[:-1], cut[1:]):
                known, p = got[int(bucket[lo])]
                n[code[lo:hi][_cuts(code[lo:hi])[:-1]]] = _unzip(known, np.int64)
                lp[lo:hi] = _unzip(p, np.float32)
            del code, bucket, _
            base = np.log10((n + 1) / (spec["tokens"] + spec["vocabulary"] + 1))
            out["id"] += ids
            out["train"] += train.tolist()
            out["n_tokens"] += lengths.tolist()
            end = np.cumsum(lengths, dtype=np.int64)
            a = 0
            while a < len(lengths):  # whole texts, about SCORED tokens at a time
                lo = int(end[a - 1]) if a else 0
                b = max(int(np.searchsorted(end, lo + SCORED, "right")), a + 1)
                some, cut = slice(lo, int(end[b - 1])), end[a:b] - lengths[a:b] - lo
                out["n_known"] += np.add.reduceat((n > 0)[codes[some]].astype(np.int64), cut).tolist()
                out["base_score"] += np.add.reduceat(base[codes[some]], cut).tolist()
                out["score"] += np.add.reduceat(lp[where[some]], cut).tolist()
                a = b
        return pa.table({k: pa.array(out[k], t) for k, t in _SCORE})
    return run


_SCORE = [("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def score_texts(docs: DataFrame, is_train: Column, id_col: str = "doc_id", text: str = "text", most: int | None = None,
                block_words: int = BLOCK_WORDS, bucket_tokens: int = BUCKET_TOKENS, share: int = SHARE) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every
    row of ``docs``; the model is learned from the rows of ``is_train``. Every word
    is a context; with ``most``, only words of at least one in ``most`` training tokens."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), is_train.alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blk = written(spark, blocks(rows, block_words), "lm-blocks", BATCH_ROWS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                w, n = np.frombuffer(b["words"][k].as_py(), np.int64), np.frombuffer(b["counts"][k].as_py(), np.int32)
                for a in range(0, len(w), 50_000):
                    some = n[a:a + 50_000] > 0
                    yield pa.RecordBatch.from_arrays([pa.array(w[a:a + 50_000][some]), pa.array(n[a:a + 50_000][some].astype(np.int64))], ["w", "n"])

    unigrams = blk.select("words", "counts").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    unigrams = written(spark, unigrams, "lm-unigrams")
    total = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
    heads = None
    if most is not None:
        known = unigrams.where((F.col("n") * most >= F.lit(total.n)) & (F.col("w") != int(END.view(np.int64)))).limit(most).collect()
        heads = np.sort(np.array([r.w for r in known], np.int64).view(np.uint64))
    # at most one in ``share`` of the tokens' number
    heavy = sorted((r.w % (1 << 64), r.n) for r in unigrams.where(F.col("n") > share).collect())
    tokens = blk.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    spec = {"heads": heads, "heavy": np.array([w for w, _ in heavy], np.uint64), "heavy_n": np.array([n for _, n in heavy], np.int64),
            "shares": np.array([-(-n // share) for _, n in heavy], np.uint64), "buckets": max(1, -(-tokens // bucket_tokens)),
            "vocabulary": total.v, "tokens": total.n, "d0": _discount(total.n1, total.n2), "pass": 0}
    asks = blk.mapInArrow(_asks(spec), "block long, bucket int, w binary, k binary, u binary, ui binary, c binary")
    dishes_at = scratch_path(spark, "lm-dishes")
    dishes = written_at(spark, asks.groupBy("bucket").applyInArrow(_dishes(spec), _DISH_DDL), dishes_at)
    own, sent, passed = dishes.where("to < 0"), dishes.where("to >= 0"), []
    sums, shares = _collected(own, 3)
    direct, tables, n1, n2 = sums if len(sums) else np.zeros(4)
    spec |= {"d1": _discount(n1, n2), "root_customers": direct + tables, "root_tables": float(total.v)}
    for k in range(PASSES):
        own_of = {(int(r[0]), int(r[1])): r[2] for r in shares}
        first = {j: b for b, j in sorted(own_of, reverse=True)}
        spec = spec | {"pass": k, "own": own_of, "all": np.bincount(shares[:, 1].astype(np.int64), weights=shares[:, 2], minlength=len(heavy)), "first": first,
                       "scale": SWEEPS if k else 1}
        told = sent.select("bucket", "to", "ctx", "t", "n").groupBy("to").applyInArrow(_totals, "bucket int, to int, t binary, n binary")
        dealt = own.select("bucket", "w", "ctx", "wi", "ui", "c").groupBy("bucket").cogroup(told.groupBy("bucket"))
        passed.append(scratch_path(spark, f"lm-pass-{k}"))
        done = written_at(spark, dealt.applyInArrow(_gibbs(spec, k == PASSES - 1), _PASS_DDL), passed[k])
        for path in passed[:-1]:
            remove(spark, path)
        state, sent = done.where("to < 0"), done.where("to >= 0")
        sums, shares = _collected(state, 3 if k < PASSES - 1 else 2 + 2 * SWEEPS)
        if k < PASSES - 1 and len(sums):
            spec = spec | {"root_customers": sums[0], "root_tables": sums[1]}
    sums = sums if len(sums) else np.zeros(2 * SWEEPS)
    c0, t0 = np.zeros((SWEEPS, len(heavy))), np.zeros((SWEEPS, len(heavy)))
    for r in shares:
        c0[:, int(r[1])] += r[2:2 + SWEEPS]
        if spec["first"][int(r[1])] == r[0]:
            t0[:, int(r[1])] = r[2 + SWEEPS:]
    spec = spec | {"totals_c0": sums[:SWEEPS], "totals_t0": sums[SWEEPS:], "heavy_c0": c0, "heavy_t0": t0}
    none = F.lit(None).cast("binary")
    told = sent.groupBy("to").applyInArrow(_totals, "bucket int, to int, t binary, n binary").select("*", none.alias("c0"), none.alias("t0"))
    told = told.unionByName(state.select("bucket", "to", "t", "n", "c0", "t0"))
    answers = own.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_answers(spec), "block long, bucket int, n binary, p binary")
    # once the answers are written, nothing reads the model's tables any more
    answers = written(spark, answers, "lm-answers")
    for path in (dishes_at, *passed):
        remove(spark, path)
    kind = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    slim = {k: spec[k] for k in ("heads", "heavy", "shares", "buckets", "tokens", "vocabulary")}
    scored = blk.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(slim), kind)
    return scored.withColumn("train_tokens", F.lit(total.n).cast("long"))


def _collected(state: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets' sums, and the rows of ``width`` figures of the heavy words' shares."""
    rows = state.select("sums", "heavy").collect()
    shares = np.frombuffer(b"".join(bytes(r.heavy) for r in rows), np.float64).reshape(-1, width)
    return np.sum([r.sums for r in rows], 0) if rows else np.zeros(0), shares


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Spelling variants: words one edit apart, by a frontier over relational tries.

The vocabulary is stored as two tries, one of the words and one of the words read
backwards, each a table of edges (depth, node, letter, child). A node is the hash
of its prefix. A state (word, position, node, edits) says that the word's first
letters lead to the node with so many edits. States of no edit are the prefixes
of a word themselves, so they all are known at once; from there

- *replace*: a state without edits follows every edge but that of its next letter;
- *delete*: it skips its next letter and stays at its node (the last letter of a run
  of equal ones stands for all);
- *match*: a state with one edit follows the edge of its next letter.

Level by level of the tries, the states at depth d are joined with the edges of
depth d, and what comes out is written as the states of depth d + 1. States of one
edit that have read their whole word and stand on the end of another one are
neighbours; an insertion is the other word's deletion.

Two words one edit apart share half of the shorter one from the front or from the
back. So an edit in the second half of a word is looked for in the forward trie and one in
the first half in the backward trie, each behind an exact half: no state fans out
over the top of a trie, where a third of all words may share a node. Skewed nodes
further down are split by Spark's adaptive join; small levels are broadcast by it.

Beyond depth ``LEVELS`` the tries are path-compressed: the rest of a word is one
edge, labelled with its hash, for every position; such edges are followed in the last
join, with the word ends. So a word of any length costs rows in proportion to its length
and the number of levels is fixed. Pairs found by 64-bit hashes of prefixes are verified
on the words by ``levenshtein``.

A word's ``form`` is its most frequent neighbour (ties: smallest in code-point order)
if that is at least ``factor`` times as frequent; following forms leads to its
``root``. Frequencies grow tenfold a step, so chains are short; they are followed by
doubling.

Edge cases: null, empty or letterless texts give no words; a null id counts as ''; an empty
table -> no rows; rows with equal ids and texts count as often as they stand there.
Extra columns of the input take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: Depth from which the rest of a word is one edge.
LEVELS = 32
LETTERS = "A-Za-zÀ-ÿ"
_ODD = np.uint64(0x9E3779B97F4A7C15)     # odd, so invertible modulo 2 ** 64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_EDGES = "depth int, node long, letter string, child long"
_STATES = "depth int, word long, node long, edits int, ahead string, tail long"
_ENDS = "node long, tail long, letter string, other long"


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2,
               noise: int | None = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters and how often they occur. With
    ``noise``, an occurrence whose crc32(``id:run``) it divides loses the letter at
    that crc32 modulo the run's length."""
    run = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_id"),
                      F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{min_length},}}+"), F.lit(0))).alias("_run"))
    run = run.withColumn("_run", ascii_lower(F.col("_run")))
    if noise is not None:
        run = run.withColumn("_h", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")))
        at = (F.col("_h") % F.length("_run")).cast("int")
        cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
        run = run.select(F.when(F.col("_h") % noise == 0, cut).otherwise(F.col("_run")).alias("_run"))
    return (run.where(F.length("_run") >= min_length).groupBy(F.col("_run").alias("word")).agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with an id that follows the code-point order of ``word``."""
    dealt = words.repartitionByRange(F.substring("word", 1, 64)).sortWithinPartitions("word")
    return written(words.sparkSession, dealt.withColumn("id", F.monotonically_increasing_id()), "spelling-words")


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Spelled:
    """Prefix and tail hashes of all positions of a batch of words, read forwards
    or backwards. A prefix's hash is a polynomial in ``_ODD`` over its letters,
    taken from one running sum over the batch."""

    def __init__(self, words: list[str], backwards: bool):
        self.words = [w[::-1] for w in words] if backwards else words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.backwards = backwards
        code = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.append(np.uint64(1), np.full(len(code), _ODD)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(len(code), _INVERSE)))
            self.sum = np.append(np.uint64(0), np.cumsum(_mix(code.astype(np.uint64) + np.uint64(1)) * self.up[:-1]))

    def node(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the first ``at`` letters."""
        s = self.start[word]
        with np.errstate(over="ignore"):
            h = (self.sum[s + at] - self.sum[s]) * self.down[s]
            return _mix(h + np.uint64(1 + self.backwards) + (at.astype(np.uint64) << np.uint64(2))).view(np.int64)

    def tail(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the letters from ``at`` on, 0 if there are none."""
        at = np.minimum(at, self.size[word])
        s = self.start[word]
        with np.errstate(over="ignore"):
            return ((self.sum[s + self.size[word]] - self.sum[s + at]) * self.down[s + at]).view(np.int64)

    def half(self) -> np.ndarray:
        """Letters that must agree before an edit is looked for in this direction."""
        front = (self.size - 1) // 2
        return self.size - 1 - front if self.backwards else front


def _positions(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, position) for all first[w] <= position < end[w]."""
    n = np.maximum(end - first, 0)
    word = np.repeat(np.arange(len(n)), n)
    return word, np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + first[word]


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[Spelled, np.ndarray]]:
    for batch in parts:
        for k in range(0, batch.num_rows, 4096):
            cut = batch.slice(k, 4096)
            words, ids = cut.column("word").to_pylist(), cut.column("id").to_numpy()
            for backwards in (False, True):
                yield Spelled(words, backwards), ids


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f"_{k}" for k in range(len(columns))])


def edges(words: DataFrame, first: int, levels: int = LEVELS) -> DataFrame:
    """Edges of both tries at depths first .. levels - 1, each once."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sp, _ in _batches(parts):
            w, p = _positions(np.full(len(sp.size), first), np.minimum(sp.size, levels))
            node, child = sp.node(w, p), sp.node(w, p + 1)
            _, at = np.unique(child, return_index=True)
            w, p = w[at], p[at]
            letter = [sp.words[a][b] for a, b in zip(w.tolist(), p.tolist())]
            yield _named(_rows(p.astype(np.int32), node[at], pa.array(letter, pa.string()), child[at]), _EDGES)
    return words.select("word", "id").mapInArrow(cut, _EDGES).distinct()


def _named(batch: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    return batch.rename_columns([c.split()[0] for c in schema.split(", ")])


def starts(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """States at which an edit is made: before a replacement (edits 0) and after a
    deletion (edits 1). At depths from ``levels`` on, ``ahead`` is empty or, before
    a replacement, the one letter to be replaced, and ``tail`` what follows it."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sp, ids in _batches(parts):
            w, p = _positions(sp.half(), sp.size)
            node = sp.node(w, p)
            text = [(sp.words[a], b) for a, b in zip(w.tolist(), p.tolist())]
            deep = p >= levels
            ahead = [t[b:b + 1] if b >= levels else t[b:levels] for t, b in text]
            yield _named(_rows(p.astype(np.int32), ids[w], node, np.zeros(len(p), np.int32), pa.array(ahead, pa.string()),
                               sp.tail(w, np.where(deep, p + 1, levels))), _STATES)
            last = np.array([t[b:b + 1] != t[b + 1:b + 2] for t, b in text], bool)
            w, p, node = w[last], p[last], node[last]
            ahead = [t[b + 1:levels + 1] for (t, b), ok in zip(text, last.tolist()) if ok]
            yield _named(_rows(p.astype(np.int32), ids[w], node, np.ones(len(p), np.int32), pa.array(ahead, pa.string()),
                               sp.tail(w, np.maximum(p + 1, levels + 1))), _STATES)
    return words.select("word", "id").mapInArrow(cut, _STATES)


def ends(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Where words end, and the path-compressed edges below depth ``levels``: with an
    empty letter the rest of a word behind a node, else what follows that letter."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sp, ids in _batches(parts):
            w, p = _positions(np.minimum(sp.size, levels), sp.size + 1)
            yield _named(_rows(sp.node(w, p), sp.tail(w, p), pa.array([""] * len(w), pa.string()), ids[w]), _ENDS)
            w, p = _positions(np.full(len(sp.size), levels), sp.size)
            letter = [sp.words[a][b] for a, b in zip(w.tolist(), p.tolist())]
            yield _named(_rows(sp.node(w, p), sp.tail(w, p + 1), pa.array(letter, pa.string()), ids[w]), _ENDS)
    return words.select("word", "id").mapInArrow(cut, _ENDS)


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One level down: states of one edit follow their next letter, states without
    edits all others."""
    same = F.col("letter") == F.substring("ahead", 1, 1)
    met = states.join(edges.select("node", "letter", "child"), "node").where((F.col("edits") == 1) == same)
    return met.select("word", F.col("child").alias("node"), F.lit(1).alias("edits"), F.expr("substring(ahead, 2)").alias("ahead"), "tail")


def neighbours(words: DataFrame, min_length: int, levels: int = LEVELS) -> DataFrame:
    """(a, b) ids of words one edit apart, a < b, each pair once. ``words`` has word
    and id, and words of at least ``min_length`` letters only."""
    spark = words.sparkSession
    first = (min_length - 1) // 2
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    bottom = min(longest, levels)
    trie = written(spark, edges(words, first, levels).sortWithinPartitions("depth"), "spelling-edges")
    begun = written(spark, starts(words, levels).sortWithinPartitions("depth"), "spelling-states")
    flow = ["word", "node", "edits", "ahead", "tail"]
    done, moved = [], None
    for depth in range(first, bottom):
        # states that have read their word wait in their level's table for the last join
        states = begun.where(f"depth = {depth} AND ahead <> ''").select(*flow)
        if moved is not None:
            states = states.unionByName(moved.where("ahead <> ''"))
        moved = written(spark, _step(states, trie.where(f"depth = {depth}")), "spelling-level")
        done.append(moved.where("ahead = ''").select("word", "node", "tail", F.lit("").alias("avoid")))
    done.append(begun.where(f"depth >= {levels} OR ahead = ''").select("word", "node", "tail", F.col("ahead").alias("avoid")))
    final = done[0]
    for more in done[1:]:
        final = final.unionByName(more)
    met = final.join(ends(words, levels), ["node", "tail"]).where(
        "word <> other AND ((avoid = '' AND letter = '') OR (avoid <> '' AND letter <> '' AND avoid <> letter))")
    pairs = met.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()
    left, right = (words.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of a table (id, form) without cycles: chains are followed by doubling."""
    spark = forms.sparkSession
    at = written(spark, forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("id").alias("root"), F.col("root").alias("_up"))
        nxt = written(spark, at.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "spelling-roots")
        if nxt.where("_moved").isEmpty():
            return at
        at = nxt.drop("_moved")


def group(vocab: DataFrame, min_length: int = 7, factor: int = 10, levels: int = LEVELS) -> DataFrame:
    """``vocab`` (word, n) with form, root, n_near and form_n."""
    spark = vocab.sparkSession
    words = numbered(vocab.where(F.length("word") >= min_length).select("word", "n"))
    pairs = written(spark, neighbours(words, min_length, levels), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = words.select(F.col("id").alias("b"), F.col("n").alias("n_b"))
    best = both.join(count, "b").groupBy(F.col("a").alias("id")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b"))).alias("top"))
    near = words.select("id", "n").join(best, "id").select(
        "id", "n_near", *[F.when(-F.col("top.n") >= factor * F.col("n"), c).alias(name) for c, name in ((F.col("top.b"), "form"), (-F.col("top.n"), "form_n"))])
    near = written(spark, near, "spelling-near")
    forms = near.where("form IS NOT NULL").select("id", "form", "form_n")
    names = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    last = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    named = forms.join(names, "form").join(roots(forms), "id").join(last, "root").select("id", "form_word", "root_word", "form_n")
    out = words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(table(spark, sf_dir, "documents"))
    return group(vocab)


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
           CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + unicode(ch)::BIGINT // 64, 128 + unicode(ch)::BIGINT % 64] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h
  FROM bytes, crc),
v AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, p, word[1:p] || word[p + 2:] AS rest FROM (SELECT word, unnest(range(length(word))) AS p FROM v)),
less AS (SELECT DISTINCT cut.word AS a, v.word AS b FROM cut JOIN v ON cut.rest = v.word),
near AS (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
  UNION ALL SELECT a, b FROM less UNION ALL SELECT b, a FROM less),
best AS (
  SELECT a, count(*) AS n_near, min({'n': -v.n, 'w': b}) AS top FROM near JOIN v ON v.word = b GROUP BY a),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 10 * v.n THEN top.w END AS form, CASE WHEN -top.n >= 10 * v.n THEN -top.n END AS form_n
  FROM v LEFT JOIN best ON best.a = v.word),
path AS (
  SELECT word, word AS cur, 0 AS step FROM forms
  UNION ALL SELECT path.word, forms.form, step + 1 FROM path JOIN forms ON forms.word = path.cur WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(cur, step) AS root FROM path GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

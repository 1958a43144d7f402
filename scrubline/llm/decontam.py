"""Benchmark decontamination by template canonicalisation (native).

A text becomes a template, one token a word: capitalised words inside a sentence
turn into ``<name>``, words that start with a digit into ``<num>``, units behind
a number into ``<unit>``; everything else is lower-cased. So a benchmark question
whose names and numbers were exchanged keeps its template.

1. Every benchmark item of at least ``2 * WINDOW - 1`` words is indexed by all
   its windows of ``WINDOW`` template tokens that hold at most three placeholders;
   a shorter one by its whole template, and by that with its first word as
   ``<name>``, if it is capitalised (as it is behind words without a full stop).
   If more than three fifths of it are placeholders, all its words must be equal.
2. Each distinct document text is probed with all its windows, so it does not
   matter where a passage stands. The hash join of probes and index gives the
   candidate texts.
3. Candidate texts are compared at every position. Matches of one item at one
   offset form an alignment; it counts if it covers at least ``COVERAGE`` of the
   item's windows, alone or with those of neighbouring offsets (at most ``SLIP``
   from one to the next), or if it holds ``RUN`` covered words in a row; and if
   its slots (those of the run) are consistent: within
   covered words, equal item values stand for equal document values and unequal
   ones for unequal ones.

Documents are keyed by two 64-bit hashes of their text, so copies are judged
once. The benchmark's index and the candidates are broadcast only when counted
small; texts held by a thousandth of all rows or more are joined by broadcast.

Edge cases: null or empty texts and items match nothing; repeated rows each get a row; an empty benchmark finds nothing; columns of
``docs`` named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, split_join, table, written

WINDOW, COVERAGE, MOST_SLOTS = 5, 0.5, 3
#: Words in a row that are a leak whatever the item's length, and how far shifts of one copy may lie apart.
RUN, SLIP = 13, 2
#: Units that count as such behind a number.
UNITS = ("cm", "days", "degrees", "dollars", "euros", "feet", "g", "grams", "hours", "inches", "kg", "km", "liters", "litres", "m", "meters",
         "metres", "miles", "minutes", "mm", "months", "mph", "percent", "pounds", "seconds", "weeks", "yards", "years")
_UNIT = "|".join(UNITS)
SLOTS = ("<name>", "<num>", "<unit>")


def spaced(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def template(words: Column) -> Column:
    """Template of spaced words: as many tokens, one space between them."""
    t = F.regexp_replace(words, r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}[^ ]*", "<name>")
    t = F.regexp_replace(t, r"(?<![^ ])[^\p{L}\p{N} ]*[0-9][^ ]*", "<num>")
    return F.regexp_replace(F.lower(t), rf"(?<=<num> )(?:{_UNIT})[.,;:!?]*(?![^ ])", "<unit>")


def _windows(tokens: Column, n: Column) -> Column:
    """(pos, hash) of every window of a token array with at most MOST_SLOTS placeholders."""
    def one(k: Column) -> Column:
        w = F.slice(tokens, k + 1, WINDOW)
        slots = F.size(F.filter(w, lambda t: t.isin(*SLOTS)))
        return F.struct(k.alias("pos"), F.xxhash64(F.array_join(w, " ")).alias("h"), slots.alias("slots"))
    every = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), one)).otherwise(F.array().cast("array<struct<pos:int,h:long,slots:int>>"))
    return F.filter(every, lambda w: w["slots"] <= MOST_SLOTS)


def _probes(text: Column, n: int) -> Column:
    """Hashes of all windows of ``n`` tokens of a template: from each of the first
    ``n`` tokens on, the windows one behind the other."""
    block = rf"(?:[^ ]+ ){{{n - 1}}}[^ ]+"
    rest = lambda k: F.regexp_replace(text, rf"^(?:[^ ]+ ){{{k}}}", "") if k else text
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(rest(k), F.lit(block), F.lit(0)), lambda b: F.xxhash64(b)) for k in range(n)]))


def _parts(df: DataFrame, text: str, *keep: str) -> DataFrame:
    s = df.select(*keep, spaced(F.col(text)).alias("_s"))
    return s.select(*keep, F.split("_s", " ").alias("words"), F.split(template(F.col("_s")), " ").alias("tokens"))


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words, tokens, windows of the items that take part."""
    parts = _parts(benchmark, text, item_id).withColumnRenamed(item_id, "item_id")
    win = parts.where(F.size("tokens") >= 2 * WINDOW - 1).select("*", _windows(F.col("tokens"), F.size("tokens")).alias("windows"))
    return win.where(F.size("windows") > 0)


def short_items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words, tokens, n and h (hashes of whole templates) of the shorter items."""
    parts = _parts(benchmark, text, item_id).withColumnRenamed(item_id, "item_id").withColumn("n", F.size("tokens"))
    some = parts.where((F.col("n") < 2 * WINDOW - 1) & (F.array_join("words", "") != ""))
    named = F.concat(F.array(F.lit(SLOTS[0])), F.slice("tokens", 2, 2 * WINDOW))
    both = F.when(F.get("words", F.lit(0)).rlike(r"^\p{Lu}\p{Ll}"), F.array("tokens", named)).otherwise(F.array("tokens"))
    return some.withColumn("h", F.transform(both, lambda t: F.xxhash64(F.array_join(t, " "))))


def _value(words: str | Column, p: Column) -> Column:
    return F.regexp_replace(F.lower(F.get(words, p)), r"[.,;:!?]+$", "")


def short_leaks(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(_k1, _k2, item_id): texts that hold a shorter item whole, with consistent slots."""
    lengths = [r.n for r in items.select("n").distinct().orderBy("n").collect()]
    keys = items.select("item_id", "n", F.explode("h").alias("h"))
    if not lengths:
        return texts.select("_k1", "_k2").limit(0).crossJoin(items.select("item_id").limit(0))
    hashes = small(keys.select("h").distinct(), 1_000_000)
    t = texts.select("_k1", "_k2", template(spaced(F.col("text"))).alias("t"))
    probes = t.select("_k1", "_k2", F.explode(F.flatten(F.array(*[_probes(F.col("t"), n) for n in lengths]))).alias("h"))
    hit = written(texts.sparkSession, probes.join(hashes, "h", "left_semi").select("_k1", "_k2").distinct(), "short-candidates")
    near = texts.join(small(hit, 100_000), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    parts = written(texts.sparkSession, _parts(near, "text", "_k1", "_k2"), "short-texts")
    at = lambda n: F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(0), F.size("tokens") - n), lambda k: F.struct(
        F.lit(n).alias("n"), k.alias("dpos"), F.xxhash64(F.array_join(F.slice("tokens", k + 1, n), " ")).alias("h"))))
    none = F.array().cast("array<struct<n:int,dpos:int,h:long>>")
    places = parts.select("_k1", "_k2", F.explode(F.flatten(F.array(*[F.coalesce(at(n), none) for n in lengths]))).alias("w"), "words")
    found = places.select("_k1", "_k2", F.col("w.n").alias("n"), F.col("w.h").alias("h"), F.slice("words", F.col("w.dpos") + 1, F.col("w.n")).alias("dwords"))
    pairs = (found.join(small(keys, 1_000_000), ["n", "h"])
             .join(small(items.select("item_id", F.col("words").alias("iwords"), "tokens"), 1_000_000), "item_id"))
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.struct(
        F.get("tokens", p).isin(*SLOTS).alias("slot"), _value("iwords", p).alias("i"), _value("dwords", p).alias("d")))
    checked = pairs.select("_k1", "_k2", "item_id", "n", every.alias("all")).withColumn("b", F.array_distinct(F.filter("all", lambda x: x["slot"])))
    one = lambda f: F.size(F.array_distinct(F.transform("b", lambda x: x[f])))
    slots = F.size(F.filter("all", lambda x: x["slot"]))
    # a word that is no slot of the item is equal, also where it is one of the text
    same = F.forall("all", lambda x: (x["slot"] & (slots * WINDOW <= F.col("n") * MOST_SLOTS)) | (x["i"] == x["d"]))
    return checked.where((one("i") == F.size("b")) & (one("d") == F.size("b")) & same).select("_k1", "_k2", "item_id").distinct()


def leaks(texts: DataFrame, items: DataFrame, short: DataFrame) -> DataFrame:
    """(_k1, _k2, items): distinct texts (_k1, _k2, text) with the ids of the
    benchmark items that they hold."""
    index = items.select("item_id", F.size("windows").alias("total"), F.explode("windows").alias("w")).select(
        "item_id", "total", F.col("w.pos").alias("ipos"), F.col("w.h").alias("h"))
    hashes = small(index.select("h").distinct(), 1_000_000)
    probes = texts.select("_k1", "_k2", template(spaced(F.col("text"))).alias("t")).select("_k1", "_k2", F.explode(_probes(F.col("t"), WINDOW)).alias("h"))
    hit = written(texts.sparkSession, probes.join(hashes, "h", "left_semi").select("_k1", "_k2").distinct(), "leak-candidates")
    near = texts.join(small(hit, 100_000), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    parts = written(texts.sparkSession, _parts(near, "text", "_k1", "_k2"), "leak-texts")
    found = (parts.select("_k1", "_k2", F.explode(_windows(F.col("tokens"), F.size("tokens"))).alias("w"))
             .select("_k1", "_k2", F.col("w.pos").alias("dpos"), F.col("w.h").alias("h")).join(small(index, 1_000_000), "h"))
    aligned = found.groupBy("_k1", "_k2", "item_id", "total", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.sort_array(F.collect_set("ipos")).alias("hits"))
    # runs of covered words of one alignment: a hit more than WINDOW behind the last one starts another
    split = F.filter(F.sequence(F.lit(1), F.size("hits")), lambda k: (k == 1) | (F.get("hits", k - 1) - F.get("hits", k - 2) > WINDOW))
    last = lambda i: F.coalesce(F.get("split", i + 1), F.size("hits") + 1) - F.get("split", i)
    runs = F.transform("split", lambda k, i: F.slice("hits", k, last(i)))
    run_words = lambda r: F.element_at(r, -1) - F.get(r, F.lit(0)) + WINDOW
    placed = lambda hits, shift: F.transform(hits, lambda p: F.struct(p.alias("p"), shift.alias("shift")))
    alone = aligned.withColumn("split", split).withColumn("runs", F.filter(runs, lambda r: run_words(r) >= RUN))
    enough = F.size("hits") >= COVERAGE * F.col("total")
    either = F.concat(F.when(enough, F.array("hits")).otherwise(F.array().cast("array<array<int>>")), F.col("runs"))
    cands = alone.select("_k1", "_k2", "item_id", F.explode(either).alias("hits"), "shift").select("_k1", "_k2", "item_id", placed("hits", F.col("shift")).alias("places"))
    # alignments of neighbouring shifts together, as words put in or left out make them
    by_shift = Window.partitionBy("_k1", "_k2", "item_id").orderBy("shift")
    new = F.coalesce(F.col("shift") - F.lag("shift").over(by_shift) > SLIP, F.lit(True)).cast("int")
    chained = (aligned.withColumn("new", new).withColumn("chain", F.sum("new").over(by_shift)).groupBy("_k1", "_k2", "item_id", "total", "chain")
               .agg(F.flatten(F.collect_list(placed("hits", F.col("shift")))).alias("places"), F.count("*").alias("shifts"))
               .where((F.col("shifts") > 1) & (F.size(F.array_distinct(F.col("places.p"))) >= COVERAGE * F.col("total"))))
    cands = cands.unionByName(chained.select("_k1", "_k2", "item_id", "places"))
    pairs = (cands.join(parts.select("_k1", "_k2", F.col("words").alias("dwords")), ["_k1", "_k2"])
             .join(items.select("item_id", F.col("words").alias("iwords"), "tokens"), "item_id"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda x: F.transform(
        F.sequence(x["p"], x["p"] + (WINDOW - 1)), lambda p: F.struct(p.alias("p"), x["shift"].alias("shift"))))))
    slots = F.filter(covered, lambda x: F.get("tokens", x["p"]).isin(*SLOTS))
    both = F.array_distinct(F.transform(slots, lambda x: F.struct(
        _value("iwords", x["p"]).alias("i"), _value("dwords", x["p"] + x["shift"]).alias("d"))))
    checked = pairs.select("_k1", "_k2", "item_id", both.alias("b"))
    one = lambda f: F.size(F.array_distinct(F.transform("b", lambda x: x[f])))
    long = checked.where((one("i") == F.size("b")) & (one("d") == F.size("b"))).select("_k1", "_k2", "item_id")
    return long.unionByName(short_leaks(texts, short)).groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with items (ids of benchmark items found, ascending) and leaked."""
    kept = [c for c in docs.columns if c not in ("items", "leaked")]
    key = [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k1"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1)).alias("_k2")]
    keyed = docs.select(*kept, *key)
    found = leaks(docs.select(*key, F.col(text).alias("text")), items_of(benchmark), short_items_of(benchmark))
    # copies of each leaking text, so that one text may be any share of all rows
    copies = keyed.select("_k1", "_k2").join(small(found.select("_k1", "_k2"), 100_000), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.count("*").alias("n"))
    right = written(docs.sparkSession, found.join(copies, ["_k1", "_k2"]), "leaks")
    out = split_join(keyed, right, ["_k1", "_k2"], "n", docs.count(), F.struct(*[c for c in kept if c != text] or [text]))
    none = F.array().cast(dict(right.dtypes)["items"])
    return out.select(*kept, F.coalesce("items", none).alias("items")).withColumn("leaked", F.size("items") > 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leaked", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


def _sql_tokens(name: str, source: str, key: str) -> str:
    return f"""{name}_w AS (SELECT {key}, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM {source}),
{name}_k AS (SELECT *, list_transform(range(1, len(words) + 1), lambda i: CASE
    WHEN i > 1 AND regexp_matches(words[i], '^\\p{{Lu}}\\p{{Ll}}') AND regexp_matches(words[i - 1], '[\\p{{L}}\\p{{N}},;]$') THEN '<name>'
    WHEN regexp_matches(words[i], '^[^\\p{{L}}\\p{{N}}]*[0-9]') THEN '<num>' ELSE lower(words[i]) END) AS kinds FROM {name}_w),
{name} AS (SELECT * EXCLUDE (kinds), list_transform(range(1, len(words) + 1), lambda i: CASE
    WHEN i > 1 AND kinds[i - 1] = '<num>' AND regexp_full_match(kinds[i], '({_UNIT})[.,;:!?]*') THEN '<unit>' ELSE kinds[i] END) AS tokens FROM {name}_k)"""


def _sql_windows(name: str, key: str) -> str:
    return f"""{name}_win AS (SELECT * FROM (SELECT {key}, pos, array_to_string(tokens[pos + 1:pos + {WINDOW}], ' ') AS h,
    len(list_filter(tokens[pos + 1:pos + {WINDOW}], lambda t: t IN {SLOTS})) AS slots
    FROM (SELECT *, unnest(range(0, len(tokens) - {WINDOW - 1})) AS pos FROM {name})) WHERE slots <= {MOST_SLOTS})"""


ORACLE = f"""
WITH {_sql_tokens("d", "documents", "doc_id")},
{_sql_tokens("b0", "benchmark", "item_id")},
b AS (SELECT * FROM b0 WHERE len(tokens) >= {2 * WINDOW - 1}),
{_sql_windows("d", "doc_id")},
{_sql_windows("b", "item_id")},
total AS (SELECT item_id, count(*) AS total FROM b_win GROUP BY 1),
aligned AS (SELECT doc_id, item_id, total, d_win.pos - b_win.pos AS shift, list(b_win.pos) AS hits
  FROM d_win JOIN b_win USING (h) JOIN total USING (item_id) GROUP BY ALL
  HAVING bool_or(d_win.pos % {WINDOW} = 0) AND count(DISTINCT b_win.pos) >= {COVERAGE} * total),
places AS (SELECT DISTINCT doc_id, item_id, shift, unnest(flatten(list_transform(hits, lambda p: range(p, p + {WINDOW})))) AS p FROM aligned),
slots AS (SELECT doc_id, item_id, shift, regexp_replace(lower(b.words[p + 1]), '[.,;:!?]+$', '') AS i, regexp_replace(lower(d.words[p + shift + 1]), '[.,;:!?]+$', '') AS v
  FROM places JOIN b USING (item_id) JOIN d USING (doc_id) WHERE b.tokens[p + 1] IN {SLOTS}),
bad AS (SELECT doc_id, item_id, shift FROM slots GROUP BY ALL HAVING count(DISTINCT (i, v)) <> count(DISTINCT i) OR count(DISTINCT (i, v)) <> count(DISTINCT v)),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM aligned ANTI JOIN bad USING (doc_id, item_id, shift) GROUP BY 1)
SELECT doc_id, items IS NOT NULL AS leaked, coalesce(len(items), 0)::BIGINT AS n_items,
  coalesce(array_to_string(list_transform(items, lambda i: CAST(i AS VARCHAR)), ','), '') AS items
FROM documents LEFT JOIN found USING (doc_id)
"""

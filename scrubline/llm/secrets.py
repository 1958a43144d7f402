"""Secret scans through a trigram inverted index (native).

From each rule's regular expression the driver derives a Boolean trigram query:
the strings that every match must hold, as an AND of clauses, each an OR of
alternatives, each an AND of trigrams (lower case). Only trigrams that some rule
asks for are indexed. The index has one posting per (trigram, distinct text);
intersecting postings gives for each text the rules that can match. Candidates
are verified with the full expression on the whole text. A rule from which no
trigram can be derived scans every text.

Spans are code points, end exclusive, and found leftmost and non-overlapping for
each kind: the pieces between matches come from ``split`` and the matches from
``regexp_extract_all``; running lengths give the positions.

Texts are keyed by two 64-bit hashes, so copies are indexed once. Copies of a
text that is at least a thousandth of all rows are joined by broadcast (at most
1,000 keys), the others by a shuffle.

Edge cases: null text -> as empty, no spans; repeated rows -> a row each; tables
without rows -> no rows; columns named like an output are replaced. Spans of
different kinds may overlap; ``redact`` merges those before it replaces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_join, table, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str            # of Java, Python and RE2 alike
    min_match: int = 1      # code points of the whole match
    group: int = 0          # group whose length counts ...
    min_group: int = 0      # ... and must reach this


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, min_group=8),
    Rule("access", r"AKIA[A-Z0-9]+", min_match=16),
    Rule("hex", r"[0-9a-f]{32,}"),  # runs of 32 and more: shorter runs are no match anyway
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Most strings that a part of an expression is expanded into.
MOST_STRINGS, MOST_CLASS = 64, 8


# --- from expressions to Boolean trigram queries (driver, a few rules) ---

def _strings(tree, fold: bool) -> list[list[str] | None]:
    """The parts of a concatenation: the few strings that a part can be, or None."""
    parts: list[list[str] | None] = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            chars = []
            for k, v in arg:
                chars += [chr(v)] if str(k) == "LITERAL" else [chr(c) for c in range(v[0], v[1] + 1)] if str(k) == "RANGE" and v[1] - v[0] < MOST_CLASS else [None]
            parts.append(None if None in chars or len(chars) > MOST_CLASS else chars)
        elif name == "SUBPATTERN":
            inner = _strings(arg[3], fold)
            parts += inner
        elif name == "BRANCH":
            options = [_join(_strings(t, fold)) for t in arg[1]]
            parts.append(None if None in options else [s for o in options for s in o])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            one = _join(_strings(body, fold))
            if high == 1:
                parts.append(None if one is None else ["", *one])
            else:
                parts += [one] * min(low, 3) + [None] * (low != high or low > 3)
        elif name != "AT":
            parts.append(None)
    return parts


def _join(parts: list[list[str] | None]) -> list[str] | None:
    done = [""]
    for p in parts:
        if p is None or len(done) * len(p) > MOST_STRINGS:
            return None
        done = [a + b for a, b in product(done, p)]
    return done


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses, each an OR of alternatives, each an AND of trigrams; an
    empty list says that nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []
    run: list[str] = [""]

    def close() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            found = {frozenset(s[k:k + 3].lower() for k in range(len(s) - 2)) for s in run}
            # an alternative that asks for more than another one adds nothing
            clauses.append(sorted((a for a in found if not any(b < a for b in found)), key=sorted))
        run = [""]

    for part in _strings(re._parser.parse(pattern), False):
        if part is None:
            close()
        elif len(run) * len(part) > MOST_STRINGS:
            close()
            run = part
        else:
            run = [a + b for a, b in product(run, part)]
    close()
    return clauses


# --- index and candidates ---

def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(text, F.lit(1)).alias("_k2")]


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_k1, _k2, n, rules): of distinct texts with their present trigrams, those
    that some rule's query accepts. ``texts`` has _k1, _k2, n and present."""
    rows = [(r.kind, len(q), c, a, len(grams), g) for r in rules for q in [trigram_query(r.pattern)]
            for c, alternatives in enumerate(q) for a, grams in enumerate(alternatives) for g in sorted(grams)]
    query = texts.sparkSession.createDataFrame(rows, "kind string, n_clauses int, clause int, alt int, n_grams int, gram string")
    postings = texts.select(F.explode("present").alias("gram"), "_k1", "_k2", "n")
    met = (postings.join(F.broadcast(query), "gram")  # as many rows as the rules have trigrams
           .groupBy("_k1", "_k2", "n", "kind", "n_clauses", "clause", "alt", "n_grams").agg(F.count("*").alias("c")).where("c = n_grams"))
    return (met.groupBy("_k1", "_k2", "n", "kind", "n_clauses").agg(F.count_distinct("clause").alias("c")).where("c = n_clauses")
            .groupBy("_k1", "_k2", "n").agg(F.collect_set("kind").alias("_rules")))


def _spans(text: str, matches: str, rule: Rule, order: int) -> Column:
    """Positions of the matches by the running length of pieces and matches."""
    pieces = F.split(text, rule.pattern, -1)
    ok = lambda m: (F.length(m) >= rule.min_match) & (
        F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.min_group if rule.min_group else F.lit(True))
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["pos"] + F.length(x["piece"])
        b = a + F.length(x["match"])
        own = F.struct(a.alias("start"), F.lit(order).alias("ord"), b.alias("end"))
        return F.struct(b.alias("pos"), F.when(ok(x["match"]), F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    # pieces has one element more than matches; the last one closes the text
    both = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), F.col(matches).alias("match"))
    return F.when(F.size(matches) == 0, none).otherwise(F.aggregate(both, start, step, lambda acc: acc["out"]))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with ``out``: array of (start, end, kind), by start, then by the
    order of the rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for c in q for a in c for g in a})
    kept = [c for c in df.columns if c != out]
    rows = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if grams:
        present = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.lower(F.col("_text")), g))
        texts = (rows.select(*_key(F.col("_text")), present.alias("present"))
                 .groupBy("_k1", "_k2").agg(F.count("*").alias("n"), F.first("present").alias("present")))
        texts = written(df.sparkSession, texts, "trigrams")
        total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found = written(df.sparkSession, candidates(texts, rules), "candidates")
        keyed = rows.select("*", *_key(F.col("_text")))
        rows = split_join(keyed, found, ["_k1", "_k2"], "n", total, F.struct(*kept))
    else:
        rows = rows.withColumn("_rules", F.lit(None).cast("array<string>"))
    all_of = lambda r: F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(0))
    empty = F.array().cast("array<string>")
    found = rows.select(*kept, "_text", *[
        (F.when(F.array_contains("_rules", r.kind), all_of(r)).otherwise(empty) if queries[r.kind] else all_of(r)).alias(f"_m{k}")
        for k, r in enumerate(rules)])
    spans = F.array_sort(F.concat(*[_spans("_text", f"_m{k}", r, k) for k, r in enumerate(rules)]))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return found.select(*kept, spans.alias("_s")).select(*kept, F.transform("_s", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.element_at(kinds, s["ord"] + 1).alias("kind"))).alias(out))


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[secret]") -> DataFrame:
    """``df`` without ``spans``, each run of overlapping spans replaced by ``mark``."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return (F.when(F.size(acc) == 0, F.array(own))
                .when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider)))
                .otherwise(F.concat(acc, F.array(own))))

    kept = [c for c in df.columns if c != spans]
    merged = df.select(*kept, F.aggregate(spans, none, merge).alias("_s"))
    starts = F.concat(F.array(F.lit(0)), F.transform("_s", lambda s: s["end"]))
    ends = F.concat(F.transform("_s", lambda s: s["start"]), F.array(F.length(text)))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substr(F.col(text), p["a"] + 1, p["b"] - p["a"]))
    clean = F.when(F.size("_s") == 0, F.col(text)).otherwise(F.array_join(parts, mark))
    return merged.select(*[clean.alias(c) if c == text else F.col(c) for c in kept])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    def one(k: int, r: Rule) -> str:
        ok = f"length(x.m) >= {r.min_match}" + (f" AND length(regexp_extract(x.m, p{k}, {r.group})) >= {r.min_group}" if r.min_group else "")
        return f"""list_transform(list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'m': m{k}[i],
          'a': coalesce(list_sum(list_transform(s{k}[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda v: length(v))), 0)}}),
          lambda x: {ok}), lambda x: {{'a': x.a, 'k': {k}, 's': '{r.kind}:' || CAST(x.a AS BIGINT) || ':' || CAST(x.a + length(x.m) AS BIGINT)}}) AS l{k}"""
    quoted = [r.pattern.replace("'", "''") for r in RULES]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {', '.join(f"'{p}' AS p{k}" for k, p in enumerate(quoted))} FROM documents),
m AS (SELECT *, {', '.join(f"regexp_extract_all(t, '{p}') AS m{k}, string_split_regex(t, '{p}') AS s{k}" for k, p in enumerate(quoted))} FROM d),
l AS (SELECT doc_id, {', '.join(one(k, r) for k, r in enumerate(RULES)).replace("regexp_extract(x.m, p0,", f"regexp_extract(x.m, '{quoted[0]}',")} FROM m)
SELECT doc_id, {', '.join(f"CAST(len(l{k}) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))},
  sha256(coalesce(array_to_string(list_transform(list_sort(l0 || l1 || l2), lambda x: x.s), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(list_sort({' || '.join(f'l{k}' for k in range(len(RULES)))}), lambda x: x.s), ','), '') AS spans
FROM l"""


ORACLE = _oracle()

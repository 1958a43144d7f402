"""Toxicity by a counterfactually regularised classifier.

Features of a text are its distinct words (lower-case runs of letters) and their
first four, six and eight letters. From a bounded sample of labelled texts (at most
``DOCS_PER_LABEL`` of each label, those of the smallest hash) the executors count
in how many toxic and other texts each feature occurs; features that are clearly
commoner in toxic texts, at most ``FEATURES`` of the largest z-score, enter a
logistic regression. Identity terms always enter, if seen.

Counterfactuals. Each sampled text with identity terms is paired with its copy in
which every identity term is swapped for the next one of its group. Training
minimises log loss + ridge + ``PENALTY`` * (change of the score between the two
copies)^2, so that weight which identity terms carry only because toxic texts
mention them often is moved to the words that stay the same.

Edge cases: null or empty texts get the score of a text without features;
labels that are null or missing are not learned from; several labels of one id
count as toxic if any is; without labels of both kinds every score is the share
of toxic labels (0 without labels); extra columns are kept, outputs replace
columns of the same names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, table

DOCS_PER_LABEL, FEATURES, PENALTY, RIDGE = 12_000, 4096, 4.0, 1e-5
#: A feature must occur in this many sampled toxic texts, with this z-score, and
#: be toxic in at least this share of the texts that have it (labels reweighted
#: to be equally common).
MIN_TEXTS, MIN_Z, MIN_SHARE = 4, 3.0, 0.9
THRESHOLD = 0.7
PREFIXES = (4, 6, 8)
#: Groups of identity terms; a swap takes the next term of the group (a parameter).
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("mexican", "chinese", "american", "indian", "russian", "french", "german", "turkish"),
    ("blind", "deaf", "disabled", "elderly", "young"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)
_NEXT = {t: g[(k + 1) % len(g)] for g in IDENTITY for k, t in enumerate(g)}
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def prefixes_of(words: set[str]) -> set[str]:
    return {"^" + w[:k] for k in PREFIXES for w in words if len(w) > k}


def features_of(words: set[str]) -> set[str]:
    return words | prefixes_of(words)


def swapped(words: set[str]) -> set[str]:
    """The words of a text whose identity terms are exchanged."""
    return {_NEXT.get(w, w) for w in words}


@dataclass
class Model:
    weight: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        return self.score_words(words_of(text))

    def score_words(self, words: set[str]) -> float:
        weight = self.weight
        z = self.bias + sum(weight[f] for f in weight.keys() & words)
        for k in PREFIXES:
            z += sum(weight[f] for f in weight.keys() & {"^" + w[:k] for w in words if len(w) > k})
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _rows(groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of lists of features."""
    return np.repeat(np.arange(len(groups)), [len(g) for g in groups]), np.array([f for g in groups for f in g], np.int64)


def fit(features: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, steps: int = 400,
        rate: float = 0.1, penalty: float = PENALTY, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam over the penalised loss."""
    r, f = _rows(features)
    (ra, fa), (rb, fb) = _rows([p[0] for p in pairs]), _rows([p[1] for p in pairs])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(n + 1)
    w[n] = np.log(share / (1 - share))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(r, w[f], len(y)) + w[n])
        g = (p - y) / len(y)
        grad = np.append(np.bincount(f, g[r], n) + ridge * w[:n], g.sum())
        if pairs:
            a, b = sigmoid(np.bincount(ra, w[fa], len(pairs)) + w[n]), sigmoid(np.bincount(rb, w[fb], len(pairs)) + w[n])
            d = 2 * penalty * (a - b) / len(pairs)
            ga, gb = d * a * (1 - a), d * b * (1 - b)
            grad += np.append(np.bincount(fa, ga[ra], n) - np.bincount(fb, gb[rb], n), (ga - gb).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          docs_per_label: int = DOCS_PER_LABEL, penalty: float = PENALTY) -> Model:
    """Fit on the bounded sample. Feature counts and the sample's selected
    features come to the driver: at most FEATURES names and a list of them for
    each of 2 * docs_per_label texts."""
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y")).where("y IN (0, 1)")
    sample = bounded_sample(marked, "y", docs_per_label, [id_col])
    texts = docs.select(id_col, text).join(F.broadcast(sample), id_col).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col("y").cast("int").alias("y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both[y].update(features_of(words_of(t)))
                n[y] += 1
        both[0][""], both[1][""] = n
        names = list(both[0] | both[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[0][f] for f in names], pa.int64()), pa.array([both[1][f] for f in names], pa.int64())], ["f", "n0", "n1"])

    counts = texts.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.where("f = ''").first()
    if total is None or not total.n0 or not total.n1:
        return Model({}, -30.0 if total is None or not total.n1 else 30.0)
    odds = F.log((F.col("n1") + 0.5) / (total.n1 + 1)) - F.log((F.col("n0") + 0.5) / (total.n0 + 1))
    z = odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    # shares as if both labels were equally common
    share = (F.col("n1") / total.n1) / (F.col("n1") / total.n1 + F.col("n0") / total.n0)
    chosen = counts.where((F.col("f") != "") & ((F.col("n1") >= MIN_TEXTS) & (z >= MIN_Z) & (share >= MIN_SHARE) | F.col("f").isin(*_NEXT)))
    names = [r.f for r in chosen.orderBy(z.desc(), "f").limit(FEATURES).collect()]
    index = {f: k for k, f in enumerate(names)}

    @F.arrow_udf("own array<int>, swap array<int>")
    def pick(texts: pa.Array) -> pa.Array:
        of = lambda words: sorted(index[f] for f in features_of(words) if f in index)
        rows = []
        for t in texts.to_pylist():
            words = words_of(t)
            rows.append({"own": of(words), "swap": of(swapped(words)) if not words.isdisjoint(_NEXT) else None})
        return pa.array(rows, pa.struct([("own", pa.list_(pa.int32())), ("swap", pa.list_(pa.int32()))]))

    rows = texts.select("y", pick("text").alias("f")).select("y", "f.own", "f.swap").collect()
    rows.sort(key=lambda r: (r.y, r.own))
    w, bias = fit([r.own for r in rows], np.array([r.y for r in rows], float), [(r.own, r.swap) for r in rows if r.swap is not None and r.swap != r.own], len(names), penalty=penalty)
    return Model(dict(zip(names, w.tolist())), bias)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if score >= threshold)."""
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        out: list[float] = []
        for k in range(0, len(texts), 256):
            out += map(model.score, texts.slice(k, 256).to_pylist())
        return pa.array(out, pa.float64())

    return df.withColumn("score", of(F.coalesce(F.col(text), F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs, labels.where(~held_out))
    return score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")

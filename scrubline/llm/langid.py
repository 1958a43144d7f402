"""Language identification by interpolated Kneser-Ney character models.

A text becomes a run of letters (lower case) with one space for everything
between them. For each language there is a character model of order 4 with
interpolated Kneser-Ney smoothing: raw counts at the top, continuation counts
below, one discount per order from the counts of counts, uniform at the bottom.
All models share, for each order, one sorted array of n-gram hashes with one
column of log probabilities per language (and of context weights), so a batch
of texts is scored by binary searches: whole texts, in numpy, no loop over
characters. The language of the lowest cross-entropy per character wins.

Training takes a bounded, repeatable sample: at most ``DOCS_PER_LANG`` labelled
texts of each language, those of the smallest hash, four fifths to fit and one
fifth to calibrate. Calibration chooses the temperature of the score (softmax
of negative entropies) that makes the calibration fold likeliest, and for each
language the rejection threshold. A text is rejected when its entropy exceeds
the language's mean by more than ``SLACK`` times the largest excess seen in the
calibration fold, both scaled by the square root of the length, and is also
nearer to that of uniform letters than to that mean (so a text that mixes two
languages stays).

Edge cases: a null text or one without letters -> language ``und``, score 0.0,
rejected; no labelled rows -> every text ``und``; equal entropies -> the
alphabetically first language; extra columns are kept, outputs replace columns
of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, table, trim
from .wordcache import slices

ORDER = 4
DOCS_PER_LANG = 1500
SLACK = 4.0
#: Characters (of a batch: bytes) scored at a time.
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter in 16 bits, 32 for all that is no letter.
    (Letters beyond the basic plane share a code with others of their block.)"""
    lut = np.full(0x110000, _SPACE, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            code = ord(low[0])
            lut[cp] = code if code < 0x10000 else 0xE000 | (code & 0x7FF)
    return lut


def _mix(keys: np.ndarray) -> np.ndarray:
    """64-bit hash of packed n-grams (one-to-one, so no two n-grams collide)."""
    with np.errstate(over="ignore"):
        k = keys ^ (keys >> np.uint64(31))
        k = k * np.uint64(0x9E3779B97F4A7C15)
        return k ^ (k >> np.uint64(29))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of the texts with single spaces between words, each text
    opened by a space; and the number of codes of each text."""
    joined = "".join("\0" + t for t in texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _letters()[raw]
    doc = np.repeat(np.arange(len(texts) + 1), [*(len(t) + 1 for t in texts), 1])
    space = x == _SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep |= np.append(True, doc[1:] != doc[:-1])  # the space that opens a text
    x, doc = x[keep], doc[keep]
    n = np.bincount(doc, minlength=len(texts) + 1)[:-1]
    return x[:int(n.sum())], n


def grams(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Packed 4-grams ending at each code but the opening spaces (16 bits a
    code, the last code lowest); before its start a text counts as spaces."""
    start = np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(x)) - start
    key = x.astype(np.uint64)
    for back in range(1, ORDER):
        prev = np.full(len(x), _SPACE, np.uint64)
        prev[back:] = x[:-back]
        prev[at < back] = _SPACE
        key |= prev << np.uint64(16 * back)
    return key[at > 0]


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]      # per order 1..4: sorted hashes of n-grams
    logp: list[np.ndarray]      # per order: [n-grams, languages]
    ctx: list[np.ndarray]       # per context length 1..3: sorted hashes
    logw: list[np.ndarray]      # per context length: [contexts, languages]
    floor: np.ndarray           # log probability of an unseen character
    mean: np.ndarray            # calibration: mean entropy, threshold
    limit: np.ndarray
    heat: float

    def logprobs(self, key: np.ndarray) -> np.ndarray:
        """[n, languages]: log probability of the last code given the others."""
        return self._order(key, ORDER)

    def _order(self, key: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.broadcast_to(self.floor, (len(key), len(self.langs)))
        h = _mix(key & _MASK[k])
        at = np.searchsorted(self.keys[k - 1], h)
        at[at == len(self.keys[k - 1])] = 0
        out = self.logp[k - 1][at]
        miss = np.flatnonzero(self.keys[k - 1][at] != h)
        if len(miss):
            below = self._order(key[miss], k - 1)
            if k > 1:
                c = _mix((key[miss] & _MASK[k]) >> np.uint64(16))
                j = np.searchsorted(self.ctx[k - 2], c)
                j[j == len(self.ctx[k - 2])] = 0
                known = (self.ctx[k - 2][j] == c)[:, None]
                below = below + np.where(known, self.logw[k - 2][j], 0)
            out[miss] = below
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character [texts, languages], and characters."""
        x, n = codes(texts)
        total = np.zeros((len(texts), len(self.langs)))
        m = n - 1
        key = grams(x, n)
        doc = np.repeat(np.arange(len(texts)), m)
        for a in range(0, len(key), BLOCK_CHARS):
            lp, d = self.logprobs(key[a:a + BLOCK_CHARS]), doc[a:a + BLOCK_CHARS]
            cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            total[d[cut]] += np.add.reduceat(lp, cut, axis=0, dtype=np.float64)
        # spaces alone are no evidence
        letters = np.bincount(np.repeat(np.arange(len(texts)), n), weights=x != _SPACE, minlength=len(texts))
        m = np.where(letters > 0, m, 0)
        return -total / np.maximum(m, 1)[:, None], m

    def predict(self, texts: list[str]) -> pd.DataFrame:
        if not self.langs or not texts:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "entropy": np.nan, "rejected": True})
        ent, m = self.entropies(texts)
        best = ent.argmin(1)
        own = ent[np.arange(len(texts)), best]
        z = -(ent - own[:, None]) * self.heat * np.sqrt(np.maximum(m, 1))[:, None]
        score = 1 / np.exp(z).sum(1)
        some = m > 0
        excess = (own - self.mean[best]) * np.sqrt(np.maximum(m, 1))
        return pd.DataFrame({
            "lang_pred": np.where(some, np.array(self.langs, object)[best], UNKNOWN),
            "score": np.where(some, score, 0.0), "entropy": np.where(some, own, np.nan),
            "rejected": ~some | (excess > self.limit[best]) & (own > (self.mean - self.floor)[best] / 2)})


_MASK = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]


def kneser_ney(key: np.ndarray, lang: np.ndarray, count: np.ndarray, langs: list[str]) -> Model:
    """The models from 4-gram counts (packed gram, index of language, count)."""
    n_lang = len(langs)
    per_order: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(key, lang, count.astype(np.float64))]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct codes to the left
        up_key, up_lang, _ = per_order[0]
        pair = np.stack([up_key & _MASK[k], up_lang.astype(np.uint64)], 1)
        uniq, c = np.unique(pair, axis=0, return_counts=True)
        per_order.insert(0, (uniq[:, 0], uniq[:, 1].astype(np.int64), c.astype(np.float64)))
    n_codes = len(np.unique(per_order[0][0])) + 1
    floor = np.full(n_lang, -np.log(n_codes))
    model = Model(langs, [], [], [], [], floor, np.zeros(n_lang), np.zeros(n_lang), 1.0)
    for k in range(1, ORDER + 1):
        g, l, c = per_order[k - 1]
        n1, n2 = (np.bincount(l[c == j], minlength=n_lang) for j in (1, 2))
        d = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.9)
        context = g >> np.uint64(16)
        union = np.unique(_mix(context))
        row = np.searchsorted(union, _mix(context))
        total, kinds = np.zeros((len(union), n_lang)), np.zeros((len(union), n_lang))
        np.add.at(total, (row, l), c)
        np.add.at(kinds, (row, l), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        hashes = _mix(g)
        keys, first = np.unique(hashes, return_index=True)
        grams_k = g[first]
        lower = np.exp(model._order(grams_k, k - 1))
        r = np.searchsorted(union, _mix(grams_k >> np.uint64(16)))
        p = weight[r] * lower
        at = np.searchsorted(keys, hashes)
        add = np.maximum(c - d[l], 0) / total[row, l]
        np.add.at(p, (at, l), add)
        model.keys.append(keys)
        model.logp.append(np.log(p).astype(np.float32))
        if k == 1:
            model.floor = floor + np.log(weight[0])
        else:
            model.ctx.append(union)
            model.logw.append(np.log(weight).astype(np.float32))
    return model


def _calibrate(model: Model, texts: list[str], lang: np.ndarray) -> None:
    model.limit = np.full(len(model.langs), np.inf)
    if not texts:
        return
    ent, m = model.entropies(texts)
    some = m > 0
    ent, m, lang = ent[some], m[some], lang[some]
    if not len(m):
        return
    nll = {}
    for heat in (0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 4.0, 8.0):
        z = -ent * heat * np.sqrt(m)[:, None]
        z -= z.max(1, keepdims=True)
        p = np.exp(z[np.arange(len(m)), lang]) / np.exp(z).sum(1)
        nll[heat] = -np.log(np.maximum(p, 1e-9)).mean()
    model.heat = min(nll, key=nll.get)
    best = ent.argmin(1)
    for k in range(len(model.langs)):
        own = (best == k) & (lang == k)
        if own.any():
            model.mean[k] = np.average(ent[own, k], weights=m[own])
            model.limit[k] = SLACK * max(((ent[own, k] - model.mean[k]) * np.sqrt(m[own])).max(), 1.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit and calibrate on the bounded sample of ``labelled``: 4-grams are
    counted by the executors; only their counts come to the driver."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sample = bounded_sample(rows, "lang", docs_per_lang, ["text"])
    fitted = sample.withColumn("_fit", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(5)) > 0)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, part in pdf.groupby("lang"):
                key, c = np.unique(grams(*codes(list(part["text"]))), return_counts=True)
                yield pd.DataFrame({"lang": name, "key": key.view(np.int64), "n": c})

    counts = (fitted.where("_fit").select("lang", "text")
              .mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return Model([], [], [], [], [], np.zeros(0), np.zeros(0), np.zeros(0), 1.0)
    index = {name: k for k, name in enumerate(langs)}
    model = kneser_ney(counts["key"].to_numpy().view(np.uint64), counts["lang"].map(index).to_numpy(np.int64),
                       counts["n"].to_numpy(), langs)

    # calibration texts are scored by the executors too; a row of figures each comes back
    @F.pandas_udf("array<double>")
    def entropy(s: pd.Series) -> pd.Series:
        ent, m = model.entropies(list(s))
        return pd.Series([[float(k), *map(float, e)] for k, e in zip(m, ent)])

    held = fitted.where(~F.col("_fit")).where(F.col("lang").isin(langs)).select("lang", entropy("text").alias("e")).toPandas()
    if len(held):
        e = np.array(held["e"].tolist())
        own = type("Scored", (), {"langs": langs, "entropies": lambda self, _: (e[:, 1:], e[:, 0])})()
        own.mean, own.heat = model.mean, 1.0
        _calibrate(own, list(held["lang"]), held["lang"].map(index).to_numpy())
        model.heat, model.limit = own.heat, own.limit
    else:
        model.limit = np.full(len(langs), np.inf)
    return model


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, entropy (nats a character) and rejected."""
    names = ["lang_pred", "score", "entropy", "rejected"]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    @F.arrow_udf("lang_pred string, score double, entropy double, rejected boolean")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts:
            done = []
            for _, texts in slices(batch, 256, BLOCK_CHARS):
                found = model.predict(texts.to_pylist())
                done.append(pa.StructArray.from_arrays([pa.array(found[c], k, from_pandas=True) for c, k in zip(names, kinds)], names))
            yield pa.concat_arrays(done) if done else pa.array([], pa.struct(list(zip(names, kinds))))
        trim()

    kept = [c for c in df.columns if c not in names]
    scored = df.select(*kept, predict(F.coalesce(F.col(text), F.lit(""))).alias("_p"))
    return scored.select(*kept, *[F.col(f"_p.{c}").alias(c) for c in names])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")

"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. A text is cut at its special tokens, normalised, split into pieces by
the tokenizer's pattern, and each piece is a run of byte symbols whose last one
carries the end-of-word suffix. A piece goes through a :class:`Transducer`,
which holds a bounded buffer of symbols: once the buffer is longer than the
merge list's *sufficient lookahead*, every token that ends at least that many
symbols before the buffer's end can no longer change, whatever follows; it is
emitted and its symbols are dropped. Memory is constant in the piece's length.

Sufficient lookahead. Appending symbols can change the segmentation of what is
already there only from the right, merge by merge in the order of the list. Let
``reach[t]`` be how far left of the appended symbols the boundary between the
unchanged and the changed part can lie while the changed part starts with token
``t``. A merge (u, v) with v at that boundary moves it left by the length of u;
the changed part then starts with u (merge not made) or uv (made). One pass over
the list in order gives the bound, the largest ``reach``.

Decoding. :class:`ByteDecoder` is a byte-to-text state machine: tokens go in one
by one, and text comes out as soon as a UTF-8 sequence is complete (malformed
ones as U+FFFD). :func:`decode_ids` joins tokens as the tokenizer's own
``decode`` does when its file names no decoder (by single spaces).

Edge cases: null or empty text -> no tokens and empty decoded text; text of
white space only -> no tokens; an output column that already exists is replaced.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, trim

#: Words whose ids are kept by a worker; the cache starts anew beyond it.
CACHE_WORDS = 300_000
#: Texts are normalised in slices of about this many characters, cut at white space.
SLICE_CHARS = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others for U+0100 and up, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], width: Callable[[str], int] = len) -> int:
    reach: dict[str, int] = {}
    most = 0
    for u, v in merges:
        moved = reach.get(v, 0) + width(u)
        both = u + v
        reach[both] = max(reach.get(both, 0), reach.get(u, 0), moved)
        reach[u] = max(reach.get(u, 0), moved)
        most = max(most, moved)
    return most


class Bpe:
    """The merge list of a tokenizer file, over token ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.order = {p: k for p, (k, _) in self.rank.items()}
        self.made = [vocab[a + b] for a, b in pairs]
        self.lookahead = sufficient_lookahead(
            pairs, lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t))
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.final = [vocab[c + self.suffix] for c in alphabet]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.width = {i: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t, i in vocab.items()}
        self.special = added
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        # \s is the Unicode property there; Python's also takes U+001C..U+001F
        self.piece = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.byte_of = {c: b for b, c in enumerate(alphabet)}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges: always the pair of the smallest rank, leftmost first."""
        n, rank = len(ids), self.rank
        if n < 2:
            return ids
        if n <= 64:
            get = self.order.get
            order = [get(p, _NONE) for p in zip(ids, ids[1:])]
            while order and (best := min(order)) < _NONE:
                k = order.index(best)
                ids[k] = self.made[best]
                del ids[k + 1], order[k]
                if k:
                    order[k - 1] = get((ids[k - 1], ids[k]), _NONE)
                if k < len(order):
                    order[k] = get((ids[k], ids[k + 1]), _NONE)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[k], ids[j] = rank[a, b][1], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (ids[x], ids[y]) in rank:
                    heapq.heappush(heap, (rank[ids[x], ids[y]][0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


_NONE = 1 << 60


class Transducer:
    """Symbols of one piece in, stable tokens out; the buffer never exceeds
    twice the lookahead plus ``step`` symbols."""

    def __init__(self, bpe: Bpe, step: int = 4096):
        self.bpe, self.step = bpe, step
        self.buffer = b""

    def feed(self, data: bytes) -> Iterator[int]:
        for k in range(0, len(data), self.step):
            self.buffer += data[k:k + self.step]
            if len(self.buffer) > self.bpe.lookahead + self.step:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        # the last byte of the piece is not known yet: all symbols are inner ones
        limit, at = len(self.buffer) - self.bpe.lookahead, 0
        for i in self.bpe.merge([self.bpe.inner[b] for b in self.buffer]):
            if at + self.bpe.width[i] > limit:
                break
            at += self.bpe.width[i]
            yield i
        self.buffer = self.buffer[at:]

    def end(self) -> Iterator[int]:
        if self.buffer:
            yield from self.bpe.merge([*(self.bpe.inner[b] for b in self.buffer[:-1]), self.bpe.final[self.buffer[-1]]])
        self.buffer = b""


def normalise(text: str) -> str:
    """NFC, then lower case character by character (no final-sigma rule)."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()


class Encoder:
    """Texts to ids. Words met before are looked up in a bounded cache."""

    def __init__(self, bpe: Bpe, cache_words: int = CACHE_WORDS):
        self.bpe, self.cache_words = bpe, cache_words
        self.cache: dict[str, bytes] = {}   # whole words, with their punctuation
        self.pieces: dict[str, list[int]] = {}

    def word(self, word: str) -> bytes:
        """Ids (little-endian unsigned 32-bit) of one normalised word."""
        out: list[int] = []
        for piece in self.bpe.piece.findall(word):
            known = self.pieces.get(piece)
            if known is not None:
                out += known
                continue
            data = piece.encode("utf-8")
            if len(data) <= 256:
                ids = self.bpe.merge([*(self.bpe.inner[b] for b in data[:-1]), self.bpe.final[data[-1]]])
                out += ids
                if len(data) <= 64:
                    if len(self.pieces) >= self.cache_words:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            else:
                t = Transducer(self.bpe)
                out += t.feed(data)
                out += t.end()
        ids = struct.pack(f"<{len(out)}I", *out)
        if len(word) <= 24:
            if len(self.cache) >= self.cache_words:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out: list[bytes] = []
        at = 0
        if self.bpe.special_at is not None and "<" in text:
            for m in self.bpe.special_at.finditer(text):
                out += self._plain(text[at:m.start()])
                out.append(struct.pack("<I", self.bpe.special[m[0]]))
                at = m.end()
        out += self._plain(text[at:] if at else text)
        return b"".join(out)

    def _plain(self, text: str) -> Iterator[bytes]:
        cached, word = self.cache.get, self.word
        for part in slices(text):
            part = normalise(part)
            words = part.split() if _ODD_SPACE.search(part) is None else _SPACE.split(part)
            for w in words:
                if w:
                    ids = cached(w)
                    yield word(w) if ids is None else ids


_SPACE = regex.compile(r"\p{White_Space}+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in slices of about ``size`` characters, cut before white space
    (a run without white space is never cut)."""
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


class ByteDecoder:
    """Tokens in, text out as soon as its bytes are complete."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        token = self.bpe.token[token_id]
        if token_id not in self.bpe.width:  # special tokens are text already
            return self.state.decode(b"", True) + token
        ends = bool(self.bpe.suffix) and token.endswith(self.bpe.suffix)
        body = token.removesuffix(self.bpe.suffix) if ends else token
        text = self.state.decode(bytes(self.bpe.byte_of[c] for c in body))
        return text + (self.state.decode(b"", True) + " " if ends else "")

    def end(self) -> str:
        return self.state.decode(b"", True)


def decode_text(bpe: Bpe, ids: Iterable[int]) -> str:
    """Normalised text of the ids, words closed by one space."""
    d = ByteDecoder(bpe)
    return "".join([*map(d.feed, ids), d.end()])


def decode_ids(bpe: Bpe, ids: bytes) -> str:
    """As the library's decode(ids) without a decoder: tokens joined by spaces."""
    return " ".join(map(bpe.token.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


@lru_cache(maxsize=2)
def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    made = Encoder(load(path), cache_words)
    trim()  # what reading the file has left
    return made


def _in_slices(parts: Iterator[pa.Array], f: Callable[[list], list], kind: pa.DataType, size: int = 256) -> Iterator[pa.Array]:
    """``f`` over a few rows at a time, so that only a few texts are Python objects."""
    for arr in parts:
        done = [pa.array(f(arr.slice(k, size).to_pylist()), kind) for k in range(0, len(arr), size)]
        yield pa.concat_arrays(done) if done else pa.array([], kind)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the ids of ``text`` as little-endian unsigned 32-bit integers."""
    @F.arrow_udf("binary")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        yield from _in_slices(parts, lambda rows: [enc.encode(t) for t in rows], pa.binary())

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded", joined: bool = True) -> DataFrame:
    """``df`` with the ids' text: tokens joined as the library does, or with
    ``joined=False`` the text that the byte state machine restores."""
    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        one = (lambda b: decode_ids(bpe, b)) if joined else (lambda b: decode_text(bpe, memoryview(b).cast("I")))
        yield from _in_slices(parts, lambda rows: [one(b) for b in rows], pa.string())

    return df.withColumn(out, text(F.coalesce(F.col(ids), F.lit(b""))))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", keep_text: bool = True,
               cache_words: int = CACHE_WORDS) -> DataFrame:
    """encode() and decode() in one Python worker: both columns in one pass. Rows
    leave in batches of a few, so that what they grow to is never held for a whole
    Arrow batch. ``keep_text=False`` leaves the text itself behind; a worker
    keeps the ids of ``cache_words`` words."""
    kept = [c for c in df.columns if c not in (ids, decoded) and (keep_text or c != text)]
    given = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = T.StructType([*given.schema.fields[:-1], T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cache_words)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                cut = batch.slice(k, 256)
                packed = [enc.encode(t) for t in cut.column(len(kept)).to_pylist()]
                back = [decode_ids(enc.bpe, b) for b in packed]
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], pa.array(packed, pa.binary()), pa.array(back, pa.string())], out.names)

    return given.mapInArrow(both, out)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row."""
    both = round_trip(docs.select("doc_id", "text"), path, keep_text=False)
    return both.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())

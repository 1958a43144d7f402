"""Texts to token ids by a tokenizer library, piece by piece through a cache.

Arrow cuts a batch of texts into words or pieces and numbers the distinct ones; only
those that a bounded cache has not seen go to the library, and the ids of all
texts are then gathered by number. Nothing is kept beyond the cache and the batch.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_alphabet

#: Words a worker remembers: two generations of this many.
CACHE_WORDS = 250_000
#: Longer words are not remembered.
CACHED_CHARS = 40
#: Rows and bytes handled at a time within an Arrow batch.
SLICE_ROWS, SLICE_BYTES = 4096, 8 << 20

# The letters that lower() maps one to one and NFC leaves alone, and
# the split pattern of the tokenizer file; _PIECE states the pattern for plain words.
_LETTERS = "a-zß-öø-ÿ"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\t-\\r {_LETTERS}0-9]+)"
#: What a plain word does not hold.
_ODD = r"[^\t-\r -~À-ÖØ-öø-ÿ]"


class Recent:
    """A bounded map in two generations: a full young one becomes the old one."""

    def __init__(self, size: int = CACHE_WORDS):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def all(self, keys: list) -> list:
        """What is known of each key; None of the others."""
        found = list(map(self.young.get, keys))
        if self.old:
            for k in [k for k, v in enumerate(found) if v is None]:
                found[k] = self.get(keys[k])
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value

    def clear(self) -> None:
        self.young, self.old = {}, {}


def gather(offsets: np.ndarray, flat: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``numbers`` of a ragged table (offsets, flat): (their lengths, their
    values one after another)."""
    size = np.diff(offsets)[numbers]
    end = np.cumsum(size)
    at = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - offsets[:-1][numbers], size)
    return size, flat[at]


def ragged(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, flat values) of rows of packed 32-bit ids."""
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // 4, out=offsets[1:])
    return offsets, np.frombuffer(b"".join(rows), np.int32)


def numbered(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first word of each text and the end, number of each word, distinct words)."""
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(words.flatten())
    return offsets - offsets[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def slices(texts: pa.Array, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows): at most ``rows`` rows and about ``size`` bytes, or one longer text."""
    if not len(texts):
        return
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        before = end[a - 1] if a else 0
        b = min(max(int(np.searchsorted(end, before + size, "right")), a + 1), a + rows, len(texts))
        yield a, texts.slice(a, b - a)
        a = b


class WordEncoder:
    """Ids by a tokenizer file of the ``tokenizers`` library whose words white
    space closes. Texts are cut at ASCII white space. Plain words (ASCII and Latin-1
    letters, no special token) are cut into the pieces of the tokenizer's pattern,
    and new pieces go to the library's model; other words go whole through the
    library's encode(). With a tokenizer of another build, every text does."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _cuts_at_space(spec)
        self.odd = "|".join([_ODD, *(re.escape(t["content"]) for t in spec.get("added_tokens", []))])
        alphabet = byte_alphabet()
        self.shown = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.words, self.pieces = Recent(cache_words), Recent(cache_words)

    def _word(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, np.int32).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(self.shown)
        ids = [t.id for t in self.tok.model.tokenize(shown)] if piece else []
        return struct.pack(f"<{len(ids)}I", *ids)

    def _known(self, words: list[str], cache: Recent, make: Callable[[str], bytes]) -> list[bytes]:
        found = cache.all(words)
        for k in [k for k, ids in enumerate(found) if ids is None]:
            found[k] = ids = make(words[k])
            if len(words[k]) <= CACHED_CHARS:
                cache.put(words[k], ids)
        return found

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, plain ones by their pieces and odd ones whole, as
        (row of each word, offsets, flat) of a ragged table."""
        odd = pc.match_substring_regex(words, self.odd).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(odd)
        plain = pc.if_else(pa.array(odd), "", words) if len(rest) else words
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _PIECE, r"\1 "))
        first, number, pieces = numbered(cut)
        size, ids = gather(*ragged(self._known(pieces.to_pylist(), self.pieces, self._piece)), number)
        end = np.append(0, np.cumsum(size))[first]
        row = np.arange(len(words))
        if len(rest):
            more, flat = ragged(self._known(words.take(pa.array(rest)).to_pylist(), self.words, self._word))
            row[rest] = len(words) + np.arange(len(rest))
            end, ids = np.append(end, end[-1] + more[1:]), np.append(ids, flat)
        return row, end, ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids); a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            rows = self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            offsets, flat = ragged([np.array(r.ids, np.int32).tobytes() for r in rows])
            return np.diff(offsets), flat
        first, number, words = numbered(pc.ascii_split_whitespace(texts))
        row, offsets, flat = self._of_words(words)
        size, ids = gather(offsets, flat, row[number])
        total = np.append(0, np.cumsum(size))
        return total[first[1:]] - total[first[:-1]], ids


def _cuts_at_space(spec: dict) -> bool:
    """Whether the file is of the build that the word path is exact for: NFC, white
    space and lower case normalised, the known pattern, bytes, an end-of-word suffix."""
    parts = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = [c["pattern"].get("Regex") for c in cuts if c["type"] == "Split"]
    model = spec["model"]
    return (parts == ["NFC", "Replace", "Lowercase"] and pattern == [_PATTERN] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
            and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "normalized", "single_word")))


def per_worker(make: Callable, *args, _made: dict = {}):
    """``make(*args)`` built once in a Python worker."""
    key = (make, *args)
    if key not in _made:
        _made[key] = make(*args)
    return _made[key]

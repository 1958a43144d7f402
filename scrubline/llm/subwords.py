"""Ids of two tokenizers, byte-level BPE (A) and pieces with byte fallback (B),
by words through a cache; and the bytes of their tokens."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_alphabet
from .common import trim
from .wordcache import CACHED_CHARS, Recent, gather, numbered, ragged

#: A space (or the start) with more white space or the end behind it: such a text is
#: not cut at its spaces.
_UNEVEN = r"(^| )([\t-\r\x1c- \x{85}\x{a0}\p{Z}]|$)"
# Letters of plain words, and marks that may close one.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
#: New words go to the libraries in texts of about this many words.
JOINED = 256
#: Words of each kind a task remembers: two generations of this many, at about 0.8 kB a word.
CACHE_WORDS = 40_000
#: Stands for tokens whose bytes are not those of the text.
LOST = (b"", b"", None)
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class Pair:
    """Both tokenizers. A encodes space + text (special tokens are plain text), B the
    text, before which it puts a space itself.

    Cuts. A text whose spaces all stand before other characters is cut before each of them: A's
    pattern never crosses into such a space, and no piece of B holds a space behind
    another character (checked on loading), so a word's tokens do not depend on
    its neighbours. Marks behind a plain word are cut off, too, where no piece of B
    holds a letter before that mark. Other texts go whole through both libraries."""

    def __init__(self, a_path: str, b_path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: k for k, c in enumerate(byte_alphabet())}
        shown = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(byte_of[c] for c in shown[i]) if i in shown else b"" for i in range(max(shown) + 1)]
        self.b_bytes = []
        crosses, marks = False, set(_MARKS)
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
            crosses |= re.search("[^▁]▁", piece) is not None and not self.b.is_control(i)
            marks -= {y for x, y in zip(piece, piece[1:]) if x.isalpha()}
        self.by_word = not crosses
        self.plain = f"^(?P<core>[{_LETTERS}]+)(?P<marks>[{re.escape(''.join(sorted(marks)))}]*)$" if marks else f"^(?P<core>[{_LETTERS}]+)(?P<marks>)$"
        self.shown = {c: "".join(byte_alphabet()[k] for k in chr(c).encode()) for c in (0x20, *range(0xC0, 0x100))}
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.cores, self.marks, self.odd = (Recent(cache_words) for _ in range(3))

    def forget(self) -> None:
        """Drop the remembered words at the end of a task: the worker lives on for later stages."""
        for cache in (self.cores, self.marks, self.odd):
            cache.clear()
        trim()

    def whole(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of each text by both libraries; LOST if the bytes of either differ."""
        out = []
        for enc, b, text in zip(self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), texts):
            want, a = (" " + text).encode(), enc.ids
            same = b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
            out.append((np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if same else LOST)
        return out

    def _joined(self, words: list[str], a: np.ndarray | None) -> list[tuple[bytes, bytes]]:
        """whole() of each word, from one text of them all, whose ids are dealt out by
        the ends of the words. ``a``: A's ids of that text if they are known."""
        text = " ".join(words)
        want = (" " + text).encode()
        if a is None:
            a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int32)
        b = np.array(self.b.encode(text, num_threads=1), np.int32)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != want or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != want:
            return self.whole(words)  # some word's bytes differ
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
        (i, a), (j, b) = (([0, *((np.searchsorted(np.cumsum(size[ids]), ends) + 1) * 4).tolist()], ids.tobytes())
                          for ids, size in ((a, self.a_size), (b, self.b_size)))
        return [(a[p:q], b[r:s]) for p, q, r, s in zip(i, i[1:], j, j[1:])]

    def _cores(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Words of letters: each is a single piece of A's pattern, for its model."""
        cut, space = self.a.model.tokenize, " ".translate(self.shown)
        return self._joined(words, np.array([t.id for w in words for t in cut(space + (w if w.isascii() else w.translate(self.shown)))], np.int32))

    def _closing(self, marks: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of marks behind a letter: those of a letter and the marks without the letter's."""
        (a, b), *rest = self.whole(["a", *("a" + m for m in marks)])
        return [(x[len(a):], y[len(b):]) for x, y in rest]

    def _known(self, words: list[str], cache: Recent, make: Callable) -> list[tuple[bytes, bytes]]:
        found = cache.all(words)
        new = [k for k, ids in enumerate(found) if ids is None]
        for c in range(0, len(new), JOINED):
            part = new[c:c + JOINED]
            for k, ids in zip(part, make([words[k] for k in part])):
                found[k] = ids
                if len(words[k]) <= CACHED_CHARS:
                    cache.put(words[k], ids)
        return found

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
        """Distinct words as rows of a ragged table (offsets, entries): a plain word
        is its letters and its marks; and the ids of each entry."""
        split = pc.extract_regex(words, self.plain)
        plain = pc.is_valid(split).to_numpy(zero_copy_only=False)
        core, marks = (pc.dictionary_encode(pc.fill_null(pc.struct_field(split, k), "")) for k in (0, 1))
        rest = np.flatnonzero(~plain)
        # an odd word leaves '' among the letters, a text that is not cut among the words. Such entries
        # are never used, but joined they would put two spaces before the next word: 'a' stands in
        known = [*self._known([w or "a" for w in core.dictionary.to_pylist()], self.cores, self._cores), *self._known(marks.dictionary.to_pylist(), self.marks, self._closing),
                 *self._known([w or "a" for w in words.take(pa.array(rest)).to_pylist()], self.odd, lambda part: self._joined(part, None))]
        offsets = np.append(0, np.cumsum(np.where(plain, 2, 1)))
        entry = np.zeros(offsets[-1], np.int64)
        entry[offsets[:-1][plain]] = core.indices.to_numpy()[plain]
        entry[offsets[:-1][plain] + 1] = len(core.dictionary) + marks.indices.to_numpy()[plain]
        entry[offsets[:-1][rest]] = len(core.dictionary) + len(marks.dictionary) + np.arange(len(rest))
        return offsets, entry, known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of A's ids of each text, A's ids, number of B's ids, B's ids).
        Texts that are null, empty or do not come back byte for byte have none."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            ids = self.whole(texts.to_pylist())
            return (*_flat([x[0] for x in ids]), *_flat([x[1] for x in ids]))
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        rest = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        first, number, words = numbered(pc.split_pattern(pc.if_else(uneven, "", texts), " "))
        offsets, entry, known = self._of_words(words)
        row = number
        if len(rest):  # such a text is a single word here
            row = number.copy()
            row[first[rest]] = len(offsets) - 1 + np.arange(len(rest))
            offsets = np.append(offsets, offsets[-1] + 1 + np.arange(len(rest)))
            entry = np.append(entry, len(known) + np.arange(len(rest)))
            known += self.whole(texts.take(pa.array(rest)).to_pylist())
        size, row = gather(offsets, entry, row)
        first = np.append(0, np.cumsum(size))[first]
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        # a text with a word whose bytes differ has no tokens at all
        lost = np.array([len(ids) == 3 for ids in known], bool)[row]
        gone = np.bincount(text[lost], minlength=len(texts)) > 0
        out = []
        for k in (0, 1):
            size, flat = gather(*ragged([ids[k] for ids in known]), row)
            if gone.any():
                flat = flat[np.repeat(~gone[text], size)]
                size = np.where(gone[text], 0, size)
            total = np.append(0, np.cumsum(size))
            out += [total[first[1:]] - total[first[:-1]], flat]
        return tuple(out)


def _flat(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets, flat = ragged(rows)
    return np.diff(offsets), flat

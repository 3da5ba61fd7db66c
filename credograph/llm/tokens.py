"""Token ids of whole texts by a public tokenizer file with word ends.

The tokenizer lower-cases, splits into words and encodes each word alone, so the ids of a text
are the joined ids of its words. Words are looked up by hash in a bounded table that each worker
fills as it meets them; a miss is encoded by the ``tokenizers`` library itself.

Three ways lead to the same ids. Texts of ASCII and the letters U+00C0 to U+00FF, without an
apostrophe, are split for a whole group of documents at once on their bytes. Other Latin texts
are split by a regular expression. All others, for which Python's splitting could differ from
the library's, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from credograph.llm.spans import Group, groups, hand_back, hash_spans, hash_words

#: Latin letters, Western punctuation and signs: here lower-casing and splitting are the same
#: in Python and in the library.
_PLAIN = regex.compile(r"[\x00-\x1b\x20-\x7e\xa1-įĲ-ž‐-‧€]*")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
#: Bytes that a text for the first way doesn't hold; 0xC3 begins U+00C0 to U+00FF.
_OTHER = np.zeros(256, bool)
_OTHER[[0x1C, 0x1D, 0x1E, 0x1F, 0x27, 0x7F]] = True
_OTHER[0xC0:] = True
_OTHER[0xC3] = False


class WordIds:
    """Encoder with a table of about ``limit`` words."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        # arrays in order of hash, as a dictionary's numbers would take five times as much
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        """``hashes`` are sorted and new."""
        at, size = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        for i in range(0, len(words), 1000):
            for k, one in enumerate(self.library.encode_batch(words[i : i + 1000], add_special_tokens=False), i):
                ids = one.ids
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
                self.flat[self.used : self.used + len(ids)] = ids
                at[k], size[k] = self.used, len(ids)
                self.used += len(ids)
        where = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.size = (np.insert(x, where, new) for x, new in ((self.keys, hashes), (self.at, at), (self.size, size)))

    def _ids(self, hashes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and after how many ids each word ends; word(i) is the i-th word."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._known(distinct))
        if len(self.keys) + len(new) > self.limit:
            self._clear()
            new = np.arange(len(distinct))
        if len(new):
            self._add(distinct[new], [word(int(first[i])) for i in new])
        places = np.searchsorted(self.keys, distinct)[inverse]
        size = self.size[places].astype(np.int64)
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[places] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _known(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(distinct), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)] == distinct

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` as int32, without special tokens."""
        if "<|" in text or not _PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        words = _WORD.findall(text.lower())
        return self._ids(hash_words([w.encode() for w in words]), words.__getitem__)[0]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn; null counts as empty."""
        for g in groups(texts, limit=1 << 19):
            yield from self._group(g)

    def _group(self, g: Group) -> Iterator[np.ndarray]:
        raw, n = g.data, len(g.data)
        after = np.zeros(n, np.uint8)
        after[1:] = raw[:-1]
        odd = _OTHER[raw]
        second = after == 0xC3
        odd |= second & ((raw == 0x97) | (raw == 0xB7))
        odd |= (raw >= 0x80) & (raw < 0xC0) & ~second
        odd |= (raw == 0x7C) & (after == 0x3C)
        count = np.concatenate(([0], np.cumsum(odd)))
        plain = count[g.bounds[1:]] == count[g.bounds[:-1]]
        data = raw.copy()
        data[(raw >= 65) & (raw <= 90) | second & (raw >= 0x80) & (raw <= 0x9E)] += 32
        kind = _KIND[raw]
        new = np.empty(n, bool)
        if n:
            new[0] = True
            new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            new[g.bounds[:-1][g.bounds[:-1] < n]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        own = kind[starts] != _SPACE
        own &= np.repeat(plain, np.diff(np.searchsorted(starts, g.bounds)))
        starts, ends = starts[own], ends[own]
        ids, after_word = self._ids(hash_spans(data, starts, ends), lambda i: data[starts[i] : ends[i]].tobytes().decode())
        after_word = np.concatenate(([0], after_word))
        first = after_word[np.searchsorted(starts, g.bounds)]
        for d in range(g.n):
            if plain[d]:
                yield ids[first[d] : first[d + 1]]
            else:
                yield self.encode(raw[g.bounds[d] : g.bounds[d + 1]].tobytes().decode())


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def release() -> None:
    """Forget the encoders: a worker that goes on to other stages doesn't keep their words."""
    _ENCODERS.clear()
    hand_back()

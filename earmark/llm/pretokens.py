"""Byte-level pretokens of whole batches of text, and token ids looked up once per distinct pretoken.

Byte-level BPE merges inside pretokens only. The split of the tokenizers library is repeated here on the code points of
a whole batch at once: borders are where the kind of character changes, with the rules for one leading space, for runs
of white space and for English contractions. Documents with characters outside ``SAFE`` or with a special token are split
by the library itself.
"""

from __future__ import annotations

import unicodedata
from itertools import repeat

import numpy as np

from earmark.llm.text import mix, span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points below LIMIT have a fixed kind here; what lies beyond is split by the library.
LIMIT = 0x250
SAFE = np.zeros(LIMIT, bool)
_KIND = np.full(LIMIT, OTHER, np.uint8)
for _c in range(LIMIT):
    _category = unicodedata.category(chr(_c))
    SAFE[_c] = _category != "Cn"
    if _category[0] == "L":
        _KIND[_c] = LETTER
    elif _category[0] == "N":
        _KIND[_c] = NUMBER
_KIND[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
_CODE = mix(np.arange(1, LIMIT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: What may follow an apostrophe in one pretoken with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def split(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First code point of every pretoken of documents that lie one after another; all codes are below ``LIMIT``."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[codes]
    filled = np.diff(offsets) > 0
    begin = np.zeros(n + 1, bool)
    begin[offsets[:-1][filled]] = True
    begin[n] = True
    start = begin[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last character of a run of white space stands apart if something follows; a plain space joins what follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begin[1:-1])
    start[last] = True
    joins = last[codes[last] == 32] + 1
    start[joins] = False
    # contractions begin where a lone apostrophe begins a pretoken
    marks = np.flatnonzero((codes == 39) & start)
    for text in CONTRACTIONS:
        k = len(text)
        at = marks[marks + k < n]
        hit = np.ones(len(at), bool)
        for j, letter in enumerate(text, 1):
            hit &= (codes[at + j] == ord(letter)) & ~begin[at + j]
        at = at[hit]
        start[at + 1] = False
        after = at + 1 + k
        start[after[after < n]] = True
    return np.flatnonzero(start)


class IdCache:
    """Token ids of distinct pretokens in flat arrays. At ``limit`` pretokens those met only once are let go."""

    def __init__(self, encode_words, limit: int = 600_000):
        self.encode_words, self.limit = encode_words, limit
        self.slot: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.key, self.hits = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int32)
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(array, need):
        return array if need <= len(array) else np.concatenate([array, np.zeros(max(need, len(array)), array.dtype)])

    def _shrink(self):
        n = len(self.slot)
        keep = np.flatnonzero(self.hits[:n] > 0)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-self.hits[keep], kind="stable")[:self.limit // 2]])
        sizes = self.size[keep]
        until = np.cumsum(sizes)
        total = int(until[-1]) if len(until) else 0
        self.flat[:total] = self.flat[np.repeat(self.at[keep] - until + sizes, sizes) + np.arange(total)]
        n = len(keep)
        self.key[:n], self.size[:n], self.at[:n], self.used = self.key[keep], sizes, until - sizes, total
        self.hits[:] = 0
        self.slot = dict(zip(self.key[:n].tolist(), range(n)))

    def slots(self, hashes: np.ndarray, words_of) -> np.ndarray:
        """Slot of every hash; ``words_of`` gives the texts of those at the given places."""
        if len(self.slot) + len(hashes) > self.limit:
            self._shrink()
        keys = hashes.tolist()
        out = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        self.hits[out[out >= 0]] += 1
        new = np.flatnonzero(out < 0)
        if len(new):
            ids, sizes = self.encode_words(words_of(new))
            first, last = len(self.slot), len(self.slot) + len(new)
            self.flat = self._room(self.flat, self.used + len(ids))
            self.key, self.hits = self._room(self.key, last), self._room(self.hits, last)
            self.at, self.size = self._room(self.at, last), self._room(self.size, last)
            self.flat[self.used:self.used + len(ids)] = ids
            self.at[first:last] = self.used + np.cumsum(sizes) - sizes
            self.key[first:last], self.size[first:last] = hashes[new], sizes
            self.used += len(ids)
            out[new] = np.arange(first, last)
            self.slot.update(zip(hashes[new].tolist(), range(first, last)))
        return out


class BatchEncoder:
    """Ids of whole documents. ``encode_words(list of str)`` returns the ids and the number of ids of every word;
    ``encode_text(str)`` the ids of a document that the fast split does not cover."""

    def __init__(self, encode_words, encode_text, specials=("<|endoftext|>",), cached: int = 600_000):
        self.cache, self.encode_text, self.specials = IdCache(encode_words, cached), encode_text, specials

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts ``data[offsets[i]:offsets[i + 1]]`` one after another, and their offsets."""
        rows = len(offsets) - 1
        raw = data.tobytes()
        text = raw.decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(codes) == len(data):
            places = offsets
        else:  # code points up to each document's first byte
            places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        odd = np.zeros(rows, bool)
        strange = np.flatnonzero((codes >= LIMIT) | ~SAFE[np.minimum(codes, LIMIT - 1)])
        odd[np.searchsorted(places, strange, "right") - 1] = True
        for special in self.specials:
            at = text.find(special)
            while at >= 0:
                odd[np.searchsorted(places, at, "right") - 1] = True
                at = text.find(special, at + 1)
        ids, counts = self._fast(text, codes, places, odd)
        if odd.any():
            parts, borders = [], np.concatenate([[0], np.cumsum(counts)])
            for i in range(rows):
                if odd[i]:
                    own = np.asarray(self.encode_text(text[places[i]:places[i + 1]]), np.int32)
                    counts[i] = len(own)
                    parts.append(own)
                else:
                    parts.append(ids[borders[i]:borders[i + 1]])
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _fast(self, text, codes, places, odd):
        rows = len(places) - 1
        if odd.any():
            kept = np.repeat(~odd, np.diff(places))
            origin = np.flatnonzero(kept)
            codes = codes[kept]
            places = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(places)))])
        else:
            origin = None
        start = split(codes, places)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        end = np.append(start[1:], len(codes))
        hashes = span_hashes(_CODE[codes], start, end)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = (start, end) if origin is None else (origin[start], origin[end - 1] + 1)
        a, b = a[where], b[where]
        slots = self.cache.slots(distinct, lambda new: [text[x:y] for x, y in zip(a[new].tolist(), b[new].tolist())])
        sizes = self.cache.size[slots][inverse]
        until = np.cumsum(sizes)
        source = np.repeat(self.cache.at[slots][inverse] - until + sizes, sizes) + np.arange(until[-1])
        doc = np.searchsorted(places, start, "right") - 1
        counts = np.bincount(doc, weights=sizes, minlength=rows).astype(np.int64)
        return self.cache.flat[source], counts

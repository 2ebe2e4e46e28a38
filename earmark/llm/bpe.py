"""Byte-level BPE by segment trees over adjacent pair ranks.

Every word has a tree whose leaves are the merge ranks of its adjacent pairs. The root is the smallest ``(rank, position)``:
the leftmost lowest-rank merge. A merge changes three leaves and their ancestors only, until the root says that no pair
merges. The trees of many words of about one length are kept in one array and advance together, a merge in each at a time.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from earmark.llm.pretokens import BatchEncoder
from earmark.llm.text import give_back, pieces

NONE = np.int64(1) << 62
#: Bytes that stand for themselves in a byte-level vocabulary; others follow from code point 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> dict[str, int]:
    """Character of the vocabulary file to byte."""
    others = [b for b in range(256) if b not in set(_PRINTED)]
    return {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_characters()
        self.outline = json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}})
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in to_byte.items():
            self.byte_id[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        key, rank = left << 32 | right, np.arange(len(pairs))
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.lexsort((rank, key))
        order = order[np.append(True, np.diff(key[order]) != 0)] if len(order) else order
        self.pair, self.rank, self.merged = key[order], rank[order], merged[order]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of every pair in the table, -1 where it does not merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, at, -1)


def merge_words(vocabulary: Vocabulary, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids after all merges of words given as flat byte ids; and their number per word."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out, counts = [None] * len(sizes), np.zeros(len(sizes), np.int64)
    width = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
    for n in np.unique(width):
        own = np.flatnonzero(width == n)
        step = max(1, (1 << 20) // int(n))
        for k in range(0, len(own), step):
            some = own[k:k + step]
            ids, kept = _grow(vocabulary, symbols, offsets[some], sizes[some], int(n))
            counts[some] = kept
            borders = np.cumsum(kept)
            for w, a, b in zip(some.tolist(), (borders - kept).tolist(), borders.tolist()):
                out[w] = ids[a:b]
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts


def _grow(vocabulary, symbols, first, sizes, n):
    words = len(sizes)
    place = np.arange(n)
    filled = place < sizes[:, None]
    sym = np.where(filled, symbols[np.minimum(first[:, None] + place, len(symbols) - 1)], -1).astype(np.int64)
    after = np.broadcast_to(place + 1, (words, n)).copy()      # next symbol, n or more: none
    before = np.broadcast_to(place - 1, (words, n)).copy()
    after[~(after < sizes[:, None])] = n
    tree = np.full((words, 2 * n), NONE)

    def leaves(row, at):
        """Key of the pair that begins at ``at``: rank and position, or NONE."""
        right = after[row, at]
        there = right < n
        found = np.where(there, vocabulary.lookup(sym[row, at], sym[row, np.minimum(right, n - 1)]), -1)
        return np.where(found >= 0, vocabulary.rank[found] * n + at, NONE)

    row, at = np.nonzero(filled)
    tree[row, n + at] = leaves(row, at)
    level = n
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        at = tree[live, 1] % n
        gone = after[live, at]
        found = vocabulary.lookup(sym[live, at], sym[live, gone])
        sym[live, at] = vocabulary.merged[found]
        sym[live, gone] = -1
        follow = after[live, gone]
        after[live, at] = follow
        some = follow < n
        before[live[some], follow[some]] = at[some]
        left = before[live, at]
        has = left >= 0
        row = np.concatenate([live, live, live[has]])
        leaf = np.concatenate([at, gone, left[has]])
        tree[row, n + leaf] = np.concatenate([leaves(live, at), np.full(len(live), NONE), leaves(live[has], left[has])])
        node = (n + leaf) >> 1
        while node[0] >= 1:
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1
        live = live[tree[live, 1] < NONE]
    kept = sym >= 0
    return sym[kept].astype(np.int32), kept.sum(1)


class Codec:
    """Encode whole documents and decode ids, as the tokenizers library does with this file."""

    def __init__(self, path: str, cached: int = 600_000):
        from tokenizers import Tokenizer
        self.vocabulary = Vocabulary(path)
        # only for characters that the fast split leaves out; it needs no merges, which would take 40 MB of every worker
        self.splitter = Tokenizer.from_str(self.vocabulary.outline).pre_tokenizer
        self.encoder = BatchEncoder(self.words, self.text, tuple(self.vocabulary.special), cached)

    def words(self, words: list[str]):
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        return merge_words(self.vocabulary, self.vocabulary.byte_id[np.frombuffer(b"".join(raw), np.uint8)], sizes)

    def text(self, text: str) -> np.ndarray:
        parts, rest = [], text
        while rest:
            at, special = min(((i, s) for s in self.vocabulary.special if (i := rest.find(s)) >= 0),
                              default=(len(rest), None))
            if at:
                own = rest[:at]
                parts.append(self.words([own[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(own)])[0])
            if special is not None:
                parts.append(np.array([self.vocabulary.special[special]], np.int32))
            rest = rest[at + len(special or ""):]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def encode(self, data, offsets):
        return self.encoder.encode(data, offsets)

    def decode(self, ids) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


def round_trip(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
               cached: int = 600_000) -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` text of every row; whole texts, in one pass without a shuffle.

    A NULL or empty text has no ids and decodes to an empty text; a NULL id stays NULL; repeated rows are coded each for
    themselves. Other columns of ``documents`` are not read. ``path`` must be readable on the executors. A task keeps the ids of at most
    ``cached`` pretokens, some 300 bytes each.
    """
    def run(batches):
        codec = Codec(path, cached)
        for batch, data, offsets in pieces(batches):
            ids, borders = codec.encode(data, offsets)
            flat = ids.tolist()
            texts = [codec.decode(flat[a:b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32())),
                pa.array(texts, pa.string())], names=["id", "ids", "decoded"])
        del codec             # the vocabulary and the cache; they refer to each other
        give_back()

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, decoded string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)

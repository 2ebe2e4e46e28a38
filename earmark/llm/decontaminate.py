"""Benchmark decontamination by SimHash windows.

Each benchmark item has a 64-bit SimHash over its five-word shingles, weighted by how often they occur. Windows of a
document with as many words as an item get a fingerprint of the same kind. Items of one length stand in a multi-index of 8
blocks of 8 bits: a fingerprint within ``RADIUS`` differs by at most ``RADIUS // 8`` bits in some block, so looking up the
values that near in every block finds all of them. Candidates are verified by the exact weighted (multiset) Jaccard
similarity of their shingles.

A window without any shingle of an item has similarity 0 with it, so fingerprints are made only for windows that hold at
least one: this leaves out no window that could be verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from earmark.llm.text import BREAK, Words, pieces, text_buffers

SHINGLE = 5
#: At similarity 0.8 the angle makes 9.7 of 64 bits differ on average, 2.9 is the standard deviation.
RADIUS = 23
BLOCKS = 8
#: Text of benchmark items that is sent to every task at a time; more items are searched in further passes.
BLOCK_CHARS = 32 << 20


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 per bit, a row more than there are hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(2 * bits - 1, axis=0, dtype=np.int32)])


def fingerprints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from ``start`` to ``end``; a bit is set if its weights add up to more than 0."""
    bits = (sums[end] - sums[start]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


class HammingIndex:
    """All stored prints within ``RADIUS`` of a print."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = np.arange(256, dtype=np.uint8)
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        # table[block, value, item]: whether the item's block is so near that value
        self.table = np.stack([np.bitwise_count(values[:, None] ^ blocks[None, :, b]) <= RADIUS // BLOCKS
                               for b in range(BLOCKS)])

    def near(self, query: np.ndarray):
        """``(query, item, distance)`` of all pairs within the radius."""
        blocks = query.astype("<u8").view(np.uint8).reshape(-1, 8)
        some = self.table[0, blocks[:, 0]].copy()
        for b in range(1, BLOCKS):
            some |= self.table[b, blocks[:, b]]
        q, item = np.nonzero(some)
        distance = np.bitwise_count(query[q] ^ self.prints[item])
        keep = distance <= RADIUS
        return q[keep], item[keep], distance[keep].astype(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller by the sum of the larger number of occurrences."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = np.minimum(n[i], m[j]).sum()
    return float(common / (len(a) + len(b) - common))


class Benchmark:
    """Items as shingles, a filter over all their shingles, and an index of fingerprints per number of words."""

    def __init__(self, ids: list, texts: list):
        data, offsets = text_buffers(pa.array(texts, pa.string()))
        words = Words(data, offsets, BREAK)
        hashes, at = words.shingles(SHINGLE)
        borders = np.searchsorted(words.doc[at], np.arange(len(ids) + 1))
        self.ids, self.words = ids, words.count
        self.shingles = [hashes[a:b] for a, b in zip(borders[:-1], borders[1:])]
        owner = np.repeat(np.arange(len(ids)), np.diff(borders))
        order = np.argsort(hashes, kind="stable")
        self.known, self.length = hashes[order], self.words[owner[order]]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.groups = {}
        for size in np.unique(self.words[self.words > 0]).tolist():
            own = np.flatnonzero(self.words == size)
            prints = np.concatenate([fingerprints(bit_sums(self.shingles[i]), np.array([0]), np.array([len(self.shingles[i])]))
                                     for i in own.tolist()])
            self.groups[size] = own, HammingIndex(prints)

    def hits(self, hashes: np.ndarray):
        """``(place, words of the item)`` of every shingle that some item has, a row per distinct length."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        low, high = (np.searchsorted(self.known, hashes[maybe], side) for side in ("left", "right"))
        count = high - low
        place = np.repeat(maybe, count)
        until = np.cumsum(count)
        source = np.repeat(low - until + count, count) + np.arange(until[-1] if len(until) else 0)
        return np.unique(np.stack([place, self.length[source]], axis=1), axis=0) if len(place) else np.zeros((0, 2), np.int64)

    def search(self, data, offsets, percent: int):
        """``(row, item, first word, similarity, distance, first and last byte)``: the best window of each item per row."""
        words = Words(data, offsets, BREAK)
        hashes, at = words.shingles(SHINGLE)
        doc = words.doc[at]
        borders = np.searchsorted(doc, np.arange(len(offsets)))
        hits = self.hits(hashes)
        found = []
        if not len(hits):
            return found
        order = np.lexsort((hits[:, 0], hits[:, 1], doc[hits[:, 0]]))
        hits = hits[order]
        key = np.stack([doc[hits[:, 0]], hits[:, 1]], axis=1)
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        for first, last in zip(cut.tolist(), np.append(cut[1:], len(hits)).tolist()):
            row, size = key[first].tolist()
            own = hashes[borders[row]:borders[row + 1]]
            span = max(1, min(size, int(words.count[row])) - SHINGLE + 1)      # shingles of a window
            place = hits[first:last, 0] - borders[row]
            starts = np.zeros(len(own), bool)
            for p in place.tolist():
                starts[max(0, p - span + 1):p + 1] = True
            starts[len(own) - span + 1:] = False
            starts = np.flatnonzero(starts)
            if len(starts):
                found += self._verify(own, starts, span, size, percent, row, words)
        return found

    def _verify(self, own, starts, span, size, percent, row, words):
        low, high = int(starts[0]), int(starts[-1]) + span
        sums = bit_sums(own[low:high])
        items, index = self.groups[size]
        window, item, distance = index.near(fingerprints(sums, starts - low, starts - low + span))
        best = {}
        for w, i, d in zip(starts[window].tolist(), items[item].tolist(), distance.tolist()):
            similarity = weighted_jaccard(own[w:w + span], self.shingles[i])
            if similarity * 100 >= percent - 1e-9 and (i not in best or similarity > best[i][0]):
                best[i] = similarity, w, d
        base = int(words.first[row])
        out = []
        for i, (similarity, w, d) in sorted(best.items()):
            last = base + min(w + size, int(words.count[row])) - 1
            out.append((row, i, w, similarity, d, int(words.start[base + w]), int(words.end[last])))
        return out


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in blocks of bounded size. One block is on the driver and in the tasks at a time."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_CHARS))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = own.toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
        yield rows.column("id").to_pylist(), rows.column("text").to_pylist()


def contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id_col``, ``item_id``, ``start``, ``end`` (characters), ``first_word``, ``similarity``, ``distance`` of every item
    that a window of a row repeats: its best window, the first of equals.

    Words end at ASCII white space and punctuation; A-Z is lower-cased. A window has as many words as the item, or all of a
    shorter document. An item or document of fewer than five words is one shingle, so such an item is found only as a whole
    document. NULL or blank texts and items match nothing; ids may be NULL or repeat. ``documents`` is read once for each
    32 MB of items, without a shuffle.
    """
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType.simpleString()
    out = None
    for ids, texts in _item_blocks(benchmark, item_col, text_col):
        sent = documents.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches, sent=sent):
            items = Benchmark(*sent.value)
            for batch, data, offsets in pieces(batches):
                found = items.search(data, offsets, percent)
                if not found:
                    continue
                row, item, word, similarity, distance, a, b = map(np.array, zip(*found))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[offsets[:-1]][row]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in item.tolist()]),
                    pa.array(chars[a] - base), pa.array(chars[b] - base), pa.array(word.astype(np.int64)),
                    pa.array(similarity.astype(float)), pa.array(distance.astype(np.int32))],
                    names=["id", "item_id", "start", "end", "first_word", "similarity", "distance"])

        part = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, item_id {item_type}, start long, "
                                      "end long, first_word long, similarity double, distance int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def without_benchmark(documents: DataFrame, benchmark: DataFrame, percent: int = 80, text_col: str = "text",
                      item_col: str = "item_id") -> DataFrame:
    """Rows of ``documents`` in which no window repeats an item; all columns stay."""
    schema = documents.schema
    place = documents.columns.index(text_col)
    for ids, texts in _item_blocks(benchmark, item_col, text_col):
        sent = documents.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches, sent=sent):
            items = Benchmark(*sent.value)
            for batch, data, offsets in pieces(batches, batch_text):
                found = items.search(data, offsets, percent)
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in found]] = False
                yield batch.filter(pa.array(keep))

        batch_text = documents.columns[place]
        documents = documents.mapInArrow(run, schema)
    return documents

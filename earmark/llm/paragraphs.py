"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines, cut further at places that depend on the words alone: where the hash of two neighbouring words is the
smallest among ``REACH`` on both sides. A passage therefore falls into the same paragraphs wherever it is put, also in the
middle of a longer line. Successive lines of fewer than ``MIN_WORDS`` words (verse, lists, code) count as one line.

Such lines are compared whole as well, so that an edit inside a line does not hide its near copy: an edited piece shares few
shingles with the other, the lines share most. A matched line goes whole; of the others the matched pieces go. Bands are tuned for recall, members of a bucket are confirmed by the exact Jaccard similarity of
their word shingles, and components decide which occurrence stays: the first by document id and place.

A paragraph goes only as part of a run of at least ``min_run`` words that occur elsewhere, so that phrases and short
common lines do not break up clean documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.llm.buckets import link_classes
from earmark.llm.store import forget, settle
from earmark.llm.text import BREAK, Words, mix, pieces, span_hashes, window_shingles

REACH = 6
MIN_WORDS = 8         # shorter paragraphs go only between two that go
MIN_RUN = 16
SHINGLE = 5
PERCENT = 80
BANDS, RECALL = 10, .994   # ten bands of four rows: at similarity .3 a pair shares a bucket in 8 % of cases, at .2 in 2 %
PIECE, BLOCK = 1, 2   # levels of a paragraph
FEW = 16              # members of a bucket up to which all its pairs meet
LANES = 32            # minima with two bits each in a long
KEY_BITS = 43         # of a band's key: with a billion paragraphs some 60 000 pairs more share a bucket, and are told apart later


def tune_bands(similarity: float, recall: float, most: int = 5) -> tuple[int, int]:
    """``(bands, rows)`` with the most rows, hence the most selective buckets, that reach the recall at this similarity with
    at most ``most`` bands."""
    for rows in range(8, 0, -1):
        for bands in range(1, most + 1):
            if 1 - (1 - similarity ** rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding reaches this recall")


def paragraph_starts(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every paragraph, and of every block: a line, or successive lines of fewer than MIN_WORDS words."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = mix(words.hash * np.uint64(3) + np.append(words.hash[1:], np.uint64(0)))
    low = np.ones(n, bool)
    for k in range(1, REACH + 1):
        same = words.doc[k:] == words.doc[:-k]
        low[k:] &= ~same | (pair[k:] < pair[:-k])
        low[:-k] &= ~same | (pair[:-k] <= pair[k:])
    breaks = np.concatenate([[0], np.cumsum(data == 10)])[words.start]
    line = np.flatnonzero(np.append(True, (breaks[1:] != breaks[:-1]) | (words.doc[1:] != words.doc[:-1])))
    short = np.diff(np.append(line, n)) < MIN_WORDS
    joined = np.append(False, short[1:] & short[:-1] & (words.doc[line[1:]] == words.doc[line[:-1]]))
    block = line[~joined]
    size = np.diff(np.append(block, n))
    # a cut near a border of its block would leave a stump, and would depend on words outside
    place = np.arange(n) - np.repeat(block, size)
    low &= (place >= MIN_WORDS) & (np.repeat(size, size) - place >= MIN_WORDS)
    low[block] = True
    return np.flatnonzero(low), block


def _cut(data, offsets):
    """Words and long paragraphs: first word, word after the last, hash of the words, first word of the block, level.

    Blocks that are cut follow after the pieces. The level is PIECE, BLOCK, or both for a block of one piece.
    """
    words = Words(data, offsets, BREAK)
    n = len(words.hash)
    first, block = paragraph_starts(words, data)
    end, stop = np.append(first[1:], n), np.append(block[1:], n)
    own = np.searchsorted(block, first, "right") - 1
    cuts = np.bincount(own, minlength=len(block))
    level = np.where(cuts[own] > 1, PIECE, PIECE | BLOCK)
    several = cuts > 1
    first, end = np.concatenate([first, block[several]]), np.concatenate([end, stop[several]])
    within = np.concatenate([block[own], block[several]])
    level = np.concatenate([level, np.full(several.sum(), BLOCK)])
    keep = end - first >= MIN_WORDS
    first, end, within, level = first[keep], end[keep], within[keep], level[keep]
    return words, first, end, span_hashes(words.hash, first, end), within, level


def _shingles(words, first, end):
    """Hash of the shingle at each word, and of every paragraph its first shingle and the one after its last."""
    hashes, at = words.shingles(SHINGLE)
    out = np.zeros(len(words.hash), np.uint64)
    out[at] = hashes
    return out, first, end - SHINGLE + 1


def _least_equal(minima: int, similarity: float) -> int:
    """Equal two-bit lanes of ``minima`` that a pair of this similarity has but for 4.5 standard deviations."""
    share = similarity + (1 - similarity) / 4
    return int(minima * share - 4.5 * (minima * share * (1 - share)) ** .5)


def _equal_lanes(minima: int, p, q):
    """How many two-bit lanes of the packed longs of two sides are equal."""
    odd = F.lit(int("01" * LANES, 2))
    apart = [p(c).bitwiseXOR(q(c)) for c in _packed(minima)]
    differ = [F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)) for x in apart]
    return F.lit(minima) - sum(differ[1:], differ[0])


def _packed(minima: int) -> list[str]:
    return [f"s{i}" for i in range(-(-minima // LANES))]


def _fields(bands: int, rows: int) -> dict[str, int]:
    """Bits of what the words ``w0``, ``w1`` ... of a paragraph hold, one field after another."""
    minima = bands * rows
    lanes = {s: 2 * min(LANES, minima - i * LANES) for i, s in enumerate(_packed(minima))}
    return lanes | {f"b{b}": KEY_BITS for b in range(bands)}


def _pack(values: dict[str, np.ndarray], fields: dict[str, int]) -> list[np.ndarray]:
    """Words of 64 bits that hold the low bits of all fields without gaps."""
    n = len(next(iter(values.values())))
    words, at = [np.zeros(n, np.uint64) for _ in range(-(-sum(fields.values()) // 64))], 0
    for name, bits in fields.items():
        value = values[name] & np.uint64((1 << bits) - 1)
        i, shift = divmod(at, 64)
        words[i] |= value << np.uint64(shift)
        if shift + bits > 64:
            words[i + 1] |= value >> np.uint64(64 - shift)
        at += bits
    return words


def _unpack(fields: dict[str, int]) -> list:
    """Columns of all fields from the words; keys of different bands differ."""
    out, at = [], 0
    for name, bits in fields.items():
        i, shift = divmod(at, 64)
        value = F.shiftrightunsigned(f"w{i}", shift)
        if shift + bits > 64:
            value = value.bitwiseOR(F.shiftleft(f"w{i + 1}", 64 - shift))
        if bits < 64:
            value = value.bitwiseAND(F.lit((1 << bits) - 1))
        if name.startswith("b"):
            value = value.bitwiseOR(F.lit(int(name[1:]) << KEY_BITS))
        out.append(value.cast("bigint").alias(name))
        at += bits
    return out


def _classes(documents: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row per distinct paragraph text: ``rep`` (hash of its words), ``doc`` (smallest id), ``copies``, and words ``w0``,
    ``w1`` ... with a key for every band and low bits of all minima. The table is the largest of all, so it has no bit to spare."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    factor, shift = seeds[::2] | np.uint64(1), seeds[1::2]

    def run(batches):
        for batch, data, offsets in pieces(batches):
            words, first, end, key, _, _ = _cut(data, offsets)
            if not len(first):
                continue
            hashes, low, high = _shingles(words, first, end)
            # of every two borders the first begins a paragraph
            borders = np.column_stack([low, high]).ravel()
            columns = [batch.column(0).take(pa.array(words.doc[first])), pa.array(key.view(np.int64))]
            packed = {s: np.zeros(len(first), np.uint64) for s in _packed(bands * rows)}
            for b in range(bands):
                value = np.full(len(first), mix(np.array([b + 1], np.uint64))[0])
                for r in range(b * rows, (b + 1) * rows):
                    low = np.minimum.reduceat(hashes * factor[r] + shift[r], borders)[::2]
                    value = mix(value + low)
                    packed[f"s{r // LANES}"] |= (mix(low) & np.uint64(3)) << np.uint64(r % LANES * 2)
                packed[f"b{b}"] = value
            columns += [pa.array(w.view(np.int64)) for w in _pack(packed, fields)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "rep", *names])

    fields = _fields(bands, rows)
    names = [f"w{i}" for i in range(-(-sum(fields.values()) // 64))]
    found = documents.where("id is not null").select("id", "text").mapInArrow(
        run, "id long, rep long, " + ", ".join(f"{b} long" for b in names))
    # equal words have equal bands, so any of them will do
    return found.groupBy("rep").agg(F.min("id").alias("doc"), F.count(F.lit(1)).alias("copies"),
                                    *[F.min(b).alias(b) for b in names])


def _sets(documents: DataFrame) -> DataFrame:
    """``id`` (hash of the words) and ``set`` of the paragraphs of ``documents`` (``text``, ``wanted``) with a wanted hash."""
    def run(batches):
        for batch, data, offsets in pieces(batches):
            words, first, end, key, _, _ = _cut(data, offsets)
            chosen = np.isin(key.view(np.int64), batch.column(1).flatten().to_numpy())
            first, end, key = first[chosen], end[chosen], key[chosen]
            if len(first):
                hashes, low, high = _shingles(words, first, end)
                borders = np.concatenate([[0], np.cumsum(high - low)])
                own = hashes[np.arange(borders[-1]) + np.repeat(low - borders[:-1], high - low)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.ListArray.from_arrays(
                    pa.array(borders, pa.int32()), pa.array(own.view(np.int64)))], names=["id", "set"])

    return documents.select("text", "wanted").mapInArrow(run, "id long, set array<long>").withColumn("set", F.array_distinct("set"))


def _places(documents: DataFrame) -> DataFrame:
    """``id, copy, at, until, start, end, rep, block, level`` of every long paragraph: words and characters from and to, first
    word of its block."""
    def run(batches):
        for batch, data, offsets in pieces(batches):
            words, first, end, key, within, level = _cut(data, offsets)
            if not len(first):
                continue
            doc = words.doc[first]
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = chars[offsets[:-1]][doc]
            # up to the next word, so that punctuation and spaces go with the words before them
            follows = np.append(words.start, len(data))[end]
            stop = np.minimum(follows, offsets[1:][doc])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)),
                pa.array((first - words.first[doc]).astype(np.int32)), pa.array((end - words.first[doc]).astype(np.int32)),
                pa.array((chars[words.start[first]] - base).astype(np.int32)),
                pa.array((chars[stop] - base).astype(np.int32)), pa.array(key.view(np.int64)),
                pa.array((within - words.first[doc]).astype(np.int32)), pa.array(level.astype(np.int32))],
                names=["id", "copy", "at", "until", "start", "end", "rep", "block", "level"])

    rows = documents.where("id is not null").select("id", F.xxhash64("text").alias("copy"), "text")
    return rows.mapInArrow(run, "id long, copy long, at int, until int, start int, end int, rep long, block int, level int")


def _firsts(places: DataFrame) -> DataFrame:
    """The place of every component that stays."""
    return settle(places.groupBy("component").agg(F.min(F.struct("id", "copy", "at", "start")).alias("kept")))


def _later(places: DataFrame) -> DataFrame:
    """``component, id, copy, block, at, until, start, end, kept`` of paragraphs that go: whole blocks first, of others pieces.

    A piece is kept only where its block stays. A block that goes is told by its pieces with the places that keep these, as
    far as they are earlier, and by what is left between them with the place that keeps the block.
    """
    key, span = ["id", "copy", "block"], ["at", "until", "start", "end"]
    place = F.struct("id", "copy", "at", "start")
    blocks = places.where(F.col("level").bitwiseAND(BLOCK) != 0)
    firsts = _firsts(blocks)
    blocks = settle(blocks.join(firsts, "component").where(place != F.col("kept")))
    forget(firsts)
    parts = places.where(F.col("level").bitwiseAND(PIECE) != 0)
    marked = settle(parts.join(blocks.select(*key, F.lit(True).alias("gone")), key, "left"))
    firsts = _firsts(marked.where("gone is null"))
    parts = marked.join(firsts, "component").where(place > F.col("kept"))
    columns = ["component", *key, *span, "kept"]
    parts = settle(parts.select(*columns, "gone"))
    forget(marked)
    forget(firsts)

    found = parts.where("gone").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*span))).alias("parts"))
    rest = blocks.join(found, key, "left").withColumn(
        "parts", F.coalesce("parts", F.expr("cast(array() as array<struct<at:int,until:int,start:int,end:int>>)")))
    low = F.concat(F.array(F.struct("at", "start")), F.transform("parts", lambda x: F.struct(x["until"].alias("at"), x["end"].alias("start"))))
    high = F.concat(F.transform("parts", lambda x: F.struct(x["at"], x["start"])), F.array(F.struct(F.col("until").alias("at"), F.col("end").alias("start"))))
    gaps = F.zip_with(low, high, lambda x, y: F.struct(x["at"].alias("at"), y["at"].alias("until"), x["start"].alias("start"), y["start"].alias("end")))
    rest = rest.select("component", *key, "kept", F.explode(gaps).alias("gap")).where("gap.at < gap.until")
    return parts.select(*columns).unionByName(rest.select("component", *key, "gap.*", "kept"))


def repeated_paragraphs(documents: DataFrame, min_run: int = MIN_RUN, recall: float = RECALL, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Paragraphs to remove: ``id_col``, ``copy`` (hash of the row's text), ``start``, ``end`` (characters), ``n_words``,
    ``kept_id``, ``kept_start`` (where the component's first occurrence stays) and ``component``.

    Words end at ASCII white space and punctuation; A-Z is lower-cased. NULL ids, NULL, blank and very short texts have no
    paragraphs. Rows equal in id and text are one; rows that share only the id are told apart by ``copy``.
    """
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    bands, rows = tune_bands(PERCENT / 100, recall, BANDS)
    keys = settle(_classes(texts, bands, rows))
    classes = settle(keys.select("rep", "doc", "copies"))      # stays when the keys are deleted

    def sets_of(ids):
        # each set from one document, and no others
        wanted = classes.join(ids.withColumnRenamed("id", "rep"), "rep", "left_semi").select(F.col("doc").alias("id"), "rep")
        wanted = settle(wanted.groupBy("id").agg(F.collect_list("rep").alias("wanted")))
        return _sets(texts.join(wanted, "id")).dropDuplicates(["id"])

    least = _least_equal(bands * rows, PERCENT / 100)
    # a band at a time: there are many paragraphs
    found = link_classes(keys.select("rep", *_unpack(_fields(bands, rows))), sets_of, PERCENT, lambda p, q: _equal_lanes(bands * rows, p, q) >= least,
                         bands=[f"b{b}" for b in range(bands)], spare=True, few=FEW)
    repeated = classes.where("copies > 1").select(F.col("rep").alias("node")).join(found, "node", "full_outer").select(
        F.col("node").alias("rep"), F.coalesce("component", "node").alias("component"))
    repeated = settle(repeated)
    forget(classes)
    forget(found)
    places = settle(_places(texts).join(repeated, "rep").distinct())
    forget(repeated)

    others = _later(places)
    forget(places)
    # runs: neighbours with fewer than MIN_WORDS words between them
    row = W.partitionBy("id", "copy").orderBy("at")
    gap = F.col("at") - F.lag("until").over(row)
    others = others.withColumn("new", F.coalesce((gap >= MIN_WORDS).cast("int"), F.lit(1)))
    others = others.withColumn("run", F.sum("new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    words = F.col("until") - F.col("at")
    others = others.withColumn("run_words", F.sum(words).over(W.partitionBy("id", "copy", "run")))
    return others.where(F.col("run_words") >= min_run).select(
        F.col("id").alias(id_col), "copy", "start", "end", words.alias("n_words"), F.col("kept.id").alias("kept_id"),
        F.col("kept.start").alias("kept_start"), "component", "run")


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; spans with fewer than MIN_WORDS words between them are bridged by the caller."""
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        # a line that keeps its beginning keeps its end
        if "\n" in text[start:end][-2:] and start and text[start - 1] != "\n":
            parts.append("\n")
        at = max(at, end)
    return "".join(parts) + text[at:]


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` without their repeated paragraphs. Rows left without any word go; other rows and columns stay."""
    spans = repeated_paragraphs(documents, id_col=id_col, text_col=text_col, **options)
    runs = spans.groupBy(F.col(id_col).alias("_id"), F.col("copy").alias("_copy"), "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    runs = settle(runs.groupBy("_id", "_copy").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")))
    forget(spans)
    text = F.col(text_col)
    joined = documents.join(runs, (documents[id_col].cast("bigint") == runs._id) & (F.xxhash64(text) == runs._copy), "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        return pd.Series([None if x is None else remove_spans(t, [(s["start"], s["end"]) for s in x]) for t, x in zip(texts, spans)])

    # one pass for all rows, so that texts are shuffled once; those that stay as they are do not travel to Python
    changed = F.col("_spans").isNotNull()
    joined = joined.withColumn("_cut", cut(F.when(changed, text), F.col("_spans")))
    joined = joined.where(~changed | F.col("_cut").rlike(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"))
    return joined.withColumn(text_col, F.when(changed, F.col("_cut")).otherwise(text)).select(*documents.columns)

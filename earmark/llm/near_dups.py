"""Near duplicates by b-bit MinHash.

1. Each document gets ``PERMUTATIONS`` minima over its distinct word shingles. Bands of ``ROWS`` full minima give bucket
   keys; of every minimum the low ``BITS`` bits are kept, packed into longs.
2. Documents with equal shingle sets form one class at once, so groups of copies meet the rest as one row.
3. Classes that share a bucket are candidates. Their similarity is estimated from the matching lanes of the packed
   signatures, corrected for chance matches, and by set sizes; what may reach the threshold is confirmed on full sets.
4. Links become components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from earmark.llm.buckets import link_classes
from earmark.llm.store import forget, settle
from earmark.llm.text import Words, distinct_sets, mix, pieces

#: At similarity 0.8 a pair shares no bucket with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS, BITS = 32, 5, 2
PERMUTATIONS = BANDS * ROWS
LANES = 64 // BITS
#: 4.5 standard deviations of the estimate at similarity 0.8: a link fails here about as rarely as it shares no bucket.
MARGIN = 0.17
_SEED = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
FACTOR, SHIFT = _SEED[:PERMUTATIONS] | np.uint64(1), _SEED[PERMUTATIONS:]
_BAND_SALT = mix(np.arange(7, 7 + BANDS, dtype=np.uint64))


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Smallest hash of each set under every permutation; sets are not empty and begin at ``starts``."""
    out = np.empty((PERMUTATIONS, len(starts)), np.uint64)
    for k in range(PERMUTATIONS):
        out[k] = np.minimum.reduceat(values * FACTOR[k] + SHIFT[k], starts)
    return out.T


def pack_bits(minimum: np.ndarray) -> np.ndarray:
    """The low BITS bits of every minimum, LANES of them in a long."""
    low = minimum & np.uint64((1 << BITS) - 1)
    shifts = (np.arange(PERMUTATIONS) % LANES * BITS).astype(np.uint64)
    words = np.arange(0, PERMUTATIONS, LANES)
    return np.add.reduceat(low << shifts, words, axis=1)


def band_keys(minimum: np.ndarray) -> np.ndarray:
    keys = np.repeat(_BAND_SALT[None, :], len(minimum), 0)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + minimum[:, r::ROWS])
    return keys


def _lists(values: np.ndarray, rows: int, where: np.ndarray) -> pa.Array:
    """A list of longs per row; rows outside ``where`` get an empty one."""
    sizes = np.zeros(rows, np.int64)
    sizes[where] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                    pa.array(values.astype(np.uint64).view(np.int64).ravel()))


def signatures(documents: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, key1, key2`` (of the set), ``bands`` and ``packed`` per row; empty lists without words."""
    def run(batches):
        for batch, data, offsets in pieces(batches):
            rows = len(offsets) - 1
            words = Words(data, offsets)
            hashes, at = words.shingles(shingle)
            sets, borders = distinct_sets(hashes, words.doc[at], rows)
            n = np.diff(borders)
            some = np.flatnonzero(n)
            starts = borders[:-1][some]
            key1, key2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            if len(some):
                key1[some] = np.add.reduceat(mix(sets), starts)
                key2[some] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
                low = minima(sets, starts)
            else:
                low = np.zeros((0, PERMUTATIONS), np.uint64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)),
                _lists(band_keys(low), rows, some), _lists(pack_bits(low), rows, some)],
                names=["id", "n_shingles", "key1", "key2", "bands", "packed"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, key1 long, key2 long, bands array<long>, packed array<long>")


def shingle_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """``id, set`` (sorted distinct hashes) of ``id, text``."""
    def run(batches):
        for batch, data, offsets in pieces(batches):
            words = Words(data, offsets)
            hashes, at = words.shingles(shingle)
            sets, borders = distinct_sets(hashes, words.doc[at], len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(
                pa.array(borders, pa.int32()), pa.array(sets.view(np.int64)))], names=["id", "set"])

    return documents.select("id", "text").mapInArrow(run, "id long, set array<long>")


def estimate(x, y):
    """Similarity from two packed signatures: the share of equal lanes, corrected for chance."""
    lanes = int("01" * LANES, 2) if BITS == 2 else None
    differ = F.aggregate(
        F.zip_with(x, y, lambda p, q: F.bit_count(
            (p.bitwiseXOR(q)).bitwiseOR(F.shiftrightunsigned(p.bitwiseXOR(q), 1)).bitwiseAND(F.lit(lanes)))),
        F.lit(0), lambda total, d: total + d)
    chance = 1.0 / (1 << BITS)
    return (1.0 - differ / F.lit(float(PERMUTATIONS)) - chance) / (1.0 - chance)


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for every row.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``shingle``-word shingles; words end at
    ASCII white space and A-Z is lower-cased. Fewer words are one shingle. ``component_id`` is the smallest id that can be
    reached, ``kept`` whether it is the row's own. NULL or blank texts link with nothing. A NULL id belongs to no
    component (NULL, not kept). Rows that share an id are one node: all of them are kept or none.
    """
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = settle(signatures(texts, shingle, "id", "text"))
    known = rows.where("id is not null and n_shingles > 0")
    classes = settle(known.groupBy("key1", "key2", "n_shingles").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("packed").alias("packed")))
    members = settle(known.select("id", "key1", "key2", "n_shingles").join(
        classes.select("key1", "key2", "n_shingles", "rep"), ["key1", "key2", "n_shingles"]).select("id", "rep"))
    sizes = settle(rows.select("id", "n_shingles"))
    forget(rows)                                                # signatures stay in classes only
    near = percent / 100.0 - MARGIN

    def may_link(p, q):
        sizes = F.least(p("n"), q("n")) * 100 >= F.greatest(p("n"), q("n")) * percent
        return sizes & (estimate(p("packed"), q("packed")) >= near)

    # an id with several texts stands in several classes: they are one node
    several = members.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    same = members.join(several, "id").where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    found = link_classes(classes.withColumnRenamed("n_shingles", "n").select("rep", "bands", "n", "packed"),
                         lambda ids: shingle_sets(texts.join(ids, "id", "left_semi"), shingle), percent, may_link, same)
    forget(classes)

    named = members.join(found, members.rep == found.node, "left").select(
        "id", F.coalesce("component", "rep").alias("component"))
    named = settle(named.groupBy("id").agg(F.min("component").alias("component")))
    forget(members)
    forget(found)
    out = sizes.join(named, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


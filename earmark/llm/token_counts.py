"""Token counts of document sections by offset-mapped attribution.

A document is encoded once as a whole, so a count never depends on how it is cut. The character span of every token is
joined with the sections it touches. Sections tile the text: lines, each with its line break. A token that crosses a
border goes to the section with the larger part of its characters, the earlier one on a tie. Counts of all sections of a
document therefore add up to the count of the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from earmark.llm.bpe import Vocabulary
from earmark.llm.library import LibraryEncoder
from earmark.llm.text import pieces


def char_starts(data: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte, for every byte and the end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def attribute(token_start, token_end, border):
    """Section of every token; ``border`` holds the starts of all sections that tile the characters, and the end.

    A token joins every section that its span meets. It is kept in that with the largest overlap, the first of equals.
    """
    first = np.searchsorted(border, token_start, "right") - 1
    last = np.searchsorted(border, token_end, "left") - 1
    last = np.maximum(last, first)
    out = first.copy()
    crossing = np.flatnonzero(last > first)
    for t in crossing.tolist():
        some = np.arange(first[t], last[t] + 1)
        overlap = np.minimum(border[some + 1], token_end[t]) - np.maximum(border[some], token_start[t])
        out[t] = some[np.argmax(overlap)]
    return out, crossing


def section_counts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: ``id_col``, ``section`` (from 0), ``start`` and ``end`` (characters), ``n_tokens``,
    ``n_crossing`` (tokens that touch this section and another and are counted here) and ``doc_tokens``.

    A NULL or empty text is one empty section without tokens. Ids may be NULL or repeat; every row stands for itself.
    Other columns are not read.
    """
    def run(batches):
        encoder, vocabulary = LibraryEncoder(path), Vocabulary(path)
        length = np.fromiter(map(len, vocabulary.bytes), np.int64, len(vocabulary.bytes))
        for batch, data, offsets in pieces(batches, limit=2 << 20):
            ids, borders = encoder.encode(data, offsets)
            rows = len(offsets) - 1
            until = np.cumsum(length[ids])
            begin = until - length[ids]
            chars = char_starts(data)
            inside = np.zeros(len(data) + 1, bool)
            inside[:-1] = (data & 0xC0) == 0x80
            token_start, token_end = chars[begin] - inside[begin], chars[until]
            # sections begin at documents and after line breaks that do not end their document
            breaks = np.flatnonzero(data == 10) + 1
            breaks = breaks[~np.isin(breaks, offsets)]
            at = np.concatenate([offsets[:-1], breaks])
            doc = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
            order = np.lexsort((at, doc))
            at, doc = at[order], doc[order]
            # empty documents have no characters: they are left out of the join and get a count of 0
            filled = np.diff(offsets)[doc] > 0
            border = np.append(chars[at[filled]], chars[-1])
            section, crossing = attribute(token_start, token_end, border)
            counts, crossed = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            counts[filled] = np.bincount(section, minlength=len(border) - 1)
            crossed[filled] = np.bincount(section[crossing], minlength=len(border) - 1)
            first = np.searchsorted(doc, np.arange(rows))
            base = chars[offsets[:-1]]
            stop = np.append(chars[at[1:]], chars[-1])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(doc)), pa.array(np.arange(len(at)) - first[doc], pa.int32()),
                pa.array(chars[at] - base[doc]), pa.array(stop - base[doc]), pa.array(counts), pa.array(crossed),
                pa.array(np.diff(borders)[doc])],
                names=["id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (f"id {source.schema['id'].dataType.simpleString()}, section int, start long, end long, n_tokens long, "
              "n_crossing long, doc_tokens long")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)

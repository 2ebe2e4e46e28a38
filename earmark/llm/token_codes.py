"""Token-ID files with directly addressable codes.

An id is cut into chunks of 8 bits. Level k holds chunk k of every id that reaches it, and a bitmap that says which of
them go on to level k + 1. A rank directory over each bitmap gives the place on the next level, so any token is found
with a few bytes per level and nothing is decoded in blocks.

A file holds documents in ascending order of their ids::

    magic | header length (8 bytes) | header (JSON: counts and the place of each part) | parts
    parts: doc ids (int64), NULL flags of them (uint8), first token of each document (int64, one more at the end),
           per level: chunks (uint8), bitmap (uint64 words, low bit first), rank directory (uint64 per RANK_WORDS words)
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.llm.library import LibraryEncoder
from earmark.llm.store import file_tasks, files_dir, settle
from earmark.llm.text import pieces

MAGIC = b"EARDAC01"
RANK_WORDS = 8                 # 512 bits per rank entry
TOKENS_PER_FILE = 1 << 23


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(chunks, bitmap words, rank directory)`` per level."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(rest) // 64) + 1, np.uint64)   # a spare word, so that every rank has one to look at
        words.view(np.uint8)[:len(bits)] = bits
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)])
        levels.append(((rest & 0xFF).astype(np.uint8), words, ones[:-1:RANK_WORDS].astype(np.uint64)))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def pack(doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    nulls = np.fromiter((d is None for d in doc_ids), np.uint8, len(doc_ids))
    plain = np.fromiter((0 if d is None else d for d in doc_ids), np.int64, len(doc_ids))
    levels = encode_levels(ids)
    parts = [("docs", plain), ("nulls", nulls), ("starts", starts.astype(np.int64))]
    for k, (chunks, words, ranks) in enumerate(levels):
        parts += [(f"chunks{k}", chunks), (f"bitmap{k}", words), (f"ranks{k}", ranks)]
    place, at = {}, 0
    for name, values in parts:
        place[name] = [at, len(values), values.dtype.str]
        at += -(-values.nbytes // 8) * 8
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": len(levels), "parts": place}).encode()
    out = [MAGIC, len(header).to_bytes(8, "little"), header]
    for _, values in parts:
        raw = values.tobytes()
        out += [raw, b"\0" * (-len(raw) % 8)]
    return b"".join(out)


class CodeFile:
    """Reads a file through ``read_at(offset, length)``."""

    def __init__(self, read_at):
        self.read_at = read_at
        head = read_at(0, 16)
        if head[:8] != MAGIC:
            raise ValueError("not a token code file")
        size = int.from_bytes(head[8:], "little")
        self.header = json.loads(read_at(16, size))
        self.base = 16 + size

    def part(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        at, size, kind = self.header["parts"][name]
        count = size - first if count is None else count
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.read_at(self.base + at + first * width, count * width), kind)

    def token(self, i: int) -> int:
        """Token ``i`` from a chunk, a word of the bitmap and part of a rank entry's words on each level."""
        if not 0 <= i < self.header["tokens"]:
            raise IndexError(i)
        value = 0
        for k in range(self.header["levels"]):
            value |= int(self.part(f"chunks{k}", i, 1)[0]) << (8 * k)
            word, bit = divmod(i, 64)
            block = word // RANK_WORDS
            words = self.part(f"bitmap{k}", block * RANK_WORDS, word - block * RANK_WORDS + 1)
            if not (int(words[-1]) >> bit) & 1:
                break
            before = int(words[-1]) & ((1 << bit) - 1)
            i = int(self.part(f"ranks{k}", block, 1)[0]) + int(np.bitwise_count(words[:-1]).sum()) + before.bit_count()
        return value

    def all_tokens(self) -> np.ndarray:
        out = self.part("chunks0").astype(np.uint32)
        at = np.arange(len(out))
        for k in range(1, self.header["levels"]):
            bits = np.unpackbits(self.part(f"bitmap{k - 1}").view(np.uint8), bitorder="little")[:len(at)]
            at = at[bits.astype(bool)]
            out[at] |= self.part(f"chunks{k}").astype(np.uint32) << np.uint32(8 * k)
        return out


def open_shared(path: str):
    """``(file system, path)`` for a path in any store that pyarrow knows."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_codes(documents: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                folder: str | None = None) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and write code files in ascending ``id_col`` order, NULL first.

    Returns the manifest, a row per file: ``path``, ``part``, ``no``, ``n_docs``, ``n_tokens``, ``base`` (tokens in all
    files before it). Only files of the manifest count: a task that is run twice leaves files that none refers to.
    NULL texts count as empty; rows with equal ids are ordered by their texts' hashes.
    """
    spark = documents.sparkSession
    folder = folder or files_dir(spark, "codes")

    def run(batches):
        encoder = LibraryEncoder(path)
        part = TaskContext.get().partitionId()
        store, root = open_shared(folder)
        store.create_dir(root, recursive=True)
        docs, counts, held, n, no = [], [], [], 0, 0

        def flush():
            starts = np.concatenate([[0], np.cumsum(counts)])
            name = f"part-{part:06d}-{no:04d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(pack(docs, starts, np.concatenate(held)))
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "part": part, "no": no,
                                                "n_docs": len(docs), "n_tokens": int(starts[-1])}], schema=arrow)

        for batch, data, offsets in pieces(batches, limit=2 << 20):
            ids, borders = encoder.encode(data, offsets)
            ends = borders[1:]
            held.append(np.insert(ids, ends, end_id).astype(np.uint32))
            docs += batch.column(0).to_pylist()
            counts += (np.diff(borders) + 1).tolist()
            n += len(held[-1])
            if n >= TOKENS_PER_FILE:
                yield flush()
                docs, counts, held, n, no = [], [], [], 0, no + 1
        if docs:
            yield flush()

    arrow = pa.schema([("path", pa.string()), ("part", pa.int32()), ("no", pa.int32()), ("n_docs", pa.int64()),
                       ("n_tokens", pa.int64())])
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    manifest = settle(rows.mapInArrow(run, "path string, part int, no int, n_docs long, n_tokens long"))
    # a row per file of some million tokens, so one window over all of them stays small
    before = W.orderBy("part", "no").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_codes(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of code files: ``id_col``, ``start`` (tokens of all documents before), ``n_tokens``, ``ids`` (raw
    little-endian unsigned 32-bit). Files are spread over tasks and read one at a time."""
    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = open_shared(path)
                with store.open_input_file(name) as f:
                    code = CodeFile(lambda at, size: f.read_at(size, at))
                    ids, starts = code.all_tokens().astype("<u4"), code.part("starts")
                    docs = pa.array(code.part("docs"), mask=code.part("nulls").astype(bool))
                for a in range(0, len(docs), 512):
                    b = min(a + 512, len(docs))
                    texts = [ids[x:y].tobytes() for x, y in zip(starts[a:b].tolist(), starts[a + 1:b + 1].tolist())]
                    yield pa.RecordBatch.from_arrays([
                        docs[a:b], pa.array(starts[a:b] + base), pa.array(np.diff(starts[a:b + 1])),
                        pa.array(texts, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    files = manifest.select("path", "base").repartition(file_tasks(manifest))
    return files.mapInArrow(run, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)

"""Audio files: discovery from a folder tree, durations from WAV headers."""

from __future__ import annotations

import struct
from typing import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from earmark.functions.labels import strip_wav


def list_audio(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """``(audio_path, size)`` of all files below ``path``; file content is not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(path))
    return files.select(F.col("path").alias("audio_path"), F.col("length").alias("size"))


def discover_datasets(listing: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Clips of a tree ``.../<purpose>/<name>/<clip>.wav``, as ``(dataset, clip_id, audio_path)``.

    The dataset is ``purpose`` if the sub-folder has the same name, else ``purpose_name``. A dataset
    with labels ``(dataset, clip_id)`` takes its clip ids from there, the others from the listing.
    """
    parts = F.split("audio_path", "/")
    purpose, name = F.element_at(parts, -3), F.element_at(parts, -2)
    found = listing.select(
        F.when(purpose == name, purpose).otherwise(F.concat_ws("_", purpose, name)).alias("dataset"),
        strip_wav(F.element_at(parts, -1)).alias("clip_id"), "audio_path")
    if labels is None:
        return found
    wanted = labels.select("dataset", "clip_id").distinct()
    listed = wanted.join(found, ["dataset", "clip_id"], "left").select("dataset", "clip_id", "audio_path")
    rest = found.join(wanted.select("dataset").distinct(), "dataset", "left_anti").select("dataset", "clip_id", "audio_path")
    return listed.unionByName(rest)


def _wav_seconds(read_at, size: int) -> float:
    """Duration from the chunks of a RIFF or RF64 file, wherever they stand; 0 if it cannot be read."""
    try:
        head = read_at(0, 12)
        if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
            return 0.0
        at, rate, block, long_data = 12, 0, 0, None
        while at + 8 <= size:
            tag, length = struct.unpack("<4sI", read_at(at, 8))
            if tag == b"ds64":
                long_data = struct.unpack("<Q", read_at(at + 16, 8))[0]
            elif tag == b"fmt ":
                rate, _, block = struct.unpack("<IIH", read_at(at + 12, 10))
            elif tag == b"data":
                if length == 0xFFFFFFFF and long_data is not None:
                    length = long_data
                return (min(length, max(size - at - 8, 0)) // block) / rate
            at += 8 + length + length % 2
    except (struct.error, ZeroDivisionError, OSError):
        pass
    return 0.0


def _open(path: str):
    """An open file in any store that pyarrow knows, and its size."""
    store, name = (fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1)) if ":/" in path
                   else (fs.LocalFileSystem(), path))
    f = store.open_input_file(name)
    return f, f.size()


def probe_durations(files: DataFrame, path: str = "audio_path", content: str = "content", opener=_open) -> DataFrame:
    """``(audio_path, audio_length)`` from WAV headers; unreadable files get 0.

    ``files`` is a listing: each file is opened where the task runs, and only chunk headers are read. ``opener(path)`` gives
    ``(file, size)`` with ``read_at(n, offset)``, for stores that pyarrow does not know. A column ``content`` is read instead
    if there is one.
    """
    inside = content in files.columns
    rows = files.select(F.col(path).alias("audio_path"), *[F.col(content).alias("content")] * inside)

    def one(where, data):
        if data is not None:
            return _wav_seconds(lambda at, n: bytes(data[at:at + n]), len(data))
        try:
            f, size = opener(where)
        except OSError:
            return 0.0
        with f:
            return _wav_seconds(lambda at, n: f.read_at(n, at), size)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = pdf["content"] if inside else [None] * len(pdf)
            yield pd.DataFrame({"audio_path": pdf["audio_path"], "audio_length": [
                one(w, d if d is not None or not inside else b"") for w, d in zip(pdf["audio_path"], data)]})

    return rows.mapInPandas(probe, "audio_path string, audio_length double")


def read_audio(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """``(audio_path, content)`` for probing."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(path)
            .select(F.col("path").alias("audio_path"), "content"))

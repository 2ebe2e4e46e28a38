"""Waveform columns: normalisation, gain, superposition, framing, spectra, log-mel features.

Rows are independent; numpy works on one row's array inside Arrow batches, Spark spreads the rows.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def max_normalise(wave) -> Column:
    """Divide by the largest magnitude; an all-zero waveform stays as it is."""
    c = F.col(wave) if isinstance(wave, str) else wave
    peak = F.array_max(F.transform(c, lambda v: F.abs(v)))
    return F.when(peak > 0, F.transform(c, lambda v: v / peak)).otherwise(F.transform(c, lambda v: v / F.lit(1.0)))


def mono(channels) -> Column:
    """Mean over an array of equally long channels."""
    c = F.col(channels) if isinstance(channels, str) else channels
    n = F.size(c)
    zero = F.transform(F.get(c, F.lit(0)), lambda v: F.lit(0.0))
    total = F.aggregate(c, zero, lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b))
    return F.transform(total, lambda v: v / n)


def random_gain(*ids, seed: int = 0, limit: float = 3.0) -> Column:
    """``exp`` of a standard normal, clamped to ``[1/limit, limit]``; reproducible from the row's ids."""
    def uniform(salt):
        h = F.xxhash64(*[F.col(i) for i in ids], F.lit(seed), F.lit(salt))
        return (F.pmod(h, F.lit(2 ** 52)) + F.lit(0.5)) / F.lit(float(2 ** 52))

    normal = F.sqrt(F.lit(-2.0) * F.ln(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(2))
    bound = math.log(limit)
    return F.exp(F.greatest(F.lit(-bound), F.least(F.lit(bound), normal)))


def scale_wave(wave, gain) -> Column:
    g = F.col(gain) if isinstance(gain, str) else gain
    return F.transform(wave, lambda v: v * g)


# ---------------------------------------------------------------- superposition

def mix_start(length, other_length, u, min_overlap: float = 1.0, max_length: int | None = None) -> Column:
    """Start of the second clip relative to the first, uniform over the allowed range.

    ``u`` is a uniform number in [0, 1). At least ``min_overlap`` of the shorter clip overlaps; the
    mixture is at most ``max_length`` long.
    """
    n1, n2 = F.col(length), F.col(other_length)
    overlap = F.ceil(F.least(n1, n2) * F.lit(float(min_overlap)))
    first, last = overlap - n2, n1 - overlap
    if max_length is not None:
        first = F.greatest(first, n1 - F.lit(max_length))
        last = F.least(last, F.lit(max_length) - n2)
    return F.floor(first + u * (last - first + 1)).cast("int")


def superpose(pairs: DataFrame, min_overlap: float = 1.0, max_length: int | None = None, fade_length: int = 0,
              seed: int = 0) -> DataFrame:
    """Mix ``wave`` with ``mix_wave`` at a random start; events keep their class with shifted samples.

    Input: ``clip_id, dataset, wave, events, unlabeled`` and the same with prefix ``mix_``; events are
    ``array<struct<label, label_type, start, stop>>`` in samples. Starts come from a hash of the ids.
    """
    h = F.xxhash64("clip_id", "mix_clip_id", F.lit(seed))
    u = F.pmod(h, F.lit(2 ** 52)) / F.lit(float(2 ** 52))
    rows = pairs.withColumns({"_n1": F.size("wave"), "_n2": F.size("mix_wave")})
    if max_length is not None:
        too_long = F.greatest("_n1", "_n2") > max_length
        rows = rows.withColumn("_n1", F.when(too_long, F.raise_error(F.lit("clip exceeds max_length")).cast("int")).otherwise(F.col("_n1")))
    rows = rows.withColumn("_s", mix_start("_n1", "_n2", u, min_overlap, max_length))
    rows = rows.withColumns({"start": F.greatest(-F.col("_s"), F.lit(0)), "mix_start": F.greatest(F.col("_s"), F.lit(0))})
    rows = rows.withColumn("seq_len", F.greatest(F.col("start") + F.col("_n1"), F.col("mix_start") + F.col("_n2")))

    # fade a clip in where it starts inside the mixture, and out where it ends inside
    def placed(wave, n, start):
        x = F.col(wave)
        if fade_length > 0:
            ok = F.col(n) > 2 * fade_length
            fade = F.lit(float(fade_length + 1))

            def cosine(k):  # k = 1 .. fade_length counted from the outer edge
                return F.lit(0.5) - F.cos(F.lit(math.pi) * k / fade) / 2

            x = F.transform(x, lambda v, i: (
                v * F.when((F.col(start) > 0) & (i < fade_length), cosine(i + 1)).otherwise(F.lit(1.0))
                * F.when((F.col(start) + F.col(n) < F.col("seq_len")) & (i >= F.col(n) - fade_length),
                         cosine(F.col(n) - i)).otherwise(F.lit(1.0))))
            x = F.when(ok, x).otherwise(F.raise_error(F.lit("clip shorter than two fades")).cast("array<double>"))
        left = F.array_repeat(F.lit(0.0), F.col(start))
        right = F.array_repeat(F.lit(0.0), F.col("seq_len") - F.col(start) - F.col(n))
        return F.concat(left, x.cast("array<double>"), right)

    rows = rows.withColumn("_mixed", F.zip_with(
        placed("wave", "_n1", "start"), placed("mix_wave", "_n2", "mix_start"), lambda a, b: a + b))
    return rows.select(
        F.concat_ws("+", "clip_id", "mix_clip_id").alias("clip_id"),
        F.array_join(F.array_sort(F.array_distinct(F.array("dataset", "mix_dataset"))), "+").alias("dataset"),
        F.col("_mixed").alias("wave"), "seq_len", "start", "mix_start",
        union_events("events", "start", "mix_events", "mix_start").alias("events"),
        (F.col("unlabeled") | F.col("mix_unlabeled")).alias("unlabeled"))


def union_events(events, shift, other, other_shift) -> Column:
    """Events of two mixed clips with their sample times shifted."""
    def moved(col, by):
        return F.transform(col, lambda e: F.struct(
            e.label.alias("label"), e.label_type.alias("label_type"),
            (e.start + F.col(by)).alias("start"), (e.stop + F.col(by)).alias("stop")))
    return F.concat(moved(events, shift), moved(other, other_shift))


# ---------------------------------------------------------------- spectra

def mel_filterbank(n_mels: int, n_fft: int, rate: int, f_min: float = 0.0, f_max: float | None = None) -> np.ndarray:
    """Triangular filters, evenly spaced on ``2595 log10(1 + f/700)``; shape (bins, n_mels)."""
    mel = lambda f: 2595.0 * np.log10(1.0 + np.asarray(f) / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(f_min), mel(f_max or rate / 2), n_mels + 2) / 2595.0) - 1.0)
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0.0, None)


def _frames(x: np.ndarray, shift: int, window: int) -> np.ndarray:
    pad = (window - shift) // 2
    n = max(1, -(-len(x) // shift))
    x = np.pad(x, (pad, max(0, (n - 1) * shift + window - pad - len(x))))
    return np.lib.stride_tricks.sliding_window_view(x, window)[::shift][:n]


def spectrum_frames(clips: DataFrame, wave: str = "wave", shift: int = 320, window: int = 960, size: int = 1024,
                    n_mels: int | None = None, rate: int = 16000, keys=("clip_id",),
                    number: str = "float") -> DataFrame:
    """Long frame features ``(keys, frame, features)``: power spectrum, or log-mel with ``n_mels`` bands.

    Frame t is centred on samples ``t * shift .. (t + 1) * shift``, ``ceil(samples / shift)`` frames.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in clips.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", frame bigint, features array<{number}>"

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taper = np.hanning(window + 1)[:window]
        bank = None if n_mels is None else mel_filterbank(n_mels, size, rate)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                row = row._asdict()
                x = np.asarray(row[wave], dtype="float64")
                views = _frames(x, shift, window)
                for first in range(0, len(views), 4096):  # bounded output batches for long clips
                    part = views[first:first + 4096] * taper
                    power = np.abs(np.fft.rfft(part, size, axis=-1)) ** 2
                    if bank is not None:
                        power = np.log(np.maximum(power @ bank, 1e-10))
                    yield pd.DataFrame({**{k: row[k] for k in keys},
                                        "frame": np.arange(first, first + len(part)),
                                        "features": list(power.astype("float32" if number == "float" else "float64"))})

    return clips.select(*keys, wave).mapInPandas(compute, schema)

"""User scoring functions, ensembles and score combination."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.scale import CHUNK, chunk_of, own_rows, with_halo


def score_with(clips: DataFrame, models: dict, schema: str) -> DataFrame:
    """Run user scoring functions over Arrow batches; one ``run`` per model.

    Each model is ``f(iterator of pandas frames) -> iterator of pandas frames`` with ``schema``.
    Keyword arguments can be bound with ``functools.partial``. Target columns are dropped first.
    """
    inputs = drop_targets(clips)
    out = None
    for run, fn in models.items():
        part = inputs.mapInPandas(fn, schema).withColumn("run", F.lit(run))
        out = part if out is None else out.unionByName(part)
    return out


def drop_targets(rows: DataFrame) -> DataFrame:
    """Targets never reach a scoring function."""
    return rows.drop("weak_targets", "boundary_targets", "strong_targets")


def ensemble_mean(scores: DataFrame, n_models: int, keys=("clip_id", "frame", "label"),
                  value: str = "score") -> DataFrame:
    """Mean over models per frame and class; a frame that a model lacks raises."""
    mean = scores.groupBy(*keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") != n_models, F.raise_error(F.lit("models differ in frames")).cast("double"))
    return mean.withColumn(value, checked.otherwise(F.col(value))).drop("_n")


def post_process(scores: DataFrame, fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return scores if fn is None else scores.transform(fn)


def combine_tags(frames: DataFrame, keys=("clip_id", "label")) -> DataFrame:
    """Clip score: mean of the last forward and the first backward score (or the last forward alone)."""
    last = F.max_by("fwd", "frame")
    if "bwd" not in frames.columns:
        return frames.groupBy(*keys).agg(last.alias("score"))
    return frames.groupBy(*keys).agg(((last + F.min_by("bwd", "frame")) / 2).alias("score"))


def combine_frames(frames: DataFrame, how: str = "min") -> DataFrame:
    """Frame score: ``min`` of both directions (boundaries) or ``max`` (weak)."""
    fn = {"min": F.least, "max": F.greatest}[how]
    return frames.withColumn("score", fn("fwd", "bwd"))


def window_features(frames: DataFrame, window_length: int, window_shift: int = 1, feature: str = "features",
                    series=("clip_id",), chunk: int = CHUNK) -> DataFrame:
    """The window around every ``window_shift``-th frame, as ``window`` (array of per-frame values).

    ``1 + (T - 1) // shift`` windows per series; ``(length - shift) // 2`` frames come before the frame.
    Frames outside the series are absent: ``pad_left`` counts those before, the rest is after.
    """
    before = max((window_length - window_shift) // 2, 0)
    after = max(window_length - 1 - before, 0)
    rows = with_halo(frames.select(*series, "frame", feature), before, after, chunk)
    w = W.partitionBy(*series, "_chunk").orderBy("frame").rowsBetween(-before, after)
    rows = rows.withColumn("window", F.collect_list(feature).over(w))
    rows = own_rows(rows, chunk).where(F.col("frame") % window_shift == 0)
    pad = F.greatest(F.lit(before) - F.col("frame"), F.lit(0)).cast("int")
    return rows.select(*series, (F.col("frame") / window_shift).cast("bigint").alias("frame"), "window",
                       pad.alias("pad_left"))


def sliding_scores(frames: DataFrame, score: Callable, window_lengths, window_shift: int = 1,
                   feature: str = "features", series=("clip_id", "label"), chunk: int = CHUNK) -> DataFrame:
    """Score the window around each ``window_shift``-th frame.

    ``score(window, pad_left, length)`` returns a Column. ``window_lengths`` is one length or
    ``{label: length}``; each distinct length is one pass over the classes that use it.
    """
    if not isinstance(window_lengths, dict):
        passes = [(window_lengths, frames)]
    else:
        by_length = {}
        for label, n in window_lengths.items():
            by_length.setdefault(n, []).append(label)
        passes = [(n, frames.where(F.col("label").isin(sorted(labels)))) for n, labels in sorted(by_length.items())]
    out = None
    for n, rows in passes:
        win = window_features(rows, n, window_shift, feature, series, chunk)
        part = win.select(*series, "frame", score(F.col("window"), F.col("pad_left"), n).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out

"""Grid search: all candidates of a grid as rows, one leaderboard entry per metric and class."""

from __future__ import annotations

from itertools import product
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from earmark.operators import collar, curves, intersection
from earmark.operators.detect import mask_by_tags
from earmark.operators.filters import filter_series
from earmark.scale import CHUNK, cut_lineage

PARAMS = ("medfilt_length", "stepfilt_length", "window_length", "window_shift", "tag_masked")


def candidate_grid(medfilt_lengths, stepfilt_lengths=(0,), tag_masked=(False,), window_length=None,
                   window_shift=None, first_id: int = 0) -> list[dict]:
    """Candidates in search order; a later candidate wins a tie."""
    return [dict(candidate_id=first_id + i, medfilt_length=m, stepfilt_length=s, tag_masked=t,
                 window_length=window_length, window_shift=window_shift)
            for i, (m, s, t) in enumerate(product(medfilt_lengths, stepfilt_lengths, tag_masked))]


def _literal(candidate: dict, score):
    return F.struct(
        F.lit(candidate["candidate_id"]).cast("int").alias("candidate_id"),
        *[F.lit(candidate[k]).cast("boolean" if k == "tag_masked" else "int").alias(k) for k in PARAMS],
        score.alias("score"))


def apply_candidates(scores: DataFrame, grid: list[dict], tags: DataFrame | None = None,
                     boundary: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Scores of every candidate as rows ``(candidate_id, params..., clip_id, frame, label, ..., score)``.

    Each distinct filter length is computed once, all in one pass over the series; the grid is unfolded
    inside each row, without a join.
    """
    medians = sorted({c["medfilt_length"] for c in grid})
    rows = filter_series(scores, {f"_m{n}": ("median", n) for n in medians}, chunk=chunk)
    column = {(n, s): f"_m{n}" for n in medians for s in (0,)}
    if boundary:
        for n in medians:
            steps = sorted({c["stepfilt_length"] for c in grid if c["medfilt_length"] == n})
            rows = filter_series(rows, {f"_m{n}_s{s}": ("boundary", s) for s in steps}, value=f"_m{n}", chunk=chunk)
            column.update({(n, s): f"_m{n}_s{s}" for s in steps})
    keep = [c for c in scores.columns if c != "score"]
    fan = F.explode(F.array(*[
        _literal(c, F.col(column[(c["medfilt_length"], c["stepfilt_length"] if boundary else 0)])) for c in grid]))
    rows = rows.select(*keep, fan.alias("_c")).select(*keep, "_c.*")
    if any(c["tag_masked"] for c in grid):
        rows = mask_by_tags(rows, tags, F.col("tag_masked"))
    return rows


def candidate_params(grid: list[dict], spark) -> DataFrame:
    schema = "candidate_id int, medfilt_length int, stepfilt_length int, window_length int, window_shift int, tag_masked boolean"
    return spark.createDataFrame([tuple(c[k] for k in (
        "candidate_id", "medfilt_length", "stepfilt_length", "window_length", "window_shift", "tag_masked")) for c in grid], schema)


def leaderboard(results: DataFrame, minimize: bool | list | dict = False) -> DataFrame:
    """Best candidate per metric and class; ties go to the later candidate, and no value or NaN never beats a number.

    ``results (metric, label, value, candidate_id, ...)``. Merging leaderboards is the same call on
    their union.
    """
    if isinstance(minimize, dict):
        minimize = [m for m, on in minimize.items() if on]
    if isinstance(minimize, (list, tuple)):
        sign = F.when(F.col("metric").isin(list(minimize)), F.lit(-1.0)).otherwise(F.lit(1.0)) if minimize else F.lit(1.0)
    else:
        sign = F.lit(-1.0 if minimize else 1.0)
    rest = [c for c in results.columns if c not in ("metric", "label")]
    best = F.max_by(F.struct(*rest), F.struct(F.when(~F.isnan("value"), F.col("value") * sign).alias("v"), "candidate_id"))
    return results.groupBy("metric", "label").agg(best.alias("b")).select("metric", "label", "b.*")


def macro_average(board: DataFrame) -> DataFrame:
    """The board plus one ``macro_average`` row per metric."""
    macro = board.groupBy("metric").agg(F.avg("value").alias("value")).withColumn("label", F.lit("macro_average"))
    return board.unionByName(macro, allowMissingColumns=True)


def winning_scores(candidates: DataFrame, board: DataFrame) -> DataFrame:
    """Score series of the best candidate of each metric and class."""
    return candidates.join(board.select("metric", "label", "candidate_id"), ["candidate_id", "label"])


# ---------------------------------------------------------------- metrics for the search

def f_tag(ground_truth: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Clip-based best F per candidate and class; ``ground_truth (clip_id, label)``."""
    def metric(candidates: DataFrame) -> DataFrame:
        clip = candidates.groupBy("candidate_id", "clip_id", "label").agg(F.max("score").alias("score"))
        truth = ground_truth.select("clip_id", "label", F.lit(1.0).alias("_t")).distinct()
        clip = clip.join(truth, ["clip_id", "label"], "left").withColumn("target", F.coalesce("_t", F.lit(0.0)))
        keys = ["candidate_id", "label"]
        best = curves.best_fscore(curves.fscore_curve(clip, keys), keys)
        return best.select(*keys, F.col("fscore").alias("value"), "threshold")
    return metric


def f_collar(ground_truth: DataFrame, thresholds, return_onset_offset_bias: bool = False, **params):
    """Collar-based best F per candidate and class over a threshold grid."""
    def metric(candidates: DataFrame) -> DataFrame:
        best = collar.collar_best_fscore(candidates, ground_truth, thresholds, keys=["candidate_id"], **params)
        extra = ["onset_bias", "offset_bias"] if return_onset_offset_bias else []
        return best.select("candidate_id", "label", F.col("fscore").alias("value"), "threshold", *extra)
    return metric


def psd_auc(ground_truth: DataFrame, seconds: DataFrame, thresholds=None, **params):
    """Area under the PSD-ROC per candidate and class."""
    def metric(candidates: DataFrame) -> DataFrame:
        _, auc = intersection.approximate_psds(candidates, ground_truth, seconds, thresholds=thresholds,
                                               keys=["candidate_id"], **params)
        return auc.select("candidate_id", "label", F.col("auc").alias("value"))
    return metric


def tune(scores: DataFrame, grid: list[dict], metrics: dict, tags: DataFrame | None = None,
         tag_masking=None, minimize=False, boundary: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Search ``grid`` for every metric: leaderboard with the parameters of each winner.

    ``metrics`` maps a name to ``f(candidate scores) -> (candidate_id, label, value, ...)``.
    ``tag_masking`` maps a metric to True, False or ``'?'`` (both); the default tries what the grid has.
    """
    rows = apply_candidates(scores, grid, tags, boundary, chunk)
    out = None
    for name, fn in metrics.items():
        wanted = (tag_masking or {}).get(name, "?")
        mine = rows if wanted == "?" else rows.where(F.col("tag_masked") == F.lit(bool(wanted)))
        part = fn(mine).withColumn("metric", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    out = out.join(candidate_params(grid, scores.sparkSession), "candidate_id")
    return cut_lineage(leaderboard(out, minimize))  # one row per metric and class

"""Clip-based and collar-based precision, recall and F-score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earmark.operators import curves, matching
from earmark.operators.detect import score_intervals
from earmark.scale import cut_lineage


def prf_table(table: DataFrame, keys=(), beta: float = 1.0) -> DataFrame:
    """Per-class rows plus ``macro_average`` and ``micro_average`` from ``tp, n_sys, n_ref``."""
    keys = list(keys)
    b2 = beta ** 2

    def scored(df):
        p = F.col("tp") / F.greatest(F.col("n_sys"), F.lit(1.0))
        r = F.col("tp") / F.greatest(F.col("n_ref"), F.lit(1.0))
        f = F.lit(1 + b2) * p * r / F.greatest(F.lit(b2) * p + r, F.lit(1e-15))
        return df.withColumns({"fscore": f, "precision": p, "recall": r})

    rows = scored(table.select(*keys, "label", *[F.col(c).cast("double").alias(c) for c in ("tp", "n_sys", "n_ref")]))
    sums = [F.sum(c).alias(c) for c in ("tp", "n_sys", "n_ref")]
    macro = rows.groupBy(*keys).agg(*sums, *[F.avg(c).alias(c) for c in ("fscore", "precision", "recall")])
    micro = scored(rows.groupBy(*keys).agg(*sums))
    return (rows.unionByName(macro.withColumn("label", F.lit("macro_average")))
            .unionByName(micro.withColumn("label", F.lit("micro_average"))))


def clip_based_counts(tags: DataFrame, target: str = "target", keys=()) -> DataFrame:
    """``tp, n_sys, n_ref`` per class from ``(clip_id, label, tag, target)``."""
    t, d = F.col(target).cast("double"), F.col("tag").cast("double")
    return tags.groupBy(*keys, "label").agg(F.sum(t * d).alias("tp"), F.sum(d).alias("n_sys"), F.sum(t).alias("n_ref"))


def clip_based_best_fscore(clip_scores: DataFrame, keys=(), **kw) -> DataFrame:
    """Best F-score and threshold per class from ``(clip_id, label, score, target)``."""
    keys = [*keys, "label"]
    return curves.best_fscore(curves.fscore_curve(clip_scores, keys, **kw), keys)


def collar_counts(detections: DataFrame, ground_truth: DataFrame, onset_collar: float = 0.2,
                  offset_collar: float = 0.2, offset_collar_rate: float = 0.2, keys=(),
                  det_id=("clip_id", "label", "det_onset", "det_offset"), gt_id=("clip_id", "label", "gt_id"),
                  grid: DataFrame | None = None) -> DataFrame:
    """``tp, n_sys, n_ref`` and signed distance sums per ``keys`` and class.

    ``keys`` are extra columns of the detections (threshold, candidate). ``grid`` lists the
    ``(keys, label)`` rows to report, also those without a detection; the default is what occurs.
    """
    keys = list(keys)
    pairs = matching.collar_pairs(detections, ground_truth, onset_collar, offset_collar, offset_collar_rate)
    matched = matching.one_to_one(pairs, [*keys, *det_id], [*keys, *gt_id], [*keys, "clip_id", "label"])
    tp = matched.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("tp"), F.sum("onset_dist").alias("onset_dist_sum"),
        F.sum("offset_dist").alias("offset_dist_sum"))
    n_sys = detections.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_sys"))
    n_ref = ground_truth.groupBy("label").agg(F.count(F.lit(1)).alias("n_ref"))
    if grid is None:
        grid = n_sys.select(*keys, "label") if keys else n_sys.select("label").union(n_ref.select("label")).distinct()
    rows = (grid.join(n_sys, [*keys, "label"], "left").join(n_ref, "label", "left").join(tp, [*keys, "label"], "left"))
    # one row per keys and class, read by every average
    return cut_lineage(rows.na.fill(0, ["tp", "n_sys", "n_ref"]).na.fill(0.0, ["onset_dist_sum", "offset_dist_sum"]))


def with_biases(table: DataFrame) -> DataFrame:
    """Mean signed distance of onsets and offsets over the matches."""
    n = F.greatest(F.col("tp"), F.lit(1))
    return table.withColumns({"onset_bias": F.col("onset_dist_sum") / n, "offset_bias": F.col("offset_dist_sum") / n})


def threshold_grid(labels: DataFrame, thresholds) -> DataFrame:
    return labels.select("label").distinct().withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def collar_best_fscore(scores: DataFrame, ground_truth: DataFrame, thresholds, onset_collar: float = 0.2,
                       offset_collar: float = 0.2, offset_collar_rate: float = 0.2, min_precision: float = 0.0,
                       min_recall: float = 0.0, keys=(), gt_id=("clip_id", "label", "gt_id")) -> DataFrame:
    """Best collar-based F-score per class over a threshold grid, with the biases at that threshold.

    ``keys`` are extra columns of ``scores`` (e.g. ``candidate_id``).
    """
    keys = list(keys)
    det = cut_lineage(score_intervals(scores, list(thresholds), series=[*keys, "clip_id", "label"]))
    labels = scores.select(*keys, "label").distinct()
    grid = labels.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    table = with_biases(collar_counts(det, ground_truth, onset_collar, offset_collar, offset_collar_rate,
                                      [*keys, "threshold"], gt_id=gt_id, grid=grid))
    p = F.col("tp") / F.greatest(F.col("n_sys"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("n_ref"), F.lit(1))
    f = F.lit(2.0) * p * r / F.greatest(p + r, F.lit(1e-15))
    f = F.when((p < min_precision) | (r < min_recall), F.lit(0.0)).otherwise(f)
    best = F.max_by(F.struct("threshold", f.alias("fscore"), p.alias("precision"), r.alias("recall"),
                             "onset_bias", "offset_bias"), F.struct(f.alias("f"), "threshold"))
    return table.groupBy(*keys, "label").agg(best.alias("b")).select(*keys, "label", "b.*")

"""Masked log losses over score and target tables (values only, no gradients)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earmark.operators.filters import cumulative_targets
from earmark.scale import CHUNK


def known(target: Column | str) -> Column:
    """True where a target is a certain 0 or 1; values around .5 are unknown."""
    t = F.col(target) if isinstance(target, str) else target
    return (t < 0.01) | (t > 0.99)


def mask_targets(targets: DataFrame, target: str = "target") -> DataFrame:
    """Add ``known``; unknown targets become 0."""
    return targets.withColumn("known", known(target)).withColumn(
        target, F.when(F.col("known"), F.col(target)).otherwise(F.lit(0.0)))


def label_rate(targets: DataFrame, target: str = "target") -> DataFrame:
    """Share of known targets."""
    return targets.agg(F.avg(known(target).cast("double")).alias("label_rate"))


def fully_labeled_clips(targets: DataFrame, target: str = "target", framewise: bool = False) -> DataFrame:
    """Clips whose targets are known for all classes; frame-wise: in >.999 of the frames of each class."""
    if not framewise:
        per = targets.groupBy("clip_id").agg(F.bool_and(known(target)).alias("ok"))
        return per.where("ok").select("clip_id")
    per = targets.groupBy("clip_id", "label").agg(F.avg(known(target).cast("double")).alias("rate"))
    return (per.groupBy("clip_id").agg(F.bool_and(F.col("rate") > 0.999).alias("ok"))
            .where("ok").select("clip_id"))


def binary_log_loss(p: Column, t: Column) -> Column:
    return -(t * F.ln(p) + (F.lit(1.0) - t) * F.ln(F.lit(1.0) - p))


def _smooth(t: Column, eps: float) -> Column:
    return F.least(F.greatest(t, F.lit(eps)), F.lit(1.0 - eps)) if eps > 0 else t


def fwd_bwd_log_loss(frames: DataFrame, label_smoothing: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """Frame loss against cumulative boundary targets, mean of both directions, as ``strong_loss``.

    ``frames`` has ``clip_id, label, frame, fwd, bwd, boundary_target``; without ``bwd`` the loss is that of ``fwd``.
    """
    smooth = frames.withColumn("_t", _smooth(F.col("boundary_target"), label_smoothing))
    cum = cumulative_targets(smooth, value="_t", chunk=chunk)
    loss = binary_log_loss(F.col("fwd"), F.col("target_fwd"))
    if "bwd" in frames.columns:
        loss = (loss + binary_log_loss(F.col("bwd"), F.col("target_bwd"))) / 2
    return cum.withColumn("strong_loss", loss).drop("_t", "target_fwd", "target_bwd")


def weak_log_loss(frames: DataFrame, weak_targets: DataFrame, label_smoothing: float = 0.0,
                  class_weights: dict | None = None, strong_fwd_bwd_loss_weight: float = 0.0,
                  chunk: int = CHUNK, weak_as_boundaries: bool = False) -> DataFrame:
    """One-row mean loss: frame mean of each (clip, class), then weighted mean over known targets.

    ``frames``: ``clip_id, label, frame, fwd, bwd`` (valid frames only), and ``boundary_target`` if
    ``strong_fwd_bwd_loss_weight`` > 0; where all boundary targets of a positive class are known, the
    forward/backward loss replaces the weak loss in that proportion. ``weak_as_boundaries`` takes the weak target of a clip and
    class for all its boundary targets. Without ``bwd`` the weak loss is that of ``fwd`` at the last frame.
    """
    w = mask_targets(weak_targets.select("clip_id", "label", F.col("target").alias("weak")), "weak")
    both = "bwd" in frames.columns
    rows = frames.join(w, ["clip_id", "label"])
    if weak_as_boundaries:
        rows = rows.withColumn("boundary_target", F.when(F.col("known"), F.col("weak")).otherwise(F.lit(0.5)))
    if strong_fwd_bwd_loss_weight > 0:
        rows = fwd_bwd_log_loss(rows, label_smoothing, chunk)

    def weak_loss(score):
        return binary_log_loss(score, _smooth(F.col("weak"), label_smoothing)) * F.col("known").cast("double")

    rows = rows.withColumn("weak_loss", weak_loss(F.greatest("fwd", "bwd") if both else F.col("fwd")))
    weak_mean = (F.avg("weak_loss") if both else F.max_by("weak_loss", "frame")).alias("weak_mean")
    if strong_fwd_bwd_loss_weight > 0:
        # the share applies to a whole (clip, class), so frame means can be mixed afterwards
        per = rows.groupBy("clip_id", "label").agg(
            weak_mean,
            F.avg(F.when(known("boundary_target"), F.col("strong_loss")).otherwise(F.col("weak_loss"))).alias("mixed"),
            F.avg(known("boundary_target").cast("double")).alias("rate"),
            F.max("weak").alias("weak"), F.bool_and("known").alias("known"))
        use = (F.col("rate") > 0.999) & (F.col("weak") > 0.99)
        s = strong_fwd_bwd_loss_weight
        loss = F.when(use, F.lit(s) * F.col("mixed") + F.lit(1.0 - s) * F.col("weak_mean")).otherwise(F.col("weak_mean"))
    else:
        per = rows.groupBy("clip_id", "label").agg(
            weak_mean, F.bool_and("known").alias("known"))
        loss = F.col("weak_mean")
    weight = F.col("known").cast("double")
    if class_weights:
        lookup = F.create_map(*[F.lit(v) for kv in sorted(class_weights.items()) for v in kv])
        weight = weight * lookup[F.col("label")]
    return per.agg(F.try_divide(F.sum(loss * weight), F.sum(weight)).alias("loss"))   # NULL if no target is known


def strong_log_loss(frames: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Sum of the loss over known frame targets, divided by their number."""
    k = known(target)
    loss = F.when(k, binary_log_loss(F.col(score), F.col(target)))
    return frames.agg((F.sum(loss) / F.greatest(F.count_if(k), F.lit(1))).alias("loss"))


def segment_max(frames: DataFrame, n: int, columns=("score", "target")) -> DataFrame:
    """Maximum over windows of ``n`` frames; a partial last window is kept."""
    seg = F.floor(F.col("frame") / n).cast("bigint")
    return frames.groupBy("clip_id", "label", seg.alias("segment")).agg(
        *[F.max(c).alias(c) for c in columns])

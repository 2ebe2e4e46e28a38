"""Write detections back as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pseudo_label(clips: DataFrame, labels: DataFrame, tags: DataFrame | None = None,
                 detections: DataFrame | None = None, detection_type: str = "strong") -> DataFrame:
    """New labels ``(clip_id, onset, offset, label, label_type)``.

    ``clips (clip_id, audio_length)``; ``labels (clip_id, label)`` are the present tags, replaced by
    ``tags (clip_id, label, tag)`` if given. ``detections (clip_id, label, onset, offset)`` are kept
    for tagged classes; a tagged class without a detection becomes a weak event over the clip.
    Without ``detections`` all events are weak and carry no times.
    """
    if detection_type not in ("strong", "boundaries"):
        raise ValueError(detection_type)
    present = (tags.where("tag") if tags is not None else labels).select("clip_id", "label").distinct()
    if detections is None:
        if tags is None:
            return labels
        none = F.lit(None).cast("double")
        return present.select("clip_id", none.alias("onset"), none.alias("offset"), "label",
                              F.lit("weak").alias("label_type"))
    kept = detections.join(present, ["clip_id", "label"], "left_semi").select(
        "clip_id", "onset", "offset", "label", F.lit(detection_type).alias("label_type"))
    silent = present.join(detections.select("clip_id", "label"), ["clip_id", "label"], "left_anti")
    whole = silent.join(clips.select("clip_id", "audio_length"), "clip_id", "left").select(
        "clip_id", F.lit(0.0).alias("onset"), F.col("audio_length").alias("offset"), "label",
        F.lit("weak").alias("label_type"))
    return kept.unionByName(whole)


def pseudo_label_statistics(clips: DataFrame, events: DataFrame) -> DataFrame:
    """``(name, value)``: share of clips with a label, share of each label type among the labels."""
    n_clips = clips.select("clip_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    labeled = events.select("clip_id").distinct().agg(F.count(F.lit(1)).alias("k"))
    rate = labeled.select(F.lit("label_rate").alias("name"), (F.col("k") / F.greatest(n_clips, F.lit(1))).alias("value"))
    kinds = ("weak", "boundaries", "strong")
    shares = events.agg(*[F.coalesce(F.avg((F.col("label_type") == k).cast("double")), F.lit(0.0)).alias(k) for k in kinds])
    tall = shares.select(F.explode(F.array(*[
        F.struct(F.lit(f"{k}_rate").alias("name"), F.col(k).alias("value")) for k in kinds])).alias("s")).select("s.*")
    return rate.unionByName(tall)


def replace_labels(clips: DataFrame, pseudo: DataFrame, classes=None) -> DataFrame:
    """Events of ``clips`` from a pseudo-label table ``(clip_id, onset, offset, label)``.

    ``pseudo`` has at least one row per clip; NULL label = no event. A clip without any row raises.
    Labels outside ``classes`` are left out.
    """
    if classes is not None:
        wanted = F.col("label").isin(list(classes))
        pseudo = pseudo.withColumns({c: F.when(wanted, F.col(c)) for c in ("onset", "offset")}).withColumn(
            "label", F.when(wanted, F.col("label")))
    rows = clips.select("dataset", "clip_id").join(pseudo.withColumn("_seen", F.lit(True)), "clip_id", "left")
    # the check sits in the filter: it cannot be pruned, and no unmatched row can slip past it
    unseen = F.raise_error(F.concat(F.lit("no pseudo label for "), F.col("clip_id"))).cast("boolean")
    keep = F.when(F.col("_seen").isNull(), unseen).otherwise(F.col("label").isNotNull())
    return rows.where(keep).select(
        "dataset", "clip_id", "onset", "offset", "label", F.lit("strong").alias("label_type"))

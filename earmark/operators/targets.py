"""Clip and frame targets from event labels: 0, 1, or .5 for unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.functions.labels import samples_to_frames, seconds_to_samples
from earmark.scale import CHUNK, chunk_of, join_large, running


def label_boundaries(events: DataFrame, keys=("clip_id",)) -> DataFrame:
    """First start and last stop per clip and class over ``boundaries`` and ``strong`` labels."""
    return (events.where(F.col("label_type").isin("boundaries", "strong"))
            .groupBy(*keys, "label").agg(F.min("start").alias("start"), F.max("stop").alias("stop")))


def boundaries_from_events(events: DataFrame, mode: str = "last") -> DataFrame:
    """One interval per clip and class: first listed onset, last listed offset (``mode='max'``: latest)."""
    offset = F.max_by("offset", "pos") if mode == "last" else F.max("offset")
    return events.groupBy("clip_id", "label").agg(F.min_by("onset", "pos").alias("onset"), offset.alias("offset"))


def weak_targets(clips: DataFrame, classes, events: str = "events") -> DataFrame:
    """``(clip_id, label, target)``: 1 if present, .5 if absent in an unlabeled clip, else 0.

    ``classes`` is the label list; it is unfolded inside each row, without a join.
    """
    labels = F.transform(F.coalesce(F.col(events), F.array().cast(clips.schema[events].dataType)), lambda e: e.label)
    grid = clips.select("clip_id", F.col(events).isNull().alias("_u"), labels.alias("_l"),
                        F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    target = F.when(F.array_contains("_l", F.col("label")), 1.0).when(F.col("_u"), 0.5).otherwise(0.0)
    return grid.select("clip_id", "label", target.alias("target"))


def frame_targets(clips: DataFrame, events: DataFrame, classes, kind: str = "strong",
                  unlabeled: str = "unlabeled", keys=("clip_id",)) -> DataFrame:
    """``(keys, frame, label, target)`` for ``kind`` ``strong`` or ``boundaries``.

    ``clips (keys, seq_len, unlabeled)``; ``events (keys, label, label_type, start, stop)`` in frames, half open. ``keys`` name a
    clip, such as ``dataset, clip_id``. A frame is 1 inside a label of the kind. Elsewhere it is .5 when the clip is unlabeled or
    a coarser label of the class covers it, else 0.

    A sweep over the borders of labels gives stretches of equal targets for every clip and class; they are joined and shuffled
    as such and unfold to frames last. Clips and labels are dealt out by clip, once; borders are counted and swept where they lie.
    Clips that are longer than a chunk are swept chunk by chunk.
    """
    if kind not in ("strong", "boundaries"):
        raise ValueError(kind)
    keys, classes = list(keys), list(classes)
    by, flag = [*keys, "label"], F.col(unlabeled).alias("_unlabeled")
    clip = [*by, "_unlabeled", "_len"]
    lengths = clips.where("seq_len > 0").select(*keys, F.col("seq_len").cast("bigint").alias("_len"), flag).repartition(*keys)
    bounded = (join_large(events.where(F.col("label").isin(classes)), lengths, keys)
               .withColumns({"start": F.greatest(F.col("start"), F.lit(0)), "stop": F.least(F.col("stop"), F.col("_len"))}))
    fine = F.col("label_type").eqNullSafe("strong").cast("int") if kind == "strong" else F.lit(0)
    spans = bounded.where("stop > start").select(*clip, "start", "stop", F.lit(1).alias("any"), fine.alias("fine"))
    if kind == "boundaries":
        exact = label_boundaries(bounded, [*keys, "_unlabeled", "_len"]).where("stop > start")
        spans = spans.unionByName(exact.withColumns({"any": F.lit(0), "fine": F.lit(1)}))
    borders = F.explode(F.array(*[F.struct(F.col(at).cast("bigint").alias("frame"), (F.col("any") * sign).alias("any"),
                                           (F.col("fine") * sign).alias("fine")) for at, sign in (("start", 1), ("stop", -1))]))
    borders = spans.select(*clip, borders.alias("_b")).select(*clip, "_b.*")
    heads = lengths.select(*keys, F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"), "_unlabeled", "_len",
                           F.lit(0).cast("bigint").alias("frame"), F.lit(0).alias("any"), F.lit(0).alias("fine"))
    points = heads.unionByName(borders).groupBy(*clip, "frame").agg(F.sum("any").alias("any"), F.sum("fine").alias("fine"))
    # a border opens a stretch that lasts until the next one or the end of the clip
    w = W.partitionBy(*by, "_unlabeled", "_len").orderBy("frame")
    whole = points.where(F.col("_len") <= CHUNK).withColumns({
        "_in": F.sum("any").over(w), "_sure": F.sum("fine").over(w), "_to": F.lead("frame").over(w)})
    parts = points.where(F.col("_len") > CHUNK).withColumn("_chunk", chunk_of("frame", CHUNK))
    parts = running(parts, clip, "_chunk", ["frame"], {"_in": ("sum", "any"), "_sure": ("sum", "fine")})
    parts = running(parts, clip, "_chunk", ["frame"], {"_to": ("min", "frame")}, backward=True, strict=True).drop("_chunk")
    target = F.when(F.col("_sure") > 0, 1.0).when(F.coalesce("_unlabeled", F.lit(False)) | (F.col("_in") > 0), 0.5).otherwise(0.0)
    # the border at the end of a clip opens nothing
    stretches = whole.unionByName(parts).where("frame < _len").select(*by, target.alias("target"), F.explode(
        F.sequence("frame", F.coalesce("_to", "_len") - 1)).alias("frame"))
    return stretches.select(*keys, "frame", "label", "target")


def events_to_frames(events: DataFrame, rate: int = 16000, shift: int = 320) -> DataFrame:
    """Event seconds to sample and frame positions; onsets round down, offsets up."""
    rows = events.withColumns({"start_samples": seconds_to_samples("onset", rate),
                               "stop_samples": seconds_to_samples("offset", rate, stop=True)})
    return rows.withColumns({"start_frames": samples_to_frames("start_samples", shift),
                             "stop_frames": samples_to_frames("stop_samples", shift, stop=True)})

"""Split long sequences into overlapping segments and merge segment scores back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.functions.labels import segment_id, segment_parts


def split_sequences(clips: DataFrame, max_length: int, overlap: int, data: str = "data",
                    clip_id: str = "clip_id") -> DataFrame:
    """Segments of at most ``max_length`` items of an array column, ``max_length - overlap`` apart.

    Counted per clip; clips that fit keep their id. Adds ``segment_start`` and ``seq_len``.
    """
    shift = max_length - overlap
    if shift <= 0:
        raise ValueError("overlap must be smaller than max_length")
    length = F.size(data)
    m = F.when(length <= max_length, F.lit(1)).otherwise(F.ceil((length - max_length) / shift).cast("int") + 1)
    rows = clips.withColumns({"_len": length, "_m": m}).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    start = F.col("_i") * shift
    new_id = F.when(F.col("_m") > 1, segment_id(clip_id, "_i", "_m")).otherwise(F.col(clip_id))
    rows = rows.withColumns({"segment_start": start,
                             "seq_len": F.least(F.lit(max_length), F.col("_len") - start)})
    return (rows.withColumn(data, F.slice(data, F.col("segment_start") + 1, F.col("seq_len")))
            .withColumn(clip_id, new_id).drop("_len", "_m", "_i"))


def merge_segment_scores(scores: DataFrame, overlap: int, clip_id: str = "clip_id", frame: str = "frame",
                         label: str = "label", value: str = "score") -> DataFrame:
    """Long-form merge: cut half of the overlap on each side, number the frames through.

    Each segment but the last loses ``ceil(overlap / 2)`` frames at its end, each but the first
    ``overlap // 2`` at its start. A missing segment raises; unsegmented ids pass through.
    Offsets come from per-segment lengths, so no window spans a whole clip of frames.
    """
    rows = scores.withColumn("_p", segment_parts(clip_id)).select(
        F.col("_p.clip_id").alias(clip_id), F.col("_p.segment").alias("_s"), F.col("_p.n_segments").alias("_m"),
        frame, label, value)
    lengths = rows.groupBy(clip_id, "_s").agg((F.max(frame) + 1).alias("_len"), F.max("_m").alias("_m"))
    head = F.when(F.col("_s") > 0, F.lit(overlap // 2)).otherwise(F.lit(0))
    tail = F.when(F.col("_s") < F.col("_m") - 1, F.lit((overlap + 1) // 2)).otherwise(F.lit(0))
    lengths = lengths.withColumns({"_head": head, "_kept": F.col("_len") - head - tail})
    w = W.partitionBy(clip_id).orderBy("_s")
    whole = W.partitionBy(clip_id)
    lengths = lengths.withColumns({
        "_offset": F.coalesce(F.sum("_kept").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_found": F.count(F.lit(1)).over(whole)})
    complete = F.when(F.col("_found") != F.col("_m"), F.raise_error(F.lit("a segment is missing")).cast("bigint"))
    lengths = lengths.withColumn("_offset", complete.otherwise(F.col("_offset")))
    rows = rows.drop("_m").join(lengths.select(clip_id, "_s", "_head", "_kept", "_offset"), [clip_id, "_s"])
    local = F.col(frame) - F.col("_head")
    rows = rows.where((local >= 0) & (local < F.col("_kept")))
    return rows.select(clip_id, (local + F.col("_offset")).cast("bigint").alias(frame), label, value)

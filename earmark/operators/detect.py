"""Scores to intervals, clip tags, tag masks and interval corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earmark.scale import CHUNK, chunk_of, chunk_window, own_rows, running, with_halo
from earmark.schema import SERIES


def label_map(values: dict) -> Column:
    """Lookup of a per-class parameter as a literal map; NULL for other labels."""
    m = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
    return F.try_element_at(m, F.col("label"))


def linspace(first: float, last: float, n: int) -> list[float]:
    step = (last - first) / (n - 1)
    return [first + step * i for i in range(n - 1)] + [last]


def score_intervals(scores: DataFrame, thresholds, series=SERIES, value: str = "score",
                    frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of successive frames with ``score > threshold`` as ``(threshold, *series, onset, offset)``.

    ``thresholds`` is one number, a list of numbers (one result per threshold), a
    ``{label: threshold}`` dict, or a DataFrame ``(label, threshold)``. All thresholds are handled
    in one pass: only rows where a run starts or ends are kept, so the work follows the number of
    intervals, not rows times thresholds.
    """
    series = list(series)
    if isinstance(thresholds, DataFrame):
        per_label = thresholds.select("label", F.array(F.col("threshold").cast("double")).alias("_thr"))
        rows = scores.join(per_label, "label")
    else:
        if isinstance(thresholds, dict):
            thr = F.array(label_map({k: float(v) for k, v in thresholds.items()}))
        elif isinstance(thresholds, (list, tuple)):
            thr = F.array(*[F.lit(float(t)) for t in thresholds])
        else:
            thr = F.array(F.lit(float(thresholds)))
        rows = scores.withColumn("_thr", thr)
    rows = rows.select(*series, frame, "onset", "offset", F.col(value).alias("_s"), "_thr")
    s, prev, nxt = F.col("_s"), F.col("_prev"), F.col("_next")

    def edge(t):
        return F.struct(t.alias("threshold"),
                        (prev.isNull() | (prev <= t)).alias("starts"),
                        (nxt.isNull() | (nxt <= t)).alias("ends"))

    def edges(part):
        part = with_halo(part, 1, 1, chunk, frame)
        w = chunk_window(series, frame)
        # a missing frame has no score: it ends a run
        part = part.withColumns({"_prev": F.when(F.lag(frame).over(w) == F.col(frame) - 1, F.lag("_s").over(w)),
                                 "_next": F.when(F.lead(frame).over(w) == F.col(frame) + 1, F.lead("_s").over(w))})
        part = own_rows(part, chunk, frame)
        found = F.filter(F.transform(F.filter("_thr", lambda t: s > t), edge), lambda e: e.starts | e.ends)
        return (part.select(*series, frame, "onset", "offset", F.explode(found).alias("_e"))
                .select(*series, frame, "onset", "offset", "_e.*")
                .withColumn("_chunk", chunk_of(frame, chunk)))

    # a run ends at the first end at or after its start; this filter reaches the scan, so only series
    # longer than a chunk are read a second time
    later = edges(rows.where(F.col(frame) >= chunk - 1)).where("_chunk > 0")
    rows = running(edges(rows), ["threshold", *series], "_chunk", [frame],
                   {"_stop": ("min", F.when(F.col("ends"), F.col("offset")))}, backward=True, later=later)
    return rows.where("starts").select("threshold", *series, "onset", F.col("_stop").alias("offset"))


def clip_scores(scores: DataFrame, keys=SERIES, value: str = "score") -> DataFrame:
    """Clip score: maximum over frames."""
    return scores.groupBy(*keys).agg(F.max(value).alias(value))


def clip_tags(clip_scores: DataFrame, thresholds, value: str = "score") -> DataFrame:
    """``tag`` is true where the clip score is strictly above the class threshold."""
    if isinstance(thresholds, DataFrame):
        rows = clip_scores.join(thresholds.select("label", "threshold"), "label")
        thr = F.col("threshold")
    elif isinstance(thresholds, dict):
        rows, thr = clip_scores, label_map({k: float(v) for k, v in thresholds.items()})
    else:
        rows, thr = clip_scores, F.lit(float(thresholds))
    return rows.select("clip_id", "label", (F.col(value) > thr).alias("tag"))


def mask_by_tags(scores: DataFrame, tags: DataFrame, apply_mask=True, value: str = "score",
                 strict: bool = True) -> DataFrame:
    """``score * max(tag, 1 - apply_mask)``; a clip and class without a tag row raises if ``strict``.

    ``apply_mask`` is a bool, a ``{label: bool}`` dict, or a boolean Column.
    """
    if isinstance(apply_mask, dict):
        mask = label_map({k: bool(v) for k, v in apply_mask.items()})
    elif isinstance(apply_mask, Column):
        mask = apply_mask
    else:
        mask = F.lit(bool(apply_mask))
    rows = scores.join(tags.select("clip_id", "label", F.col("tag").alias("_tag")), ["clip_id", "label"], "left")
    tag = F.col("_tag").cast("double")
    if strict:
        tag = F.when(F.col("_tag").isNull(), F.raise_error(F.lit("no tag for clip")).cast("double")).otherwise(tag)
    keep = F.greatest(tag, F.lit(1.0) - mask.cast("double"))
    return rows.withColumn(value, F.col(value) * keep).drop("_tag")


def correct_intervals(detections: DataFrame, onset_bias=None, offset_bias=None, widening: float = 0.0,
                      decimals: int | None = None) -> DataFrame:
    """Subtract biases, widen on both sides, clip at 0 and drop empty intervals.

    Biases: ``{label: seconds}``; missing means 0. ``decimals`` rounds half to even.
    """
    def bias(values):
        return F.coalesce(label_map({k: float(v) for k, v in values.items()}), F.lit(0.0)) if values else F.lit(0.0)

    on = F.col("onset") - F.lit(float(widening)) - bias(onset_bias)
    off = F.col("offset") + F.lit(float(widening)) - bias(offset_bias)
    if decimals is not None:
        on, off = F.bround(on, decimals), F.bround(off, decimals)
    return detections.withColumns({"onset": F.greatest(on, F.lit(0.0)), "offset": off}).where("offset > onset")

"""Clip-id parsing, label states and class names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEGMENT_MARK = "_!segment!_"


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def cut_last_part(clip_id) -> Column:
    """Drop the last ``_`` part: segment id to clip id."""
    return F.regexp_replace(_c(clip_id), "_[^_]*$", "")


def strip_wav(name) -> Column:
    return F.regexp_replace(_c(name), r"\.wav$", "")


def source_clip_id(clip_id) -> Column:
    """Id without its last two ``_`` parts and its first character."""
    return F.substring(F.regexp_replace(_c(clip_id), "(_[^_]*){1,2}$", ""), 2, 2147483647)


def segment_parts(clip_id) -> Column:
    """Struct ``(clip_id, segment, n_segments)``; an unsegmented id is segment 0 of 1."""
    c = _c(clip_id)
    pattern = r"^(.*)_!segment!_(\d+)_(\d+)$"
    found = c.rlike(pattern)

    def number(i, default):
        return F.when(found, F.regexp_extract(c, pattern, i)).otherwise(F.lit(default)).cast("int")

    return F.struct(F.when(found, F.regexp_extract(c, pattern, 1)).otherwise(c).alias("clip_id"),
                    number(2, "0").alias("segment"), number(3, "1").alias("n_segments"))


def segment_id(clip_id, segment, n_segments) -> Column:
    return F.concat(_c(clip_id), F.lit(SEGMENT_MARK), _c(segment).cast("string"), F.lit("_"), _c(n_segments).cast("string"))


def clean_class_name(label) -> Column:
    """File-system friendly class name."""
    c = F.replace(_c(label), F.lit(", "), F.lit("__"))
    for old, new in ((" ", ""), ("'", ""), ("(", "_"), (")", "_")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def natural_key(clip_id) -> list[Column]:
    """Order columns for natural sorting: text in which every number, of any length, is led by its number of digits; the id."""
    c = _c(clip_id)

    def part(x):
        digits = F.ltrim(x, F.lit("0"))
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(x)

    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return [F.array_join(F.transform(parts, part), ""), c]


def label_state(clips: DataFrame, labels: str = "labels", starts: str = "starts", stops: str = "stops",
                length: str = "audio_length", types: str = "label_types") -> DataFrame:
    """Three-way label state: replaces the parallel lists by ``events`` and ``unlabeled``.

    Times present: strong events; labels only: weak events spanning the clip; no list at all
    (NULL): no events and ``unlabeled`` true. An existing ``types`` list is kept.
    """
    has_types = types in clips.columns

    def event(label, i, onset, offset, default):
        t = F.coalesce(F.get(F.col(types), i), F.lit(default)) if has_types else F.lit(default)
        return F.struct(onset.cast("double").alias("onset"), offset.cast("double").alias("offset"),
                        label.alias("label"), t.alias("label_type"))

    strong = F.transform(labels, lambda x, i: event(x, i, F.get(F.col(starts), i), F.get(F.col(stops), i), "strong"))
    weak = F.transform(labels, lambda x, i: event(x, i, F.lit(0.0), F.col(length), "weak"))
    timed = F.col(starts).isNotNull() & F.col(stops).isNotNull()
    events = (F.when(F.col(labels).isNotNull() & timed, strong).when(F.col(labels).isNotNull(), weak))
    nothing = F.coalesce(events, F.from_json(F.lit("[]"),
                         "array<struct<onset:double,offset:double,label:string,label_type:string>>"))
    return clips.withColumns({"events": nothing, "unlabeled": F.col(labels).isNull()})


def sort_events(events) -> Column:
    """Events of a clip by (onset, offset, label)."""
    return F.array_sort(_c(events), lambda a, b: (
        F.when(a.onset < b.onset, -1).when(a.onset > b.onset, 1)
        .when(a.offset < b.offset, -1).when(a.offset > b.offset, 1)
        .when(a.label < b.label, -1).when(a.label > b.label, 1).otherwise(0)))


def keep_classes(events, classes) -> Column:
    """Events of the given classes; NULL (unlabeled) stays NULL."""
    wanted = list(classes)
    return F.filter(_c(events), lambda e: e.label.isin(wanted))


def floored_sigmoid(y, minimum_score: float = 1e-5) -> Column:
    """Logistic score kept away from 0 and 1 by ``minimum_score``."""
    m = float(minimum_score)
    return F.lit(m) + F.lit(1 - 2 * m) / (F.lit(1.0) + F.exp(-_c(y)))


def frame_time(frame, shift: int = 320, rate: int = 16000, decimals: int = 6) -> Column:
    """Start time of a frame in seconds."""
    return F.bround(_c(frame) * F.lit(shift / rate), decimals)


def seconds_to_samples(t, rate: int = 16000, stop: bool = False) -> Column:
    x = F.round(_c(t) * F.lit(float(rate)), 6)
    return (F.ceil(x) if stop else F.floor(x)).cast("bigint")


def samples_to_frames(samples, shift: int = 320, stop: bool = False) -> Column:
    """Onsets round down, offsets round up."""
    x = _c(samples) / F.lit(float(shift))
    return (F.ceil(x) if stop else F.floor(x)).cast("bigint")


def segment_grid(length, max_segment_length: int, segment_overlap: int, frame_shift: float,
                 late: bool = False) -> Column:
    """Array of segment border times of a clip, from 0 to its length.

    ``late=False``: a border every ``(max - overlap)`` frames. ``late=True``: the first border comes
    after a full segment, minus half the overlap.
    """
    step = (max_segment_length - segment_overlap) * frame_shift
    first = (2 + max_segment_length) * frame_shift if late else 0.0
    n = F.greatest(F.ceil((_c(length) - F.lit(first)) / F.lit(step)).cast("int"), F.lit(0))
    # sequence(1, 0) would run backwards, so the empty case is cut off by slice
    ticks = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n)
    back = segment_overlap / 2 * frame_shift if late else 0.0
    times = F.transform(ticks, lambda i: F.lit(first) + i * F.lit(step) - F.lit(back))
    head = F.array(F.lit(0.0)) if late else F.array().cast("array<double>")
    return F.concat(head, times, F.array(_c(length)))

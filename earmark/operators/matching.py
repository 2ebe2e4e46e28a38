"""Interval joins, covered lengths and one-to-one matching of detections and ground truth.

The joins add a time bin to the equi key, so a clip with very many events spreads over bins. Covered lengths need no pairs at
all: they are differences of a running sum along the time line. Matching runs along the time line too.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from earmark.scale import cut_lineage, join_large, running

TICK = 1_000_000      # covered lengths are whole millionths, so sums do not depend on their order
POINTS = 100_000      # ends of intervals that one piece of the time line holds, if they are spread evenly


def ticks(t: Column) -> Column:
    return F.round(t * F.lit(float(TICK))).cast("bigint")


def _bin(t: Column, width) -> Column:
    return F.floor(t / (width if isinstance(width, Column) else F.lit(float(width)))).cast("bigint")


def _piece_width(rows: DataFrame, series, start: str, stop: str, points: int, least: float) -> Column:
    """Width of pieces of the time line that hold about ``points`` rows of any one series; NULL if every series is smaller. More
    series do not make pieces narrower."""
    n = F.count(F.lit(1))
    width = F.when(n > points, F.greatest(F.lit(least), (F.max(stop) - F.min(start)) * F.lit(float(points)) / n))
    return rows.groupBy(*series).agg(width.alias("width")).agg(F.min("width")).scalar()


def _piece(time: str, width: Column) -> Column:
    return F.coalesce(F.floor(F.col(time) / width), F.lit(0)).cast("bigint")


GROW = 4.0            # each level of bins is so many times wider than the one before


def overlap_pairs(detections: DataFrame, ground_truth: DataFrame, same_label: bool = True,
                  bin_width: float | None = None, keys=("clip_id",)) -> DataFrame:
    """Pairs with ``det_onset < gt_offset and gt_onset < det_offset`` in a clip, with ``overlap``.

    Inputs carry ``label, onset, offset`` and an id each: ``det_id`` / ``gt_id``. With
    ``same_label=False`` the labels differ.

    Bins come in levels. An interval belongs to the first level whose bins are as long as itself, so it touches two bins
    there however long it is; it also stands in the bins of coarser levels, as far as the other side has intervals of that
    length. A pair meets at the coarser of its two levels, in the first bin both touch, so rows follow the number of intervals
    and no pair comes twice.
    The finest bins are ``bin_width`` wide, by default twice the mean ground-truth length. An interval without length is a point: it
    meets, with an overlap of 0, what reaches to both sides of it.
    """
    length = F.abs(F.col("offset") - F.col("onset"))
    first, last = F.least("onset", "offset"), F.greatest("onset", "offset")
    detections, ground_truth = (df.where("onset is not null and offset is not null") for df in (detections, ground_truth))
    # two rows of bounds, fetched first: as literals they keep the plan small
    some = ground_truth.agg(F.avg(F.when(length > 0, length)).alias("mean"), F.max(length).alias("longest"), F.min(first).alias("low"),
                            F.max(last).alias("high")).first()
    mean, longest, lowest, highest = (float(x or 0.0) for x in some)
    width = float(bin_width) if bin_width is not None else mean * 2 or 1.0

    def level(span):
        return F.greatest(F.lit(0), F.ceil(F.log(span / F.lit(width)) / math.log(GROW)).cast("int"))

    reach = detections.agg(F.max(length)).first()[0]
    top = level(F.lit(min(highest - lowest, float(reach or 0.0))))

    def binned(df, name, top):
        """``df`` in the bins of its own level ``_own_<name>`` and of all coarser ones up to ``top``."""
        # what lies outside the ground truth overlaps nothing: it needs no bins
        ends = F.col(f"{name}_onset"), F.col(f"{name}_offset")
        on, off = F.greatest(F.least(*ends), F.lit(lowest)), F.least(F.greatest(*ends), F.lit(highest))
        df = df.withColumns({"_on": on, "_off": off}).where("_off >= _on")
        own = level(F.col("_off") - F.col("_on"))
        df = df.withColumn(f"_own_{name}", own)
        df = df.withColumn("_level", F.explode(F.sequence(F.col(f"_own_{name}"), F.greatest(F.col(f"_own_{name}"), top))))
        size = F.lit(width) * F.pow(F.lit(GROW), F.col("_level"))
        first, last = (F.floor((F.col(c) - F.lit(lowest)) / size).cast("bigint") for c in ("_on", "_off"))
        return df.withColumn(f"_first_{name}", first).withColumn("_bin", F.explode(F.sequence(first, last))).drop("_on", "_off")

    det = detections.withColumnsRenamed({"onset": "det_onset", "offset": "det_offset"})
    gt = ground_truth.withColumnsRenamed({"onset": "gt_onset", "offset": "gt_offset"})
    keys = list(keys)
    if same_label:
        on = [*keys, "label", "_level", "_bin"]
    else:
        gt = gt.withColumnRenamed("label", "gt_label")
        on = [*keys, "_level", "_bin"]
    pairs = join_large(binned(det, "det", level(F.lit(longest))), binned(gt, "gt", top), on)
    keep = ((F.col("det_onset") < F.col("gt_offset")) & (F.col("gt_onset") < F.col("det_offset"))
            & (F.col("_level") == F.greatest("_own_det", "_own_gt")) & (F.col("_bin") == F.greatest("_first_det", "_first_gt")))
    if not same_label:
        keep = keep & (F.col("label") != F.col("gt_label"))
    overlap = F.least("det_offset", "gt_offset") - F.greatest("det_onset", "gt_onset")
    return pairs.where(keep).withColumn("overlap", overlap).drop(
        "_level", "_bin", "_first_det", "_first_gt", "_own_det", "_own_gt")


def collar_pairs(detections: DataFrame, ground_truth: DataFrame, onset_collar: float, offset_collar: float,
                 offset_collar_rate: float = 0.0, keys=("clip_id", "label")) -> DataFrame:
    """Candidate matches: onsets within the collar, offsets within the larger of collar and rate x length.

    ``onset_dist`` and ``offset_dist`` are detection minus ground truth.
    """
    width = float(onset_collar) if onset_collar > 0 else 1.0
    det = (detections.withColumnsRenamed({"onset": "det_onset", "offset": "det_offset"})
           .withColumn("_bin", _bin(F.col("det_onset"), width)))
    g = F.col("gt_onset")
    reach = F.lit(width * 1.001)  # the margin keeps pairs at the very edge of the collar
    gt = (ground_truth.withColumnsRenamed({"onset": "gt_onset", "offset": "gt_offset"})
          .withColumn("_bin", F.explode(F.sequence(_bin(g - reach, width), _bin(g + reach, width)))))
    pairs = join_large(det, gt, [*keys, "_bin"]).drop("_bin")
    pairs = pairs.withColumns({"onset_dist": F.col("det_onset") - F.col("gt_onset"),
                               "offset_dist": F.col("det_offset") - F.col("gt_offset")})
    collar = F.greatest(F.lit(float(offset_collar)),
                        F.lit(float(offset_collar_rate)) * (F.col("gt_offset") - F.col("gt_onset")))
    return pairs.where((F.abs("onset_dist") <= float(onset_collar)) & (F.abs("offset_dist") <= collar))


def unique_pairs(pairs: DataFrame, det_id, gt_id) -> DataFrame:
    """Pairs that are the only candidate of both their detection and their ground truth."""
    by_det = pairs.groupBy(*det_id).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*det_id)
    by_gt = pairs.groupBy(*gt_id).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*gt_id)
    return pairs.join(by_det, list(det_id), "left_semi").join(by_gt, list(gt_id), "left_semi")


def covered(intervals: DataFrame, ground_truth: DataFrame, by, ids, points: int = POINTS) -> DataFrame:
    """``ids`` and ``cover``: for every interval the summed overlaps, in ticks, with ground truth that is equal in ``by``.

    ``ids`` are columns of ``intervals`` that tell them apart and include ``by``, ``onset`` and ``offset``. The length covered
    up to a time is a running sum over the ends of events; an interval reads it at both its ends. No pair is written, and long
    series are summed in pieces of the time line.
    """
    by, ids = list(by), list(ids)
    gt = ground_truth.select(*by, ticks(F.col("onset")).alias("_on"), ticks(F.col("offset")).alias("_off")).where("_off > _on")
    ends = gt.select(*by, F.explode(F.array(F.struct(F.col("_on").alias("x"), F.lit(1).alias("n")),
                                            F.struct(F.col("_off").alias("x"), F.lit(-1).alias("n")))).alias("_e"))
    ends = ends.select(*by, "_e.x", F.col("_e.n").cast("bigint").alias("n"), (F.col("_e.x") * F.col("_e.n")).alias("m"))
    asks = intervals.select(*by, F.struct(*ids).alias("_id"), F.explode(F.array(
        F.struct(ticks(F.col("onset")).alias("x"), F.lit(-1).alias("sign")),
        F.struct(ticks(F.col("offset")).alias("x"), F.lit(1).alias("sign")))).alias("_e")).select(*by, "_id", "_e.*")
    rows = ends.unionByName(asks, allowMissingColumns=True)
    rows = rows.withColumn("_piece", _piece("x", _piece_width(gt, by, "_on", "_off", points, 1.0)))
    # what is open or covered before a piece stands at its head, in a row of its own
    across = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    heads = rows.groupBy(*by, "_piece").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    heads = heads.select(*by, "_piece", F.sum("n").over(across).alias("n"), F.sum("m").over(across).alias("m"))
    rows = rows.unionByName(heads.where("n <> 0 or m <> 0"), allowMissingColumns=True)
    inside = W.partitionBy(*by, "_piece").orderBy(F.col("x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    n, m = (F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("n", "m"))
    rows = rows.withColumn("_upto", F.col("x") * n - m).where("_id is not null")
    return rows.groupBy("_id").agg(F.sum(F.col("_upto") * F.col("sign")).alias("cover")).select("_id.*", "cover")


def covered_in_clips(intervals: DataFrame, ground_truth: DataFrame, share: float | None = None) -> DataFrame:
    """``intervals`` with ``cover``, the summed overlaps in ticks with ground truth of their clip and label, and ``crossed``, the other
    labels of which ground truth covers ``share`` of them or more.

    For clips whose ground truth fits into a task; intervals pass by as a stream. They are shuffled once, for all labels.
    """
    names = intervals.columns
    times = [ticks(F.col("onset")).alias("_on"), ticks(F.col("offset")).alias("_off")]
    gt = ground_truth.select("clip_id", "label", *times, F.lit(False).alias("_run")).where("_off > _on")
    rows = gt.unionByName(intervals.select(*names, *times, F.lit(True).alias("_run")), allowMissingColumns=True)
    rows = rows.select(*names, "_on", "_off", "_run").repartition("clip_id").sortWithinPartitions("clip_id", "_run")
    clip, label, n = names.index("clip_id"), names.index("label"), len(names)

    def run(batches):
        held, parts, sums = None, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pc.dictionary_encode(batch.column(i)) for i in (clip, label)]
            clips, labels = (c.dictionary.to_pylist() for c in codes)
            code_of = {None: -1} | {other: i for i, other in enumerate(labels)}
            at, own = (pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False) for c in codes)
            on, off = (pc.fill_null(batch.column(n + i), 0).to_numpy(zero_copy_only=False) for i in (0, 1))
            runs = batch.column(n + 2).to_numpy(zero_copy_only=False)
            cover, hits = np.zeros(batch.num_rows, np.int64), []
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                name = (clips[at[a]] if at[a] >= 0 else None,)
                if name != held:
                    held, parts, sums = name, {}, {}
                first = a + int(np.searchsorted(runs[a:b], True))          # ground truth comes first
                for code in np.unique(own[a:first]):
                    some = a + np.flatnonzero(own[a:first] == code)
                    parts.setdefault(labels[code] if code >= 0 else None, []).append((on[some], off[some]))
                if first == b or not parts:
                    continue
                sums = sums or {k: _running_cover(v) for k, v in parts.items()}
                x = np.concatenate([on[first:b], off[first:b]])
                length = (off - on)[first:b]
                for other, upto in sums.items():
                    c = upto(x)
                    c = c[b - first:] - c[:b - first]
                    same = own[first:b] == code_of.get(other, -2)
                    cover[first:b][same] = c[same]
                    if share is not None and None not in (other, name[0]):
                        hit = np.flatnonzero(~same & (own[first:b] >= 0) & (length > 0) & (c >= share * length))
                        if len(hit):
                            hits.append((first + hit, [other] * len(hit)))
            keep = np.flatnonzero(runs)
            place = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
            found = pa.array([o for h in hits for o in h[1]], batch.column(label).type).take(pa.array(np.argsort(place, kind="stable")))
            sizes = np.bincount(place, minlength=batch.num_rows)[keep]
            crossed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(keep)) for i in range(n)), pa.array(cover[keep]), crossed],
                                             names=[*names, "cover", "crossed"])

    kind = intervals.schema["label"].dataType
    return rows.mapInArrow(run, T.StructType([*intervals.schema.fields, T.StructField("cover", T.LongType()),
                                              T.StructField("crossed", T.ArrayType(kind))]))


def _running_cover(parts):
    """Function: length that intervals cover up to each of some times, counted as often as they overlap."""
    ends = [np.sort(np.concatenate(p)) for p in zip(*parts)]
    sums = [np.concatenate([[0], np.cumsum(e)]) for e in ends]

    def upto(x):
        opened, closed = (np.searchsorted(e, x) for e in ends)
        return (opened - closed) * x - sums[0][opened] + sums[1][closed]

    return upto


def one_to_one(pairs: DataFrame, det_id, gt_id, series=("clip_id", "label"), points: int = POINTS) -> DataFrame:
    """Each event used once: detections in order of time take the free candidate with the earliest deadline.

    A candidate's deadline is its last candidate detection; ties go by ground-truth onset, offset and id. Detections go by onset,
    offset and id. Where the detections of a series do not overlap this is a largest possible matching: every event can be met by
    a stretch of successive detections.

    ``series`` are columns that all pairs of an event share; NULLs are equal there. Pairs are matched in sessions, chains of
    pairs whose times overlap; sessions are found by running maxima in pieces of the time line. A session is one pass over its
    pairs that remembers only events that can still be met, so the number of jobs does not depend on the length of a chain.
    """
    det_id, gt_id, series = list(det_id), list(gt_id), list(series)
    names = pairs.columns
    pairs = cut_lineage(pairs.withColumns({"_start": F.least("det_onset", "gt_onset"), "_stop": F.greatest("det_onset", "gt_onset")}))
    last = pairs.groupBy(*gt_id).agg(F.max(F.struct("det_onset", "det_offset", *[F.col(c).alias(f"d{i}") for i, c in enumerate(det_id)]))
                                     .alias("_deadline"))
    rows = join_large(pairs, last.withColumnsRenamed({c: f"_k_{c}" for c in gt_id}),
                      [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in gt_id]).drop(*[f"_k_{c}" for c in gt_id])
    rows = sessions(rows, series, points)
    order = [F.col(c) for c in (*series, "_session", "det_onset", "det_offset", *det_id, "_deadline", "gt_onset", "gt_offset", *gt_id)]
    rows = rows.withColumns({"_det": F.xxhash64(*det_id), "_gt": F.xxhash64(*gt_id), "_new": F.xxhash64(*series, "_session"),
                             "_until": F.col("_deadline.det_onset")})
    rows = rows.repartition(*series, "_session").sortWithinPartitions(*order)
    rows = rows.select(*names, "_new", "_det", "_gt", "_until")
    return rows.mapInArrow(_matcher(len(names), names.index("det_onset")), rows.select(*names).schema)


def sessions(rows: DataFrame, series, points: int = POINTS) -> DataFrame:
    """``_session``: the start of the chain of overlapping ``_start`` to ``_stop`` a row belongs to."""
    rows = rows.withColumn("_piece", _piece("_start", _piece_width(rows, series, "_start", "_stop", points, 1e-9)))
    rows = running(rows, series, "_piece", ["_start", "_stop"], {"_reach": ("max", "_stop")}, strict=True)
    fresh = F.when(F.col("_reach").isNull() | (F.col("_start") > F.col("_reach")), F.col("_start"))
    return running(rows, series, "_piece", ["_start", "_stop"], {"_session": ("max", fresh)}).drop("_reach", "_piece")


def _matcher(width: int, onset: int):
    """Arrow function: of pairs in order, those that are matched."""
    def run(batches):
        session = det = None
        done, used, ends = False, set(), []
        for batch in batches:
            mask = []
            cols = [batch.column(width + i).to_pylist() for i in range(4)]
            for s, d, g, until, now in zip(*cols, batch.column(onset).to_pylist()):
                if s != session:
                    session, det, used, ends = s, None, set(), []
                if d != det:
                    det, done = d, False
                    while ends and ends[0][0] < now:             # events that no later detection can meet
                        used.discard(heapq.heappop(ends)[1])
                won = not done and g not in used
                if won:
                    done = True
                    used.add(g)
                    heapq.heappush(ends, (until, g))
                mask.append(won)
            if True in mask:
                yield pa.RecordBatch.from_arrays(batch.columns[:width], schema=pa.schema(list(batch.schema)[:width])).filter(
                    pa.array(mask))

    return run

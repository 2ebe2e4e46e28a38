"""Intersection-based and collar-based operating curves over every score value.

The runs of all thresholds (``runs.score_runs``) make each count a sum of steps over thresholds: a run adds one when the threshold
falls below its smallest score and takes it back when it falls below the score at its border. Running sums of these steps give
every operating point; no threshold grid and no table per threshold is needed.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from earmark.operators import intersection, matching
from earmark.operators.runs import score_runs
from earmark.scale import CHUNK, cut_lineage, join_large, running, value_buckets

WEIGHT = 10 ** 12      # rates of cross triggers are summed as whole numbers, so that sums do not depend on their order


def _steps(rows: DataFrame, keys, amounts: dict) -> DataFrame:
    """``(keys, x, amounts)``: what changes when the threshold falls below ``x``, from rows with ``low`` and ``high``."""
    at = F.explode(F.array(F.struct(F.col("high").alias("x"), F.lit(1).alias("sign")),
                           F.struct(F.col("low").alias("x"), F.lit(-1).alias("sign"))))
    rows = rows.select(*keys, *[c.alias(name) for name, c in amounts.items()], at.alias("_s")).where("_s.x > '-Infinity'")
    return rows.groupBy(*keys, F.col("_s.x").alias("x")).agg(*[F.sum(F.col(name) * F.col("_s.sign")).alias(name) for name in amounts])


def _sums(steps: DataFrame, keys, names) -> DataFrame:
    """Running sums of steps from the highest threshold down."""
    rows = value_buckets(steps, keys, "x", written=True)
    return running(rows, keys, "_bucket", ["x"], {n: ("sum", F.col(n)) for n in names}, backward=True).drop("_bucket")


def _found_steps(passed: DataFrame, ground_truth: DataFrame, gtc_threshold: float, keys) -> DataFrame:
    """``(keys, label, x, tp)``: where events become found or lost as the runs that cover them change."""
    gt = ground_truth.select("clip_id", "label", "onset", "offset", "gt_id")
    det = passed.select(*keys, "clip_id", "label", "onset", "offset", "low", "high")
    pairs = matching.overlap_pairs(det, gt, True)
    cover = matching.ticks(F.least("det_offset", "gt_offset")) - matching.ticks(F.greatest("det_onset", "gt_onset"))
    length = matching.ticks(F.col("gt_offset")) - matching.ticks(F.col("gt_onset"))
    by = [*keys, "clip_id", "label", "gt_id", "_length"]
    steps = cut_lineage(_steps(pairs.withColumn("_length", length), by, {"cover": cover}))
    sums = _sums(steps, by, ["cover"])
    now = (F.col("cover") >= F.lit(float(gtc_threshold)) * F.col("_length")).cast("bigint")
    # a change against the step above: the state above is the running sum without the own step
    rows = join_large(sums, steps.withColumnRenamed("cover", "_own"), [*by, "x"]).withColumn("_now", now).withColumn(
        "_above", (F.col("cover") - F.col("_own") >= F.lit(float(gtc_threshold)) * F.col("_length")).cast("bigint"))
    return rows.where("_now <> _above").groupBy(*keys, "label", "x").agg(F.sum(F.col("_now") - F.col("_above")).alias("tp"))


def operating_points(scores: DataFrame, ground_truth: DataFrame, seconds: DataFrame, dtc_threshold: float, gtc_threshold: float,
                     cttc_threshold: float | None = None, alpha_ct: float = 0.0, keys=(), unit: float = intersection.HOUR,
                     value: str = "score", chunk: int = CHUNK, points: int = matching.POINTS) -> DataFrame:
    """``(keys, label, below, tp, fp, n_sys, n_ref, tpr, efpr)``: counts and rates at thresholds from the next smaller ``below``
    up to, but without, ``below``. Every score value of a class that changes anything is there.

    Meaning of the tolerances and of ``efpr`` as in ``intersection_counts`` and ``effective_rates``; times are compared in whole
    microseconds, so equal shares are equal. ``keys`` are columns of the scores only (such as a candidate). Classes without
    ground truth count false positives only. Clips with up to ``points`` events are covered in one pass each, others in pieces.
    """
    if dtc_threshold <= 0 or gtc_threshold <= 0:
        raise ValueError("tolerance thresholds must be positive")
    keys = list(keys)
    by = [*keys, "clip_id", "label"]
    runs = score_runs(scores, by, value, chunk=chunk)
    cross = cttc_threshold if alpha_ct else None
    large = cut_lineage(ground_truth.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > points).select("clip_id"))
    some_large = not large.isEmpty()
    if some_large:      # the running sums of such clips are cut into pieces; crossed is NULL there
        names = runs.columns
        rest = matching.covered(runs.join(large, "clip_id", "left_semi").select(*names), ground_truth, ["clip_id", "label"], names)
        runs = runs.join(large, "clip_id", "left_anti").select(*names)
        runs = matching.covered_in_clips(runs, ground_truth.join(large, "clip_id", "left_anti"), cross).unionByName(
            rest, allowMissingColumns=True)
    else:
        runs = matching.covered_in_clips(runs, ground_truth, cross)
    runs = cut_lineage(runs.withColumn("passed", intersection.covers(dtc_threshold)))
    failed = (~F.col("passed")).cast("bigint")
    steps = _steps(runs, [*keys, "label"], {"n_sys": F.lit(1), "fp": failed}).withColumn("tp", F.lit(0).cast("bigint")).withColumn(
        "ct", F.lit(0).cast("bigint"))
    tp = _found_steps(runs.where("passed"), ground_truth, gtc_threshold, keys)
    steps = steps.unionByName(tp, allowMissingColumns=True)
    if cross is not None:
        per = ground_truth.groupBy("label").agg((F.sum(F.col("offset") - F.col("onset")) / F.lit(unit)).alias("units"))
        rate = per.select(F.col("label").alias("gt_label"), F.floor(F.lit(float(WEIGHT)) / F.col("units") + 0.5).cast("bigint").alias("ct"))
        lost, bounds = runs.where("not passed"), [*keys, "label", "low", "high"]
        crossed = lost.select(*bounds, F.explode("crossed").alias("gt_label"))
        if some_large:
            rest = lost.where("crossed is null").drop("cover", "crossed", "passed")
            crossed = crossed.unionByName(intersection.crossing(rest, ground_truth, cross).select(*bounds, "gt_label"))
        ct = _steps(crossed.join(rate, "gt_label"), [*keys, "label"], {"ct": F.col("ct")})
        steps = steps.unionByName(ct, allowMissingColumns=True)
    names = ["n_sys", "fp", "tp", "ct"]
    steps = cut_lineage(steps.groupBy(*keys, "label", "x").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]))
    rows = _sums(steps, [*keys, "label"], names)
    n_ref = ground_truth.groupBy("label").agg(F.count(F.lit(1)).alias("n_ref"))
    others = n_ref.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("n")).scalar()
    rows = rows.join(n_ref, "label", "left").withColumns({"seconds": seconds.scalar(), "_others": others}).na.fill(0, ["n_ref"])
    efpr = (F.try_divide(F.col("fp"), F.col("seconds") / F.lit(unit))
            + F.lit(float(alpha_ct)) * F.col("ct") / F.lit(float(WEIGHT)) / F.col("_others"))
    return rows.select(*keys, "label", F.col("x").alias("below"), "tp", "fp", "n_sys", "n_ref",
                       (F.col("tp") / F.greatest("n_ref", F.lit(1))).alias("tpr"), efpr.alias("efpr"))


def exact_psd_roc(points: DataFrame, max_efpr: float = 100.0, keys=()) -> DataFrame:
    """Steps of the staircase per class: ``efpr, tpr, until`` where ``tpr`` is above all at smaller ``efpr``; ``before`` is the
    height left of the step. Classes may have any number of points: windows hold pieces of equal size."""
    by = [*keys, "label"]
    best = points.where(F.col("efpr") <= float(max_efpr)).groupBy(*by, "efpr").agg(F.max("tpr").alias("tpr"))
    rows = running(value_buckets(best, by, "efpr"), by, "_bucket", ["efpr"], {"before": ("max", "tpr")}, strict=True)
    rows = cut_lineage(rows.withColumn("before", F.coalesce("before", F.lit(0.0))).where("tpr > before"))
    rows = running(rows, by, "_bucket", ["efpr"], {"until": ("min", "efpr")}, backward=True, strict=True)
    return cut_lineage(rows.select(*by, "efpr", "tpr", F.coalesce("until", F.lit(float(max_efpr))).alias("until"), "before"))


def exact_psds(scores: DataFrame, ground_truth: DataFrame, seconds: DataFrame, dtc_threshold: float, gtc_threshold: float,
               cttc_threshold: float | None = None, alpha_ct: float = 0.0, alpha_st: float = 0.0, max_efpr: float = 100.0,
               keys=(), unit: float = intersection.HOUR, value: str = "score", chunk: int = CHUNK):
    """``(psds, class areas)`` over every score value."""
    keys = list(keys)
    points = operating_points(scores, ground_truth, seconds, dtc_threshold, gtc_threshold, cttc_threshold, alpha_ct, keys, unit, value, chunk)
    roc = exact_psd_roc(points, max_efpr, keys)
    labels = ground_truth.select("label").distinct()
    n = labels.agg(F.count(F.lit(1)).alias("n_classes"))
    if keys:
        labels = scores.select(*keys, "label").distinct()
    return intersection.psds(roc, n, alpha_st, max_efpr, keys), intersection.staircase_auc(roc, max_efpr, keys, labels)


# ---------------------------------------------------------------- collar based

class _Session:
    """Matching of one chain of candidate pairs while the threshold falls.

    A pair is ``(start, stop, det, gt, on, off)`` with ``det`` = (onset, offset) and ``gt`` = (onset, offset, number); ``on`` and
    ``off`` are distances. Where runs appear or vanish, the pairs that hang together with theirs are matched again; pairs farther
    away keep their result.
    """

    def __init__(self):
        self.alive, self.matched, self.longest = [], set(), 0.0

    def change(self, gone, new):
        """``(matches, on, off)`` gained by taking pairs away and adding others."""
        for p in gone:
            del self.alive[bisect_left(self.alive, p)]
        for p in new:
            insort(self.alive, p)
            self.longest = max(self.longest, p[1] - p[0])
        spots = sorted((p[0], p[1]) for p in (*gone, *new))
        gained = [0, 0, 0]
        while spots:
            low, high = spots.pop()
            near, reach = [], None
            while reach != (low, high):                      # what overlaps, and what overlaps that
                reach = low, high
                at = bisect_left(self.alive, (low - self.longest,))
                near = []
                while at < len(self.alive) and self.alive[at][0] <= high:
                    if self.alive[at][1] >= low:
                        near.append(self.alive[at])
                        low, high = min(low, near[-1][0]), max(high, near[-1][1])
                    at += 1
                for spot in [p for p in spots if p[0] <= high and p[1] >= low]:
                    spots.remove(spot)
                    low, high = min(low, spot[0]), max(high, spot[1])
            before = [p for p in self.matched if p[0] <= high and p[1] >= low]
            after = _match(near)
            self.matched.difference_update(before)
            self.matched.update(after)
            for sign, some in ((-1, before), (1, after)):
                gained[0] += sign * len(some)
                gained[1] += sign * sum(p[4] for p in some)
                gained[2] += sign * sum(p[5] for p in some)
        return gained


def _match(pairs):
    """Detections in order of time take the free event with the earliest deadline, as ``matching.one_to_one``."""
    last: dict = {}
    for p in pairs:
        last[p[3]] = max(last.get(p[3], p[2]), p[2])
    out, used, done = [], set(), set()
    for p in sorted(pairs, key=lambda p: (p[2], last[p[3]], p[3])):
        if p[2] not in done and p[3] not in used:
            done.add(p[2])
            used.add(p[3])
            out.append(p)
    return out


def _session_steps(rows):
    """``(x, matches, on, off)`` of a session: rows are ``(high, low, det_on, det_off, gt_on, gt_off, gt number, on, off)``."""
    changes: dict = {}
    for high, low, d_on, d_off, g_on, g_off, g, on, off in rows:
        pair = (min(d_on, g_on), max(d_on, g_on), (d_on, d_off), (g_on, g_off, g), on, off)
        changes.setdefault(high, ([], []))[1].append(pair)
        if low > float("-inf"):
            changes.setdefault(low, ([], []))[0].append(pair)
    session = _Session()
    for x in sorted(changes, reverse=True):
        yield x, *session.change(*changes[x])


def collar_steps(runs: DataFrame, ground_truth: DataFrame, onset_collar: float, offset_collar: float, offset_collar_rate: float,
                 keys=(), gt_id=("clip_id", "label", "gt_id")) -> DataFrame:
    """``(keys, label, x, tp, onset_ticks, offset_ticks)``: how matches change when the threshold falls below ``x``."""
    series = [*keys, "clip_id", "label"]
    pairs = matching.collar_pairs(runs, ground_truth, onset_collar, offset_collar, offset_collar_rate)
    pairs = cut_lineage(pairs.withColumns({"_start": F.least("det_onset", "gt_onset"), "_stop": F.greatest("det_onset", "gt_onset")}))
    rows = matching.sessions(pairs, series)
    own = [c for c in gt_id if c not in series]
    rows = rows.withColumn("_s", F.xxhash64(*series, "_session")).repartition(*series, "_session").sortWithinPartitions(
        *series, "_session", "gt_onset", "gt_offset", *own)
    names = [*keys, "label"]
    rows = rows.select(*names, "_s", "high", "low", "det_onset", "det_offset", "gt_onset", "gt_offset", F.xxhash64(*gt_id).alias("_gt"),
                       matching.ticks(F.col("onset_dist")).alias("_on"), matching.ticks(F.col("offset_dist")).alias("_off"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    n = len(names)

    def run(batches):
        held = None
        for batch in _and_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            table = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
            if table is None:
                return
            ids = table.column(n).to_numpy(zero_copy_only=False)
            cuts = [0, *((ids[1:] != ids[:-1]).nonzero()[0] + 1).tolist(), len(ids)]
            if batch is not None:
                held = table.slice(cuts[-2])
                cuts.pop()
            first, out = [], []
            cols = [table.column(i).to_pylist() for i in range(n + 1, n + 10)]
            for a, b in zip(cuts, cuts[1:]):
                numbers: dict = {}
                gt = [numbers.setdefault(g, len(numbers)) for g in cols[6][a:b]]
                for step in _session_steps(zip(*(c[a:b] for c in cols[:6]), gt, cols[7][a:b], cols[8][a:b])):
                    first.append(a)
                    out.append(step)
            if out:
                x, tp, on, off = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*(table.column(i).take(pa.array(first)) for i in range(n)), pa.array(x), pa.array(tp, pa.int64()),
                     pa.array(on, pa.int64()), pa.array(off, pa.int64())], names=[*names, "x", "tp", "onset_ticks", "offset_ticks"])

    return rows.mapInArrow(run, f"{kinds}, x double, tp bigint, onset_ticks bigint, offset_ticks bigint").groupBy(*names, "x").agg(
        *[F.sum(c).alias(c) for c in ("tp", "onset_ticks", "offset_ticks")])


def _and_end(batches):
    yield from batches
    yield None


def exact_collar_curve(scores: DataFrame, ground_truth: DataFrame, onset_collar: float = 0.2, offset_collar: float = 0.2,
                       offset_collar_rate: float = 0.2, keys=(), gt_id=("clip_id", "label", "gt_id"), value: str = "score",
                       chunk: int = CHUNK) -> DataFrame:
    """``(keys, label, above, below, tp, n_sys, n_ref, onset_bias, offset_bias)``: at thresholds ``above <= t < below``.

    One row per distinct score of a class and one, with ``below`` infinite, where nothing is detected; ``above`` is minus infinity
    for the smallest score. Matching as in ``matching.one_to_one``, which is largest here as runs of one threshold do not overlap.
    """
    keys = list(keys)
    by = [*keys, "label"]
    runs = cut_lineage(score_runs(scores, [*keys, "clip_id", "label"], value, chunk=chunk))
    names = ["n_sys", "tp", "onset_ticks", "offset_ticks"]
    steps = _steps(runs, by, {"n_sys": F.lit(1)}).unionByName(
        collar_steps(runs, ground_truth, onset_collar, offset_collar, offset_collar_rate, keys, gt_id), allowMissingColumns=True)
    steps = cut_lineage(steps.groupBy(*by, "x").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]))
    rows = value_buckets(steps, by, "x", written=True)
    rows = running(rows, by, "_bucket", ["x"], {"_above": ("max", "x")}, strict=True)
    rows = running(rows, by, "_bucket", ["x"], {n: ("sum", F.col(n)) for n in names}, backward=True)
    none = rows.groupBy(*by).agg(F.max("x").alias("_above")).withColumn("x", F.lit(float("inf")))
    rows = rows.select(*by, "_above", "x", *names).unionByName(none, allowMissingColumns=True).na.fill(0, names)
    n_ref = ground_truth.groupBy("label").agg(F.count(F.lit(1)).alias("n_ref"))
    some = F.greatest("tp", F.lit(1)) * F.lit(float(matching.TICK))
    return rows.join(n_ref, "label", "left").na.fill(0, ["n_ref"]).select(
        *by, F.coalesce("_above", F.lit(float("-inf"))).alias("above"), F.col("x").alias("below"), "tp", "n_sys", "n_ref",
        (F.col("onset_ticks") / some).alias("onset_bias"), (F.col("offset_ticks") / some).alias("offset_bias"))


def exact_collar_best_fscore(scores: DataFrame, ground_truth: DataFrame, onset_collar: float = 0.2, offset_collar: float = 0.2,
                             offset_collar_rate: float = 0.2, min_precision: float = 0.0, min_recall: float = 0.0, keys=(),
                             gt_id=("clip_id", "label", "gt_id"), value: str = "score", chunk: int = CHUNK) -> DataFrame:
    """Best collar-based F-score per class over all thresholds: ``threshold, fscore, precision, recall, onset_bias, offset_bias``.

    The threshold lies in the middle between two scores, or is infinite if no threshold keeps the required precision and recall
    and yields a match; of equal scores the larger threshold wins.
    """
    keys = list(keys)
    curve = exact_collar_curve(scores, ground_truth, onset_collar, offset_collar, offset_collar_rate, keys, gt_id, value, chunk)
    p = F.col("tp") / F.greatest(F.col("n_sys"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("n_ref"), F.lit(1))
    f = F.lit(2.0) * p * r / F.greatest(p + r, F.lit(1e-15))
    f = F.when((p < min_precision) | (r < min_recall), F.lit(0.0)).otherwise(f)
    threshold = F.when(F.col("below") == float("inf"), F.col("below")).otherwise((F.col("above") + F.col("below")) / 2)
    best = F.max_by(F.struct(threshold.alias("threshold"), f.alias("fscore"), p.alias("precision"), r.alias("recall"),
                             "onset_bias", "offset_bias"), F.struct(f.alias("f"), threshold.alias("t")))
    return curve.groupBy(*keys, "label").agg(best.alias("b")).select(*keys, "label", "b.*")

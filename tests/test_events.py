import math
import random

import pytest
from pyspark.sql import functions as F

from earmark.operators import collar, detect, intersection, matching, tuning
from earmark.scale import cut_lineage
from tests.test_filters import frames, random_series

IV = "clip_id string, label string, onset double, offset double, "


def intervals(seed, n, clips=2, labels="ab", span=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        on = round(rng.uniform(0, span), 2)
        out.append((f"c{rng.randrange(clips)}", rng.choice(labels), on, round(on + rng.uniform(.1, 6), 2), i))
    return out


def candidates(det, gt, c, oc, rate):
    out = {}
    for d in det:
        near = [g for g in gt if d[:2] == g[:2] and abs(d[2] - g[2]) <= c and abs(d[3] - g[3]) <= max(oc, rate * (g[3] - g[2]))]
        if near:
            out[d] = near
    return out


def in_time(pairs):
    """Detections in order of time take the free event that has the earliest last candidate."""
    last, used, out = {}, set(), set()
    for d, near in pairs.items():
        for g in near:
            last[g] = max(last.get(g, (0,)), (d[2], d[3], d[4]))
    for d in sorted(pairs, key=lambda d: (d[2], d[3], d[4])):
        free = [g for g in pairs[d] if g not in used]
        if free:
            g = min(free, key=lambda g: (last[g], g[2], g[3], g[4]))
            used.add(g), out.add((d[4], g[4]))
    return out


def largest(pairs):
    """Size of a largest matching by augmenting paths."""
    owner = {}

    def place(d, seen):
        for g in pairs[d]:
            if g not in seen:
                seen.add(g)
                if g not in owner or place(owner[g], seen):
                    owner[g] = d
                    return True
        return False

    return sum(place(d, set()) for d in pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_to_one_in_order_of_time(spark, seed):
    det, gt = intervals(seed, 120), intervals(seed + 50, 120)
    d = spark.createDataFrame(det, IV + "det_id int")
    g = spark.createDataFrame(gt, IV + "gt_id int")
    pairs = matching.collar_pairs(d, g, 2.0, 1.5, .5)
    want = in_time(candidates(det, gt, 2.0, 1.5, .5))
    for points in (matching.POINTS, 5):
        got = matching.one_to_one(pairs, ["det_id"], ["gt_id"], points=points)
        assert got.columns == pairs.columns and {(r.det_id, r.gt_id) for r in got.collect()} == want
    assert len(want) > 20


def test_one_to_one_is_largest_without_overlaps(spark):
    rng = random.Random(4)
    det, gt, n = [], [], 0
    for clip in range(60):
        for out in (det, gt):
            t = 0.0
            for _ in range(rng.randint(0, 25)):
                t += rng.choice([0, 0, .3, 1.0])
                end = t + rng.choice([.1, .2, .5, 1.5])
                out.append((f"c{clip}", "a", round(t, 3), round(end, 3), n := n + 1))
                t = end
    d, g = spark.createDataFrame(det, IV + "det_id int"), spark.createDataFrame(gt, IV + "gt_id int")
    got = matching.one_to_one(matching.collar_pairs(d, g, .6, .5, .3), ["det_id"], ["gt_id"])
    assert got.count() == largest(candidates(det, gt, .6, .5, .3)) > 100
    assert matching.one_to_one(matching.collar_pairs(d.where("false"), g, .6, .5, .3), ["det_id"], ["gt_id"]).count() == 0


def test_long_chains_take_no_more_jobs(spark):
    """Every detection lies between two events, so one chain joins them all."""
    def matched(n):
        det = spark.range(n).selectExpr("'c' clip_id", "'a' label", "id + 0.5 onset", "id + 1.5 offset", "id det_id")
        gt = spark.range(n + 1).selectExpr("'c' clip_id", "'a' label", "cast(id as double) onset", "cast(id + 1 as double) offset", "id gt_id")
        group = f"chain-{n}"
        spark.sparkContext.setJobGroup(group, group)
        size = matching.one_to_one(matching.collar_pairs(det, gt, .6, .6), ["det_id"], ["gt_id"], points=1000).count()
        spark.sparkContext.setJobGroup("other", "other")
        return size, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (small, few), (large, many) = matched(10), matched(10_000)
    assert (small, large) == (10, 10_000) and many <= few + 6        # adaptive execution may split off a job or two


def test_covered_lengths(spark):
    det, gt = intervals(8, 90), intervals(9, 70) + [("c0", "a", 1.0, 1.0, 99)]
    d = spark.createDataFrame(det + [("c9", "a", 0.0, 1.0, 100), ("c0", "a", 3.0, 3.0, 101)], IV + "det_id int")
    g = spark.createDataFrame(gt, IV + "gt_id int")
    for points in (matching.POINTS, 3):
        got = {r.det_id: r.cover for r in matching.covered(d, g, ["clip_id", "label"], d.columns, points).collect()}
        want = {x[4]: round(sum(max(0.0, min(x[3], y[3]) - max(x[2], y[2])) for y in gt if y[:2] == x[:2]) * matching.TICK) for x in det}
        assert got == want | {100: 0, 101: 0}
    assert {r.cover for r in matching.covered(d, g.where("false"), ["clip_id", "label"], d.columns).collect()} == {0}


def test_clips_are_covered_in_one_shuffle(spark):
    rng = random.Random(4)
    gt = [(f"c{rng.randint(0, 5)}", rng.choice("abc"), float(o := rng.randint(0, 40)), o + float(rng.randint(0, 9))) for _ in range(120)]
    det = [(f"c{rng.randint(0, 7)}", rng.choice("abcd"), float(o := rng.randint(0, 40)), o + float(rng.randint(0, 9)), i) for i in range(150)]
    g = spark.createDataFrame(gt + [(None, "a", 0.0, 50.0)], "clip_id string, label string, onset double, offset double")
    d = spark.createDataFrame(det + [(None, "a", 0.0, 3.0, 150), (None, "b", 0.0, 3.0, 151)],
                              "clip_id string, label string, onset double, offset double, det_id int")
    out = matching.covered_in_clips(d, g, .5)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {r.det_id: (r.cover, sorted(r.crossed)) for r in out.collect()}
    for c, l, a, b, i in det:
        sums = {o: sum(max(0, min(b, y) - max(a, x)) for cc, ll, x, y in gt if (cc, ll) == (c, o)) for o in "abcd"}
        assert got[i] == (sums[l] * 10**6, [o for o in "abcd" if o != l and b > a and sums[o] >= .5 * (b - a)])
    assert got[150] == (3 * 10**6, []) and got[151] == (0, []) and len(got) == 152
    assert {r.cover for r in matching.covered_in_clips(d, g.where("false"), .5).collect()} == {0}


def test_more_series_do_not_narrow_pieces(spark):
    """Pieces follow the largest series, so that short series stay whole however many there are."""
    rows = spark.range(3000).selectExpr("id % 300 as clip_id", "cast(id div 300 as double) as _start", "id div 300 + 1.0 as _stop")

    def width(df):
        return df.select(matching._piece_width(df, ["clip_id"], "_start", "_stop", 10, 1e-9).alias("w")).first().w

    assert width(rows) is None
    long = spark.range(100).selectExpr("-1L as clip_id", "cast(id as double) as _start", "id + 1.0 as _stop")
    assert width(rows.unionByName(long)) == 10.0


@pytest.mark.parametrize("width", [None, .5, 3.0, 100.0])
def test_overlap_pairs(spark, width):
    det, gt = intervals(3, 80), intervals(4, 60)
    d, g = spark.createDataFrame(det, IV + "det_id int"), spark.createDataFrame(gt, IV + "gt_id int")
    for same in (True, False):
        got = matching.overlap_pairs(d, g, same, width).collect()
        want = {(x[4], y[4]): min(x[3], y[3]) - max(x[2], y[2]) for x in det for y in gt
                if x[0] == y[0] and (x[1] == y[1]) == same and x[2] < y[3] and y[2] < x[3]}
        assert {(r.det_id, r.gt_id): pytest.approx(r.overlap) for r in got} == want
        assert len(got) == len(want)


def test_intervals_without_length_meet_what_holds_them(spark):
    det = intervals(3, 40) + [("c0", "a", 5.0, 5.0, 100), ("c1", "b", 20.0, 20.0, 101), ("c0", "a", 200.0, 200.0, 102)]
    gt = intervals(4, 40) + [("c0", "a", 4.0, 6.0, 200), ("c0", "a", 5.0, 9.0, 201), ("c1", "a", 20.0, 20.0, 202), ("c1", "b", 19.0, 21.0, 203)]
    gt += [(c, l, float(i), float(i), 300 + i) for i in range(35) for c, l in (("c0", "b"),)]
    d, g = spark.createDataFrame(det, IV + "det_id int"), spark.createDataFrame(gt, IV + "gt_id int")
    for same in (True, False):
        got = {(r.det_id, r.gt_id): pytest.approx(r.overlap) for r in matching.overlap_pairs(d, g, same).collect()}
        assert got == {(x[4], y[4]): min(x[3], y[3]) - max(x[2], y[2]) for x in det for y in gt
                       if x[0] == y[0] and (x[1] == y[1]) == same and x[2] < y[3] and y[2] < x[3]}
        assert {k: v for k, v in got.items() if 99 < k[0] or 299 < k[1]}


def test_events_without_length_are_found(spark):
    det = [(0.0, "c", "a", 0.0, 10.0, 1), (0.0, "c", "a", 20.0, 21.0, 2)]
    gt = [("c", "a", 1.0, 3.0, 1), ("c", "a", 5.0, 5.0, 2), ("c", "a", 10.0, 10.0, 3), ("c", "a", 20.5, 20.5, 4)]
    d = spark.createDataFrame(det, "threshold double, " + IV + "det_id int")
    counts, _ = intersection.intersection_counts(d, spark.createDataFrame(gt, IV + "gt_id int"), .1, .1)
    r = counts.first()         # the second detection is false: nothing covers a tenth of it
    assert (r.tp, r.fp, r.n_ref) == (2, 1, 4)


def test_shares_are_not_cut_to_ticks(spark):
    """Shares just below a tenth, by less than a millionth of the unit."""
    d = spark.createDataFrame([(0.0, "c", "a", 0.0, 1.0, 1), (0.0, "d", "a", 0.0, 1.0, 2)], "threshold double, " + IV + "det_id int")
    g = spark.createDataFrame([("c", "a", 0.0, .1 - 3e-7, 1), ("d", "a", 0.0, .1, 2)], IV + "gt_id int")
    r = intersection.intersection_counts(d, g, .1, .1)[0].first()
    assert (r.tp, r.fp) == (1, 1)


def psds_brute(series, gt, hours, thresholds, dtc, gtc, cttc, alpha_ct, alpha_st, max_efpr):
    labels = sorted({g[1] for g in gt})
    gt_hours = {l: sum(g[3] - g[2] for g in gt if g[1] == l) for l in labels}
    points = {l: [] for l in labels}
    from tests.test_filters import runs
    for t in thresholds:
        det = [(c, l, *r) for (c, l), x in series.items() for r in runs(x, t)]
        ov = lambda d, g: max(0.0, min(d[3], g[3]) - max(d[2], g[2])) if d[0] == g[0] else 0.0
        ok = {d: round(sum(ov(d, g) for g in gt if g[1] == d[1]) / (d[3] - d[2]), 9) >= dtc for d in det}
        for l in labels:
            mine = [d for d in det if d[1] == l]
            if not mine:
                continue
            tp = sum(round(sum(ov(d, g) for d in mine if ok[d]) / (g[3] - g[2]), 9) >= gtc for g in gt if g[1] == l)
            fps = [d for d in mine if not ok[d]]
            ctr = [sum(round(sum(ov(d, g) for g in gt if g[1] == o) / (d[3] - d[2]), 9) >= cttc for d in fps) / gt_hours[o]
                   for o in labels if o != l]
            efpr = len(fps) / hours + alpha_ct * sum(ctr) / max(len(ctr), 1)
            points[l].append((efpr, tp / max(sum(g[1] == l for g in gt), 1)))

    def at(l, e):
        return max([y for x, y in points[l] if x <= e], default=0.0)

    xs = sorted({x for p in points.values() for x, _ in p if x <= max_efpr}) + [max_efpr]
    area = 0.0
    for a, b in zip(xs, xs[1:]):
        ys = [at(l, a) for l in labels]
        mu = sum(ys) / len(ys)
        sd = (sum((y - mu) ** 2 for y in ys) / len(ys)) ** .5
        area += max(mu - alpha_st * sd, 0.0) * (b - a)
    auc = {l: sum(at(l, a) * (b - a) for a, b in zip(xs, xs[1:])) / max_efpr for l in labels}
    return area / max_efpr, auc


@pytest.mark.parametrize("alpha_ct, alpha_st, cttc", [(0.0, 1.0, None), (.5, 1.0, .3), (.5, 0.0, .3)])
def test_psds_brute_force(spark, alpha_ct, alpha_st, cttc):
    rng = random.Random(9)
    series = {(f"c{c}", l): [rng.random() * (.4 + .6 * (i // 5 % 2)) for i in range(40)] for c in range(4) for l in "abc"}
    gt = [(f"c{c}", l, round((5 + 10 * i) * .02, 6), round((10 + 10 * i) * .02, 6)) for c in range(4) for l in "abc" for i in range(4)
          if rng.random() < .8]
    thresholds = [.1, .3, .5, .7, .8]
    g = spark.createDataFrame([(*x, i) for i, x in enumerate(gt)], IV + "gt_id int")
    seconds = spark.createDataFrame([(3.2,)], "seconds double")
    got, auc = intersection.approximate_psds(frames(spark, series), g, seconds, .4, .4, cttc, alpha_ct, alpha_st, 40.0, thresholds, unit=1.0)
    want, want_auc = psds_brute(series, gt, 3.2, thresholds, .4, .4, cttc or 9.0, alpha_ct, alpha_st, 40.0)
    assert got.first()["psds"] == pytest.approx(want, abs=1e-9)
    assert {r.label: pytest.approx(r.auc, abs=1e-9) for r in auc.collect()} == want_auc


def test_collar_best_fscore(spark):
    series = random_series(7, (50, 60, 40))
    truth = detect.score_intervals(frames(spark, series), .3)
    gt = truth.select("clip_id", "label", "onset", "offset", F.col("onset").alias("gt_id"))
    best = collar.collar_best_fscore(frames(spark, series), gt, [-.5, .3, .9], .001, .001, 0.0).first()
    assert (best.threshold, best.fscore, best.onset_bias) == (.3, 1.0, 0.0)
    none = collar.collar_best_fscore(frames(spark, series), gt, [-.5, .9], .001, .001, 0.0, min_precision=1.1).first()
    assert (none.threshold, none.fscore) == (.9, 0.0)


def test_leaderboard_ties_take_the_later_candidate(spark):
    rows = [("f", "a", .5, 0), ("f", "a", .5, 2), ("f", "a", .4, 3), ("f", "b", .1, 0)]
    df = spark.createDataFrame(rows, "metric string, label string, value double, candidate_id int")
    got = {r.label: (r.value, r.candidate_id) for r in tuning.leaderboard(df).collect()}
    assert got == {"a": (.5, 2), "b": (.1, 0)}
    low = {r.label: (r.value, r.candidate_id) for r in tuning.leaderboard(df, minimize=True).collect()}
    assert low == {"a": (.4, 3), "b": (.1, 0)}
    merged = tuning.leaderboard(tuning.leaderboard(df).unionByName(
        spark.createDataFrame([("f", "b", .1, 7)], "metric string, label string, value double, candidate_id int")))
    assert {r.label: r.candidate_id for r in merged.collect()} == {"a": 2, "b": 7}
    macro = tuning.macro_average(tuning.leaderboard(df)).where("label = 'macro_average'").first()
    assert macro.value == pytest.approx(.3)


def test_long_runs_stay_in_few_bins(spark):
    det = spark.createDataFrame([("c", "a", 0.0, 1e6, 1), ("c", "a", 10.0, 10.2, 2)], "clip_id string, label string, onset double, offset double, det_id int")
    gt = spark.createDataFrame([("c", "a", float(i), i + .1, i) for i in range(0, 1000, 10)],
                               "clip_id string, label string, onset double, offset double, gt_id int")
    got = matching.overlap_pairs(det, gt)
    assert sorted((r.det_id, r.gt_id) for r in got.collect()) == [(1, i) for i in range(0, 1000, 10)] + [(2, 10)]
    # rows that the join reads: at most three bins on each level, whatever the length of a run
    levels = math.ceil(math.log(1000 / .2, matching.GROW)) + 1
    spread = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in spread and levels <= 8


def test_growing_tables_are_not_broadcast(spark):
    """Files of few bytes a row look small to the planner; their joins shuffle all the same."""
    det = cut_lineage(spark.range(2000).selectExpr("string(id % 7) clip_id", "'a' label", "id * 1d onset", "id * 1d + .5 offset", "id det_id"))
    gt = cut_lineage(det.withColumnRenamed("det_id", "gt_id"))
    collar_pairs = matching.collar_pairs(det, gt, 0.2, 0.2)
    counts, crossed = intersection.intersection_counts(det.withColumn("threshold", F.lit(0.5)), gt, 0.5, 0.5, 0.3)
    for df in (collar_pairs, matching.overlap_pairs(det, gt), matching.one_to_one(collar_pairs, ["det_id"], ["gt_id"]), crossed):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert collar_pairs.count() == 2000 and [r.tp for r in counts.collect()] == [2000]

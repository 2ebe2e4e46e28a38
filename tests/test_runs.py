"""Runs of all thresholds, exact operating curves and matching against brute force."""

import math
import random

import pytest

from earmark.operators import collar, exact, runs
from tests.test_events import IV, psds_brute
from tests.test_filters import frames


def brute_runs(frames, scores):
    """Every run with its range of thresholds, by trying all thresholds."""
    found = {}
    levels = sorted({-math.inf, *(s for s in scores if s is not None)})
    for t in levels:
        start = None
        for i in range(len(frames) + 1):
            up = i < len(frames) and scores[i] is not None and scores[i] > t
            if start is not None and (not up or frames[i] != frames[i - 1] + 1):
                found.setdefault((frames[start], frames[i - 1] + 1), []).append(t)
                start = None
            if up and start is None:
                start = i
    above = {t: (levels + [math.inf])[i + 1] for i, t in enumerate(levels)}
    return sorted((a, b, min(ts), above[max(ts)]) for (a, b), ts in found.items())


def series(rng, n, values):
    frames, at = [], 0
    for _ in range(n):
        at += rng.choice([1] * 12 + [2, 5])
        frames.append(at - 1)
    return frames, [rng.choice(values) for _ in range(n)]


@pytest.mark.parametrize("chunk", [4, 16, 8192])
def test_runs_match_brute_force(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], {}
    for clip in range(12):
        label = None if clip == 3 else "a"
        values = [None, *range(rng.choice([3, 9, 40]))] if clip % 2 else [k / 8 for k in range(30)]
        frames, scores = series(rng, rng.choice([1, 7, 60, 150]), values)
        if clip == 5:
            scores = sorted(range(len(frames)), reverse=True)
        if clip == 6:
            frames, scores = list(range(100)), list(range(100))
        if clip == 7:
            frames, scores = list(range(64)), [5] * 64
        rows += [(str(clip), label, f, float(f), f + 1.0, None if s is None else float(s)) for f, s in zip(frames, scores)]
        want[str(clip)] = brute_runs(frames, scores)
    df = spark.createDataFrame(rows, "clip_id string, label string, frame long, onset double, offset double, score double").repartition(5)
    got = {}
    for r in runs.score_runs(df, chunk=chunk).collect():
        got.setdefault(r.clip_id, []).append((r.onset, r.offset, r.low, r.high))
    for clip, w in want.items():
        assert sorted(got.get(clip, [])) == w, clip
    assert runs.score_runs(df.where("false"), chunk=chunk).count() == 0


def scored(seed, n_clips=4, n=40, levels=None):
    rng = random.Random(seed)

    def value(i):
        x = rng.random() * (.4 + .6 * (i // 5 % 2))
        return round(x * levels) / levels if levels else x

    out = {(f"c{c}", l): [value(i) for i in range(n)] for c in range(n_clips) for l in "abc"}
    gt = [(f"c{c}", l, round((5 + 10 * i) * .02, 6), round((10 + 10 * i) * .02, 6)) for c in range(n_clips) for l in "abc" for i in range(4)
          if rng.random() < .8]
    return out, gt


@pytest.mark.parametrize("alpha_ct, alpha_st, cttc, chunk, levels", [(0.0, 1.0, None, 8192, None), (.5, 1.0, .3, 16, 20), (.5, 0.0, .3, 8192, 20)])
def test_exact_psds_equals_every_threshold(spark, alpha_ct, alpha_st, cttc, chunk, levels):
    series, gt = scored(9, levels=levels)
    g = spark.createDataFrame([(*x, i) for i, x in enumerate(gt)], IV + "gt_id int")
    seconds = spark.createDataFrame([(3.2,)], "seconds double")
    got, auc = exact.exact_psds(frames(spark, series), g, seconds, .4, .4, cttc, alpha_ct, alpha_st, 40.0, unit=1.0, chunk=chunk)
    every = sorted({-1.0, *(s for x in series.values() for s in x)})
    want, want_auc = psds_brute(series, gt, 3.2, every, .4, .4, cttc or 9.0, alpha_ct, alpha_st, 40.0)
    assert got.first()["psds"] == pytest.approx(want, abs=1e-9)
    assert {r.label: pytest.approx(r.auc, abs=1e-9) for r in auc.collect()} == want_auc


def test_points_are_the_same_in_clips_and_in_pieces(spark):
    series, gt = scored(5, levels=20)
    g = spark.createDataFrame([(*x, i) for i, x in enumerate(gt)], IV + "gt_id int").where("clip_id > 'c0' or onset < .2")
    seconds = spark.createDataFrame([(3.2,)], "seconds double")
    got = [sorted(map(tuple, exact.operating_points(frames(spark, series), g, seconds, .4, .4, .3, .5, unit=1.0, points=n).collect()))
           for n in (0, 5, 100)]         # all clips, some and none in pieces
    assert got[0] == got[1] == got[2] and any(r[3] for r in got[0])


@pytest.mark.parametrize("min_precision, min_recall", [(0.0, 0.0), (.5, .1), (1.1, 0.0)])
def test_exact_collar_fscore_equals_every_threshold(spark, min_precision, min_recall):
    series, gt = scored(3, n_clips=3, levels=25)
    g = spark.createDataFrame([(*x, i) for i, x in enumerate(gt)], IV + "gt_id int")
    every = sorted({s for x in series.values() for s in x})
    grid = [-1.0, *((a + b) / 2 for a, b in zip(every, every[1:])), 9.0]
    s = frames(spark, series)
    want = {r.label: r for r in collar.collar_best_fscore(s, g, grid, .05, .05, .2, min_precision, min_recall).collect()}
    got = exact.exact_collar_best_fscore(s, g, .05, .05, .2, min_precision, min_recall).collect()
    assert {r.label for r in got} == set(want)
    for r in got:
        w = want[r.label]
        assert r.fscore == pytest.approx(w.fscore, abs=1e-12)
        if min_precision > 1:
            assert r.threshold == math.inf
        else:
            assert r.threshold == pytest.approx(math.inf if w.threshold == 9.0 else w.threshold) and r.precision == pytest.approx(w.precision)
            assert r.onset_bias == pytest.approx(w.onset_bias, abs=1e-5) and r.offset_bias == pytest.approx(w.offset_bias, abs=1e-5)


def test_sessions_match_again_only_nearby():
    rng = random.Random(2)
    for _ in range(60):
        pairs = []
        for _ in range(25):
            d, g = rng.randint(0, 60) / 2, None
            g = d + rng.choice([-.5, 0, .5])
            pairs.append((min(d, g), max(d, g), (d, d + 1.0), (g, g + 1.0, int(g * 2)), 1, 1))
        pairs = sorted(set(pairs))
        session, alive, size = exact._Session(), [], 0
        for _ in range(20):
            gone = [p for p in alive if rng.random() < .2]
            new = [p for p in pairs if p not in alive and rng.random() < .2]
            alive = sorted([p for p in alive if p not in gone] + new)
            size += session.change(gone, new)[0]
            assert size == len(exact._match(alive)) and session.matched == set(exact._match(alive))

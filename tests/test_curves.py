import math
import random

import pytest

from earmark.operators import curves, instance

# fixed values: published example
TARGETS = [1, 1, 0, 1, 0, 0, 0, 0, 0]
SCORES = [0.6, 0.2, 0.5, 0.4, 0.3, 0.1, 0.7, 0.0, 0.0]
INF = math.inf


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([("a", float(t), s) for t, s in zip(TARGETS, SCORES)], "label string, target double, score double")


def table(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(cols[0]).collect()]


def approx(rows):
    return [tuple(pytest.approx(x, abs=1e-6) if isinstance(x, float) else x for x in r) for r in rows]


def test_fscore_curve(scored):
    got = table(curves.fscore_curve(scored), "threshold", "fscore", "precision", "recall")
    want = list(zip([-INF, .05, .15, .25, .35, .45, .55, .65, INF],
                    [.5, .6, .66666667, .5, .57142857, .33333333, .4, 0., 0.],
                    [.33333333, .42857143, .5, .4, .5, .33333333, .5, 0., 0.],
                    [1., 1., 1., .66666667, .66666667, .33333333, .33333333, 0., 0.]))
    assert got == approx(want)


@pytest.mark.parametrize("kw, want", [
    ({}, (.15, .66666667, .5, 1.)), ({"min_precision": .5}, (.15, .66666667, .5, 1.)),
    ({"min_recall": 1.}, (.15, .66666667, .5, 1.)), ({"min_precision": .51}, (INF, 0., 0., 0.))])
def test_best_fscore(scored, kw, want):
    best = curves.best_fscore(curves.fscore_curve(scored), **kw)
    assert table(best, "threshold", "fscore", "precision", "recall") == approx([want])


def test_best_fscore_with_biases(scored):
    best = curves.best_fscore(curves.fscore_curve(scored, tp_bias=1, n_ref_bias=1, n_pos_bias=1))
    assert table(best, "threshold", "fscore", "precision", "recall") == approx([(.15, .72727273, .57142857, 1.)])


def test_both_minima_are_refused(scored):
    with pytest.raises(ValueError):
        curves.best_fscore(curves.fscore_curve(scored), min_precision=.1, min_recall=.1)


def test_best_error_rate(scored):
    best = curves.best_error_rate(curves.error_rate_curve(scored))
    assert table(best, "threshold", "error_rate", "insertion_rate", "deletion_rate") == approx([(INF, 1., 0., 1.)])


def test_hot_class_is_cut_into_buckets(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.random() < .3), round(rng.gauss(0, 1), 3)) for _ in range(4000)]
    rows += [("cold", 1.0, 0.2), ("cold", 0.0, 0.1)]
    df = spark.createDataFrame(rows, "label string, target double, score double")
    cols = ("label", "threshold", "n_pos", "tps", "n_ref", "tp_at", "n_at")
    whole = sorted(tuple(r[c] for c in cols) for r in curves.positives_curve(df).collect())
    cut = sorted(tuple(r[c] for c in cols) for r in curves.positives_curve(df, rows_per_bucket=50).collect())
    assert cut == whole
    hot = [r for r in rows if r[0] == "hot"]
    for label, thr, n_pos, tps, *_ in cut:
        if label == "hot":
            assert n_pos == sum(s > thr for _, _, s in hot)
            assert tps == sum(t for _, t, s in hot if s > thr)


def test_lwlrap_brute_force(spark):
    rng = random.Random(2)
    n, k = 60, 8
    truth = [[0] * k] + [[int(rng.random() < .4) for _ in range(k)] for _ in range(n - 1)]
    scores = [[rng.random() for _ in range(k)] for _ in range(n)]
    rows = [(str(i), f"c{c}", float(truth[i][c]), scores[i][c]) for i in range(n) for c in range(k)]
    got = {r["label"]: r for r in instance.lwlrap(
        spark.createDataFrame(rows, "clip_id string, label string, target double, score double")).collect()}
    hits = [[] for _ in range(k)]
    for t, s in zip(truth, scores):
        ranked = sorted(range(k), key=lambda c: -s[c])
        found = 0
        for rank, c in enumerate(ranked, 1):
            if t[c]:
                found += 1
                hits[c].append(found / rank)
    total = sum(map(len, hits))
    assert got[None]["lwlrap"] == pytest.approx(sum(map(sum, hits)) / total)
    for c in range(k):
        assert got[f"c{c}"]["lwlrap"] == pytest.approx(sum(hits[c]) / len(hits[c]))
        assert got[f"c{c}"]["weight"] == pytest.approx(len(hits[c]) / total)


def test_lwlrap_without_positives(spark):
    df = spark.createDataFrame([("1", "a", 0.0, .3)], "clip_id string, label string, target double, score double")
    got = {r["label"]: r["lwlrap"] for r in instance.lwlrap(df).collect()}
    assert got == {"a": 0.0, None: 0.0}


def test_soft_counts(spark):
    df = spark.createDataFrame([("1", "a", .5, 1.0), ("1", "b", 1.0, 0.0)], "clip_id string, label string, target double, decision double")
    r = instance.counts(df, ()).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (.5, .5, 0.0, 1.0)
    s = instance.substitutions_insertions_deletions(df).first()
    assert (s.substitutions, s.insertions, s.deletions) == (.5, 0.0, .5)

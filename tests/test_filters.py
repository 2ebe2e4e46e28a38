import numpy as np
import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from earmark.operators import detect, ensemble, filters

A, B = [1., 2., 3., 4., 5.], [1., 4., 9., 16., 25.]


def frames(spark, series, schema="clip_id string, label string, frame bigint, onset double, offset double, score double"):
    rows = [(c, l, i, i * .02, i * .02 + .02, float(x)) for (c, l), xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, schema)


def back(df, column="score"):
    out = {}
    for r in df.orderBy("clip_id", "label", "frame").collect():
        out.setdefault((r["clip_id"], r["label"]), []).append(r[column])
    return out


@pytest.mark.parametrize("fn, n, a, b", [
    (filters.meanfilt, 3, [1, 2, 3, 4, 3], [5 / 3, 14 / 3, 29 / 3, 50 / 3, 41 / 3]),
    (filters.medfilt, 3, [1, 2, 3, 4, 4], [1, 4, 9, 16, 16]),
    (filters.maxfilt, 3, [2, 3, 4, 5, 5], [4, 9, 16, 25, 25]),
    (filters.stepfilt, 4, [1.5, 2, 2, 2, -1], [2.5, 6, 10, 14, 0]),
    (filters.medfilt, 1, A, B)])
@pytest.mark.parametrize("chunk", [2, 8192])
def test_worked_examples(spark, fn, n, a, b, chunk):
    df = frames(spark, {("x", "a"): A, ("x", "b"): B})
    got = back(fn(df, n, chunk=chunk))
    assert got[("x", "a")] == pytest.approx(a)
    assert got[("x", "b")] == pytest.approx(b)


def random_series(seed=0, lengths=(1, 7, 23, 60)):
    rng = np.random.default_rng(seed)
    return {(f"c{i}", "a"): rng.normal(size=n).round(2).tolist() for i, n in enumerate(lengths)}


def np_step(x, n):
    h = n // 2
    p = np.concatenate([np.zeros(h), x, np.zeros(h - 1)])
    return np.correlate(p, np.concatenate([-np.ones(h), np.ones(h)]) / h, mode="valid")


def np_boundary(x, n):
    x = np.asarray(x)
    f, b = (np_step(x, n), np_step(x[::-1], n)) if n else (x, x[::-1])
    return np.minimum(np.maximum.accumulate(f), np.maximum.accumulate(b)[::-1])


@pytest.mark.parametrize("n", [0, 4, 10, 20])
@pytest.mark.parametrize("chunk", [5, 8192])
def test_boundary_filter(spark, n, chunk):
    series = random_series()
    got = back(filters.boundariesfilt(frames(spark, series), n, chunk=chunk))
    for k, x in series.items():
        assert got[k] == pytest.approx(np_boundary(x, n).tolist(), abs=1e-9)


@pytest.mark.parametrize("n", [5, 51, 53, 91])
@pytest.mark.parametrize("chunk", [9, 8192])
def test_median_filter(spark, n, chunk):
    series = random_series(1)
    got = back(filters.medfilt(frames(spark, series), n, chunk=chunk))
    for k, x in series.items():
        p = np.concatenate([np.zeros(n // 2), x, np.zeros(n // 2)])
        want = [float(np.median(p[i:i + n])) for i in range(len(x))]
        assert got[k] == pytest.approx(want)


@pytest.mark.parametrize("mode", ["same", "valid", "full"])
@pytest.mark.parametrize("n", [1, 4, 7])
@pytest.mark.parametrize("chunk", [14, 8192])
def test_correlate(spark, mode, n, chunk):
    series = random_series(2, (7, 30, 41))
    kernel = np.random.default_rng(n).normal(size=n)
    got = back(filters.correlate(frames(spark, series), kernel, mode, chunk=chunk))
    for k, x in series.items():
        assert got[k] == pytest.approx(np.correlate(x, kernel, mode=mode).tolist(), abs=1e-9)


@pytest.mark.parametrize("mode", ["same", "valid", "full"])
def test_correlate_short_series_and_long_kernels(spark, mode):
    rng = np.random.default_rng(5)
    series = {("x", "a"): [1.0, 2.0], ("y", "a"): rng.normal(size=3000).tolist()}
    kernel = rng.normal(size=1001)
    df = filters.correlate(frames(spark, series), kernel, mode, chunk=2048)
    got = back(df)
    assert got[("y", "a")] == pytest.approx(np.correlate(series[("y", "a")], kernel, mode=mode).tolist(), abs=1e-6)
    base = {"same": -500, "valid": 0, "full": -1000}[mode]
    x = series[("x", "a")]
    short = [sum(kernel[i - f - base] * x[i] for i in range(2) if 0 <= i - f - base < 1001) for f in range(2 + 1000 * (mode == "full"))]
    assert got.get(("x", "a"), []) == ([] if mode == "valid" else pytest.approx(short))
    small = filters.correlate(frames(spark, series), [1.0, 2.0], mode, chunk=2048)
    nodes = [d._jdf.queryExecution().optimizedPlan().toString().count("\n") for d in (df, small)]
    assert nodes[0] == nodes[1]


def test_missing_frames_do_not_depend_on_chunks(spark):
    """A missing frame counts as 0 and ends a run."""
    there = [5, 6, 7, 9, 10, 30, 31]
    value = {f: float(f % 7 + 1) for f in there}
    rows = [("c", "a", f, f * .02, f * .02 + .02, value[f]) for f in there]
    df = spark.createDataFrame(rows, "clip_id string, label string, frame bigint, onset double, offset double, score double")
    x = [value.get(f, 0.0) for f in range(-60, 100)]

    def window(f, a, b):
        return x[60 + f + a:60 + f + b + 1]

    want = {
        "mean": lambda f: sum(window(f, -2, 2)) / 5, "median": lambda f: sorted(window(f, -2, 2))[2], "max": lambda f: max(window(f, -2, 2)),
        "long": lambda f: sorted(window(f, -27, 27))[27], "step": lambda f: (sum(window(f, 0, 1)) - sum(window(f, -2, -1))) / 2}
    for chunk in (8, 8192):
        done = filters.filter_series(df, {"mean": ("mean", 5), "median": ("median", 5), "max": ("max", 5), "long": ("median", 55), "step": ("step", 4)},
                                     chunk=chunk).collect()
        assert sorted(r.frame for r in done) == there
        for r in done:
            for name, fn in want.items():
                assert r[name] == pytest.approx(fn(r.frame)), (chunk, name, r.frame)
        same = {r.frame: r.score for r in filters.correlate(df, [1.0, 10.0, 100.0], "same", chunk=chunk).collect()}
        assert same == {f: pytest.approx(sum(w * v for w, v in zip((1, 10, 100), window(f, -1, 1)))) for f in there}
        valid = filters.correlate(df, [1.0, 10.0], "valid", chunk=chunk).collect()
        assert sorted(r.frame for r in valid) == [5, 6, 9, 30]
        runs = detect.score_intervals(df, .5, chunk=chunk).collect()
        assert sorted((round(r.onset / .02), round(r.offset / .02)) for r in runs) == [(5, 8), (9, 11), (30, 32)]


def test_lengths_are_checked():
    for fn, n in ((filters._median, 4), (filters._max, 2), (filters._step, 3)):
        with pytest.raises(ValueError):
            fn("score", n, None)


def test_missing_class_length_raises(spark):
    with pytest.raises((PySparkException, Py4JError), match="no filter length"):
        filters.filter_by_length(frames(spark, {("x", "z"): A}), "median", {"a": 3}).collect()


@pytest.mark.parametrize("chunk", [3, 8192])
def test_cumulative_targets(spark, chunk):
    series = random_series(3)
    out = filters.cumulative_targets(frames(spark, series), value="score", chunk=chunk)
    for k, x in series.items():
        assert back(out, "target_fwd")[k] == np.maximum.accumulate(x).tolist()
        assert back(out, "target_bwd")[k] == np.maximum.accumulate(x[::-1])[::-1].tolist()


def runs(x, thr):
    out, start = [], None
    for i, v in enumerate([*x, -np.inf]):
        if v > thr and start is None:
            start = i
        if not v > thr and start is not None:
            out.append((round(start * .02, 6), round((i - 1) * .02 + .02, 6)))
            start = None
    return out


@pytest.mark.parametrize("chunk", [1, 4, 8192])
def test_score_intervals(spark, chunk):
    series = random_series(4, (1, 9, 40, 77))
    thresholds = [-1.0, -0.2, 0.0, 0.55]
    got = detect.score_intervals(frames(spark, series), thresholds, chunk=chunk).collect()
    for t in thresholds:
        for k, x in series.items():
            mine = sorted((round(r.onset, 6), round(r.offset, 6)) for r in got if r.threshold == t and (r.clip_id, r.label) == k)
            assert mine == runs(x, t)


def test_score_intervals_from_table(spark):
    thr = spark.createDataFrame([("a", 0.0)], "label string, threshold double")
    series = random_series(5)
    a = detect.score_intervals(frames(spark, series), thr).orderBy("clip_id", "onset").collect()
    b = detect.score_intervals(frames(spark, series), {"a": 0.0}).orderBy("clip_id", "onset").collect()
    assert a == b


def test_missing_tag_raises(spark):
    tags = spark.createDataFrame([("y", "a", True)], "clip_id string, label string, tag boolean")
    with pytest.raises((PySparkException, Py4JError), match="no tag"):
        detect.mask_by_tags(frames(spark, {("x", "a"): A}), tags).collect()


def test_corrections_round_half_even(spark):
    d = spark.createDataFrame([("x", "a", 0.0625, 1.0), ("x", "b", 1.0, 1.2)], "clip_id string, label string, onset double, offset double")
    got = detect.correct_intervals(d, {"a": 0.5}, {"b": 0.5}, decimals=3).collect()
    assert [(r.label, r.onset, r.offset) for r in got] == [("a", 0.0, 1.0)]


@pytest.mark.parametrize("length, shift", [(1, 1), (5, 1), (5, 2), (8, 3)])
@pytest.mark.parametrize("chunk", [6, 8192])
def test_window_features(spark, length, shift, chunk):
    x = list(range(1, 20))
    df = frames(spark, {("x", "a"): x}).withColumnRenamed("score", "features")
    got = ensemble.window_features(df, length, shift, series=("clip_id", "label"), chunk=chunk).orderBy("frame").collect()
    before = max((length - shift) // 2, 0)
    padded = [0] * before + x + [0] * length
    assert len(got) == 1 + (len(x) - 1) // shift
    for r in got:
        full = [0] * r.pad_left + r.window
        full += [0] * (length - len(full))
        assert full == padded[r.frame * shift:r.frame * shift + length]


def test_ensemble_needs_all_frames(spark):
    df = spark.createDataFrame([("x", 0, "a", .1), ("x", 0, "a", .3), ("x", 1, "a", .3)], "clip_id string, frame bigint, label string, score double")
    with pytest.raises((PySparkException, Py4JError), match="models differ"):
        ensemble.ensemble_mean(df, 2).collect()


def test_medians_of_all_lengths_follow_one_rule(spark, monkeypatch):
    rows = [("c", "a", i, None if i == 20 else float("nan") if i == 40 else (i * 7 % 11) / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "clip_id string, label string, frame long, score double")
    out = []
    for limit in (51, 5):
        monkeypatch.setattr(filters, "LONG_MEDIAN", limit)
        out.append([repr(r.m) for r in filters.filter_series(df, {"m": ("median", 9)}).orderBy("frame").collect()])
    assert out[0] == out[1]

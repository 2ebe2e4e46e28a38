"""Time-series filters over long score tables, zero padded at the ends of a series.

Windows count frame numbers, not rows: a missing frame counts as 0 like those outside a series, whatever the size of chunks.

A filter is a pair ``(reach, column)``: how many earlier and later frames it looks at, and the
Column over an ordered window. User filters can be passed the same way. All filters asked for in
one call share one shuffle and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from earmark.scale import CHUNK, chunk_window, own_rows, running, with_halo
from earmark.schema import SERIES

LONG_MEDIAN = 51  # beyond this length sorted window lists lose to numpy on bounded chunks


@dataclass(frozen=True)
class Filter:
    reach: Callable[[int], tuple[int, int]]
    column: Callable[..., Column]  # (value, n, window) -> Column


def _odd(n):
    if n % 2 != 1:
        raise ValueError(f"filter length must be odd, got {n}")


def _even(n):
    if n % 2 != 0 or n < 2:
        raise ValueError(f"filter length must be even and positive, got {n}")


def _window_sum(value, window, first, last):
    return F.coalesce(F.sum(value).over(window.rangeBetween(first, last)), F.lit(0.0))


def _mean(value, n, window):
    return _window_sum(value, window, -(n // 2), n - 1 - n // 2) / F.lit(float(n))


def _median(value, n, window):
    _odd(n)
    if n == 1:
        return F.col(value)
    h = (n - 1) // 2
    seen = F.collect_list(value).over(window.rangeBetween(-h, h))
    padded = F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(seen)))
    return F.element_at(F.sort_array(padded), h + 1)


def _max(value, n, window):
    _odd(n)
    h = (n - 1) // 2
    frame = window.rangeBetween(-h, h)
    outside = F.when(F.count(value).over(frame) < n, F.lit(0.0))
    return F.greatest(F.max(value).over(frame), outside)


def _step(value, n, window):
    _even(n)
    h = n // 2
    return (_window_sum(value, window, 0, h - 1) - _window_sum(value, window, -h, -1)) / F.lit(float(h))


def _step_back(value, n, window):
    _even(n)
    h = n // 2
    return (_window_sum(value, window, -h + 1, 0) - _window_sum(value, window, 1, h)) / F.lit(float(h))


def _centred(n):
    return n // 2, n // 2


FILTERS = {
    "mean": Filter(_centred, _mean),
    "median": Filter(_centred, _median),
    "max": Filter(_centred, _max),
    "step": Filter(lambda n: (n // 2, n // 2), _step),
    "step_back": Filter(lambda n: (n // 2, n // 2), _step_back),
}


def filter_series(scores: DataFrame, specs: dict, series=SERIES, value: str = "score",
                  frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """Add one column per entry of ``specs``: output name -> (filter, n).

    ``filter`` is a name in ``FILTERS``, ``"boundary"``, or a ``Filter``.
    """
    series = list(series)
    boundary = {out: n for out, (kind, n) in specs.items() if kind == "boundary"}
    plain = {out: (FILTERS[kind] if isinstance(kind, str) else kind, n)
             for out, (kind, n) in specs.items() if kind != "boundary"}
    for out, n in boundary.items():
        if n > 0:
            plain[f"_fwd_{out}"] = (FILTERS["step"], n)
            plain[f"_bwd_{out}"] = (FILTERS["step_back"], n)
    long_medians = {out: n for out, (f, n) in plain.items()
                    if f is FILTERS["median"] and n > LONG_MEDIAN}
    for out in long_medians:
        _odd(plain.pop(out)[1])

    reaches = [f.reach(n) for f, n in plain.values()] or [(0, 0)]
    before, after = max(r[0] for r in reaches), max(r[1] for r in reaches)
    rows = with_halo(scores, before, after, chunk, frame)
    window = chunk_window(series, frame)
    rows = rows.withColumns({out: f.column(value, n, window) for out, (f, n) in plain.items()})
    rows = own_rows(rows, chunk, frame)

    if boundary:
        fwd = {f"_up_{out}": ("max", f"_fwd_{out}" if n > 0 else value) for out, n in boundary.items()}
        bwd = {f"_dn_{out}": ("max", f"_bwd_{out}" if n > 0 else value) for out, n in boundary.items()}
        rows = running(rows, series, "_chunk", [frame], fwd)
        rows = running(rows, series, "_chunk", [frame], bwd, backward=True)
        for out in boundary:
            rows = rows.withColumn(out, F.least(f"_up_{out}", f"_dn_{out}"))
        rows = rows.drop(*fwd, *bwd, *[c for c in rows.columns if c.startswith(("_fwd_", "_bwd_"))])
    rows = rows.drop("_chunk")
    for out, n in long_medians.items():
        rows = _long_median(rows, out, n, series, value, frame, max(chunk, n))
    return rows


def _long_median(scores, out, n, series, value, frame, chunk):
    """Median over many frames, in numpy."""
    h = (n - 1) // 2

    def medians(x: np.ndarray, there: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(h), x, np.zeros(h)]), n)
        views = views[there]
        parts = np.array_split(views, max(1, views.size // 4_000_000))
        return np.concatenate([np.partition(p, h, axis=-1)[:, h] for p in parts]), None

    return _dense_chunks(scores, out, h, h, medians, series, value, frame, chunk)


def _dense_chunks(scores, out, before, after, work, series, value, frame, chunk):
    """Add ``out``: what ``work(values, there)`` gives for the frames ``there`` of a dense array of at most
    ``before + chunk + after`` values, in which missing frames and NULLs are 0; and which of these frames stay (None: all).

    Chunks arrive sorted; complete ones of an Arrow batch are worked on, the last waits for the next batch.
    """
    rows = with_halo(scores, before, after, chunk, frame)
    rows = rows.withColumn("_x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    rows = rows.repartition(*series, "_chunk").sortWithinPartitions(*series, "_chunk", frame)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scores.schema) + f", `{out}` double"
    key = [*series, "_chunk"]

    def finish(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        values, frames = pdf["_x"].to_numpy(dtype="float64"), pdf[frame].to_numpy()
        parts, keep = [], []
        for x, f in zip(np.split(values, starts[1:]), np.split(frames, starts[1:])):
            at = f - f[0]
            dense = np.zeros(int(at[-1]) + 1)
            dense[at] = x
            found, stays = work(dense, at)
            parts.append(found)
            keep.append(np.ones(len(at), bool) if stays is None else stays)
        own = (pdf[frame] // chunk == pdf["_chunk"]).to_numpy() & np.concatenate(keep)
        return pdf.assign(**{out: np.concatenate(parts)}).loc[own].drop(columns=["_chunk", "_x"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            if waiting:
                pdf = pd.concat([*waiting, pdf], ignore_index=True)
            ids = pdf[key]
            starts = np.flatnonzero(((ids != ids.shift()) & ~(ids.isna() & ids.shift().isna())).any(axis=1).to_numpy())
            starts = np.union1d([0], starts)
            last = starts[-1]
            if last:
                yield finish(pdf.iloc[:last], starts[:-1])
            waiting = [pdf.iloc[last:]]
        if waiting:
            yield finish(waiting[0], np.array([0]))

    return rows.mapInPandas(run, schema)


def meanfilt(scores, n, out="score", **kw):
    """Moving average, divided by n also where the window leaves the series."""
    return _one(scores, "mean", n, out, **kw)


def medfilt(scores, n, out="score", **kw):
    return _one(scores, "median", n, out, **kw)


def maxfilt(scores, n, out="score", **kw):
    return _one(scores, "max", n, out, **kw)


def stepfilt(scores, n, out="score", **kw):
    return _one(scores, "step", n, out, **kw)


def boundariesfilt(scores, n, out="score", **kw):
    """Lower envelope of the running maxima of forward and backward steps; n=0 skips the steps."""
    return _one(scores, "boundary", n, out, **kw)


def _one(scores, kind, n, out, value="score", **kw):
    cols = scores.columns
    done = filter_series(scores, {"_out": (kind, n)}, value=value, **kw)
    keep = [c for c in cols if c != out]
    return done.select(*keep, F.col("_out").alias(out))


def correlate(scores: DataFrame, kernel, mode: str = "same", series=SERIES, value: str = "score",
              out: str = "score", frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """Cross-correlation with a kernel; returns series, frame and ``out``.

    ``same`` keeps the frames, ``valid`` those from which on as many frames as the kernel has taps follow each other, ``full``
    adds n-1 frames at the end. What is not there counts as 0, so a series shorter than the kernel has a result too; in
    ``valid`` it has no frames. Chunks are convolved as arrays: the plan does not grow with the kernel.
    """
    if mode not in ("same", "valid", "full"):
        raise ValueError(mode)
    kernel = np.array([float(c) for c in kernel])
    n, series = len(kernel), list(series)
    rows = scores.select(*series, F.col(frame).cast("bigint").alias(frame), F.col(value).cast("double").alias("_value"))
    if mode == "full" and n > 1:
        tail = (rows.groupBy(*series).agg(F.max(frame).alias("_last"))
                .select(*series, F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + n - 1)).alias(frame)))
        rows = rows.unionByName(tail.withColumn("_value", F.lit(None).cast("double")))
    base = {"same": -(n // 2), "valid": 0, "full": -(n - 1)}[mode]

    def convolved(x: np.ndarray, there: np.ndarray) -> np.ndarray:
        sums = np.correlate(np.concatenate([np.zeros(n), x, np.zeros(n)]), kernel, "valid")[there + n + base]
        if mode == "valid":
            present = np.zeros(len(x) + n)
            present[there] = 1
            whole = np.convolve(present, np.ones(n), "full")[n - 1:][there] == n
            return sums, whole
        return sums, None

    done = _dense_chunks(rows, "_out", -base, max(base + n - 1, 0), convolved, series, "_value", frame, max(chunk, 2 * n))
    return done.select(*series, frame, F.col("_out").alias(out))


def filter_by_length(scores: DataFrame, kind: str, lengths, series=SERIES, value: str = "score",
                     out: str = "score", chunk: int = CHUNK) -> DataFrame:
    """Filter with a scalar length, a length per class, or several named sets of either.

    ``lengths``: int, ``{label: n}``, or ``{set_name: {label: n}}``; named sets fan the
    scores out with a ``set_name`` column. Each distinct length is computed once.
    """
    named = isinstance(lengths, dict) and all(isinstance(v, dict) for v in lengths.values())
    sets = lengths if named else {"": lengths}
    distinct = sorted({n for spec in sets.values()
                       for n in (spec.values() if isinstance(spec, dict) else [spec])})
    rows = filter_series(scores, {f"_len_{n}": (kind, n) for n in distinct},
                         series=series, value=value, chunk=chunk)

    def pick(spec):
        if not isinstance(spec, dict):
            return F.col(f"_len_{spec}")
        chosen = None
        for n in distinct:
            labels = sorted(label for label, m in spec.items() if m == n)
            if labels:
                hit = F.col("label").isin(labels)
                col = F.col(f"_len_{n}")
                chosen = F.when(hit, col) if chosen is None else chosen.when(hit, col)
        return chosen.otherwise(F.raise_error(F.concat(F.lit("no filter length for "), F.col("label"))))

    keep = [c for c in scores.columns if c not in (out,)]
    if not named:
        return rows.select(*keep, pick(lengths).alias(out))
    fan = F.explode(F.array(*[
        F.struct(F.lit(name).alias("set_name"), pick(spec).alias(out)) for name, spec in sets.items()]))
    return rows.select(*keep, fan.alias("_f")).select(*keep, "_f.set_name", f"_f.{out}")


def mask_beyond_length(scores: DataFrame, seq_len: str = "seq_len", value: str = "score",
                       frame: str = "frame") -> DataFrame:
    """Scores past the valid length of the clip become 0."""
    return scores.withColumn(value, F.when(F.col(frame) < F.col(seq_len), F.col(value)).otherwise(F.lit(0.0)))


def cumulative_targets(targets: DataFrame, series=SERIES, value: str = "target",
                       frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """Running maximum of targets, forward (``target_fwd``) and backward (``target_bwd``)."""
    rows = with_halo(targets, 0, 0, chunk, frame)
    rows = running(rows, series, "_chunk", [frame], {"target_fwd": ("max", value)})
    rows = running(rows, series, "_chunk", [frame], {"target_bwd": ("max", value)}, backward=True)
    return rows.drop("_chunk")

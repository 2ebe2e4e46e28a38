"""Every run of a score series, for all thresholds at once.

At threshold ``t`` the runs of a series are the maximal stretches of consecutive frames with ``score > t``. Lower ``t`` and runs
appear, grow and merge: over all thresholds they form a tree with at most one run per frame. A run lives while ``t`` is below
its smallest score and not below the larger score at its two borders. So the frame with the smallest score of a run names it
(of equal ones the first), and its borders are the nearest smaller scores on both sides.

Chunks of a series look for these borders among their own frames. What stays open there are the chunk's running minima; they
meet the minima of the one other chunk that can hold their border, which a carry over one summary row per chunk finds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.scale import CHUNK, chunk_of, cut_lineage, join_same
from earmark.schema import SERIES

_KINDS = CLOSED, OPEN, LEFT_STAIR, RIGHT_STAIR, CHUNK_ROW = range(5)
_FIELDS = ("kind int, chunk bigint, high double, onset double, offset double, low_left double, low_right double, "
           "left_open boolean, right_open boolean, first double, last double, least double")


def _minima(score: np.ndarray, new: np.ndarray):
    """For every frame the nearest smaller frame to the left and right in its stretch (-1: none), and whether an equal frame
    of the same run comes earlier. ``new`` marks the first frames of stretches."""
    n = len(score)
    left, right, twin = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    values, starts = score.tolist(), new.tolist()
    stack: list = []                 # frames with increasing scores; of equal ones the last, with the first beside it
    for i, x in enumerate(values):
        if starts[i]:
            stack = []
        while stack and values[stack[-1][0]] > x:
            right[stack.pop()[1]] = i
        if stack and values[stack[-1][0]] == x:
            twin[i] = True
            stack[-1] = (i, stack[-1][1])
            continue
        if stack:
            left[i] = stack[-1][0]
        stack.append((i, i))
    return left, right, twin


def _open_parts(series, chunk: int):
    """Arrow function: rows of chunks in order of frames to closed runs, open runs, border minima and chunk summaries."""
    keys = len(series)

    def of_chunks(table):
        n = table.num_rows
        cols = [table.column(i) for i in range(table.num_columns)]
        number, frame, on, off = (cols[keys + i].to_numpy(zero_copy_only=False) for i in range(4))
        score = cols[keys + 4].fill_null(-np.inf).to_numpy(zero_copy_only=False).astype(float)
        score = np.where(np.isnan(score), np.inf, score)
        head = _starts(table, keys)                                        # first rows of chunks
        group = np.cumsum(head) - 1
        new = head | np.concatenate([[True], frame[1:] != frame[:-1] + 1])
        new[0] = True
        stretch = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], n) - 1
        # a stretch goes on in the next chunk if it reaches the border; frames count from 0
        goes_left = (frame[begin] == number[begin] * chunk) & (number[begin] > 0)
        goes_right = frame[end] == number[end] * chunk + chunk - 1
        left, right, twin = _minima(score, new)
        node = np.flatnonzero(~twin & (score > -np.inf))
        s = stretch[node]
        no_left, no_right = left[node] < 0, right[node] < 0
        start = np.where(no_left, begin[s], left[node] + 1)
        stop = np.where(no_right, end[s], right[node] - 1)
        open_left, open_right = no_left & goes_left[s], no_right & goes_right[s]
        low_left = np.where(no_left, -np.inf, score[left[node]])
        low_right = np.where(no_right, -np.inf, score[right[node]])
        parts = [(np.where(open_left | open_right, OPEN, CLOSED), node, score[node], on[start], off[stop], low_left, low_right,
                  open_left, open_right)]
        edge = np.flatnonzero(goes_left | goes_right)
        if len(edge):
            # running minima from the right end of a stretch and from its left end
            for goes, kind, back in ((goes_right, LEFT_STAIR, True), (goes_left, RIGHT_STAIR, False)):
                at = np.flatnonzero(goes[stretch])
                if back:
                    at = at[::-1]
                if not len(at):
                    continue
                of = stretch[at]
                first = np.concatenate([[True], of[1:] != of[:-1]])
                least = _record_minima(score[at], first)
                at = at[least]
                # the neighbour of a border frame on the side of the run: inside this chunk, or NULL for the next chunk's edge
                if back:
                    time = np.where(at == end[stretch[at]], np.nan, on[np.minimum(at + 1, n - 1)])
                else:
                    time = np.where(at == begin[stretch[at]], np.nan, off[np.maximum(at - 1, 0)])
                flag = np.zeros(len(at), bool)
                parts.append((np.full(len(at), kind), at, score[at], time, time, score[at], score[at], flag, flag))
        out = [np.concatenate([np.asarray(p[i]) for p in parts]) for i in range(9)]
        kind, at = out[0], out[1]
        m, rows = len(kind), len(edge)
        take = pa.array(np.concatenate([at, begin[edge]]))

        def filled(values, tail, type_):
            return pa.array(np.concatenate([values, tail]), type_)

        nothing = np.full(rows, np.nan)
        least = np.minimum.reduceat(score, begin)[edge] if rows else nothing
        blank = np.full(m, np.nan)
        return pa.RecordBatch.from_arrays(
            [*(c.take(take) for c in cols[:keys]),
             filled(kind, np.full(rows, CHUNK_ROW), pa.int32()), cols[keys].take(take),
             filled(out[2], nothing, pa.float64()), filled(out[3], on[begin[edge]], pa.float64()),
             filled(out[4], off[end[edge]], pa.float64()), filled(out[5], nothing, pa.float64()), filled(out[6], nothing, pa.float64()),
             filled(out[7], goes_left[edge], pa.bool_()), filled(out[8], goes_right[edge], pa.bool_()),
             filled(blank, score[begin[edge]], pa.float64()), filled(blank, score[end[edge]], pa.float64()),
             filled(blank, least, pa.float64())],
            names=[*table.schema.names[:keys], *[c.split(" ")[0] for c in _FIELDS.split(", ")]])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            last = int(np.flatnonzero(_starts(batch, keys))[-1])
            held = batch.slice(last)
            if last:
                yield of_chunks(batch.slice(0, last))
        if held is not None:
            yield of_chunks(held)

    return run


def _record_minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which values are below all before them since the last ``first``."""
    out = np.zeros(len(values), bool)
    for a, b in zip(np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(values))):
        part = values[a:b]
        out[a:b] = np.concatenate([[True], part[1:] < np.minimum.accumulate(part)[:-1]])
    return out


def _starts(batch, keys: int) -> np.ndarray:
    """First rows of groups that are equal in the first ``keys + 1`` columns."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(keys + 1):
        column = batch.column(i)
        if i < keys:
            coded = pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False)
        else:
            coded = column.to_numpy(zero_copy_only=False)
        out[1:] |= coded[1:] != coded[:-1]
    return out


def _targets(table: pa.Table) -> pa.Table:
    """For the chunks of a series: ``side``, the chunks whose minima hold borders of open runs, and for which scores; and for
    every chunk the ends of its stretch (side 0)."""
    cols = {c: table.column(c).to_numpy(zero_copy_only=False) for c in
            ("chunk", "onset", "offset", "first", "last", "least", "left_open", "right_open")}
    order = np.lexsort((cols["onset"], cols["chunk"]))
    rows = [{c: v[i] for c, v in cols.items()} for i in order]
    out = []

    def joined(a, b):
        return a["right_open"] and b["left_open"] and b["chunk"] == a["chunk"] + 1

    def side(rows, name, edge, opened, strict, time):
        stack, before, reach = [], None, None
        for r in rows:
            linked = before is not None and (joined(before, r) if name == 1 else joined(r, before))
            if not linked:
                stack, reach = [], r[time]
            if linked and r[opened]:
                upper = np.inf
                for t in reversed(stack):
                    low = t["least"]
                    if low < upper:
                        if low < r[edge] or (not strict and low == r[edge]):
                            out.append((name, r["chunk"], t["chunk"], low, upper, np.nan))
                        upper = low
                    if low < r["least"] or (not strict and low == r["least"]):
                        break
                while stack and stack[-1]["least"] >= r["least"]:
                    stack.pop()
            if r[opened]:
                out.append((name + 2, r["chunk"], r["chunk"], np.nan, np.nan, reach))
            stack.append(r)
            before = r

    side(rows, 1, "first", "left_open", False, "onset")
    side(rows[::-1], 2, "last", "right_open", True, "offset")
    columns = list(zip(*out)) if out else [()] * 6
    types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    key = {c: table.column(c) for c in table.schema.names if c not in cols}
    return pa.table([*(pa.array([k[0].as_py()] * len(out), k.type) for k in key.values()),
                     *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=[*key, "side", "chunk", "target", "above", "below", "reach"])


def score_runs(scores: DataFrame, series=SERIES, value: str = "score", frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """``(*series, onset, offset, low, high)``: every run once; it stands at thresholds ``low <= t < high``.

    Frames are whole numbers from 0 on; a missing frame ends a run. NULL scores are above no threshold, NaN is above all. ``low``
    is minus infinity for a run that is bounded by missing frames only. A frame stands once in a series.
    """
    series = list(series)
    rows = scores.select(*series, chunk_of(frame, chunk).alias("chunk"), F.col(frame).cast("bigint").alias("frame"), F.col("onset").cast("double"),
                         F.col("offset").cast("double"), F.col(value).cast("double").alias("score"))
    rows = rows.repartition(*series, "chunk").sortWithinPartitions(*series, "chunk", "frame")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in series)
    parts = cut_lineage(rows.mapInArrow(_open_parts(series, chunk), f"{kinds}, {_FIELDS}"))
    low = F.greatest("low_left", "low_right")
    closed = parts.where(f"kind = {CLOSED}").select(*series, "onset", "offset", low.alias("low"), "high")
    # from here on only series that are longer than a chunk
    key = [*series, "chunk"]
    summary = parts.where(f"kind = {CHUNK_ROW}").select(*key, "onset", "offset", "first", "last", "least", "left_open", "right_open")
    targets = cut_lineage(summary.groupBy(*series).applyInArrow(
        _targets, f"{kinds}, side int, chunk bigint, target bigint, above double, below double, reach double"))
    nodes = cut_lineage(parts.where(f"kind = {OPEN}").select(
        *key, "high", "onset", "offset", "low_left", "low_right", "left_open", "right_open"))
    for side in (1, 2):
        nodes = _with_border(nodes, parts, summary, targets, series, side)
    found = nodes.where("not left_open or low_left is null or low_left < high")          # a twin left of it names the run
    low = F.greatest(F.coalesce("low_left", F.lit(float("-inf"))), F.coalesce("low_right", F.lit(float("-inf"))))
    return closed.unionByName(found.select(*series, "onset", "offset", low.alias("low"), "high"))


def _with_border(nodes, parts, summary, targets, series, side):
    """Open runs with the score and the end at their left (``side`` 1) or right (2) border, from the minima of another chunk."""
    key = [*series, "chunk"]
    opened, low, end, stair, edge, step = (("left_open", "low_left", "onset", LEFT_STAIR, "right_open", 1) if side == 1
                                           else ("right_open", "low_right", "offset", RIGHT_STAIR, "left_open", -1))
    v = F.col("high")
    at = targets.where(f"side = {side}").select(*key, "target", "above", "below")
    inside = (v >= F.col("above")) & (v < F.col("below")) if side == 1 else (v > F.col("above")) & (v <= F.col("below"))
    asks = join_same(nodes.where(opened).select(*key, "high"), at, key).where(inside).select(*key, "target", "high")
    # a border right at the end of the target has its neighbour frame in the chunk beside it
    beside = summary.where(opened).select(*series, (F.col("chunk") - step).alias("target"), F.col(end).alias("_beside"))
    stairs = parts.where(f"kind = {stair}").select(*series, F.col("chunk").alias("target"), "high", F.col("onset").alias("_time"))
    stairs = join_same(stairs, beside, [*series, "target"], "left")
    time = F.when(F.isnan("_time"), F.col("_beside")).otherwise(F.col("_time"))
    stairs = stairs.select(*series, "target", F.struct(F.col("high").alias("low"), time.alias("time")).alias("_s"))
    stairs = join_same(at.select(*key, "target"), stairs, [*series, "target"]).withColumn("high", F.col("_s.low"))
    # of the minima up to a run's own score (on the right: below it) the largest
    both = stairs.withColumn("_ask", F.lit(False)).unionByName(asks.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    order = F.col("_ask").asc() if side == 1 else F.col("_ask").desc()
    w = W.partitionBy(*key, "target").orderBy("high", order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_ask").select(
        *key, "high", F.col("_s.low").alias("_low"), F.col("_s.time").alias("_end"))
    reach = targets.where(f"side = {side + 2}").select(*key, F.col("reach").alias("_reach"))
    rows = join_same(join_same(nodes, found, [*key, "high"], "left"), reach, key, "left")
    return cut_lineage(rows.withColumn(low, F.when(F.col(opened), F.col("_low")).otherwise(F.col(low)))
                       .withColumn(end, F.when(F.col(opened), F.coalesce("_end", "_reach")).otherwise(F.col(end)))
                       .drop("_low", "_end", "_reach"))

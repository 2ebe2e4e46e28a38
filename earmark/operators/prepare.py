"""From the clip catalogue to an ordered, balanced and batched training table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from earmark.scale import hash_bucket, hash_order, join_same, running_index, value_buckets

MIN_AUDIO_LENGTH = 1.0  # seconds, fixed default


def repetitions(names) -> dict:
    """Normalise a dataset choice (str, list, ``(name, reps)`` pairs or dict) to ``{name: reps}``."""
    if isinstance(names, str):
        names = {names: 1}
    elif not isinstance(names, dict):
        names = dict(n if isinstance(n, (tuple, list)) else (n, 1) for n in names)
    return {name: int(reps) for name, reps in names.items() if reps > 0}


def scan_datasets(clips: DataFrame, names) -> DataFrame:
    """Clips of the chosen datasets with ``dataset_reps``; the name filter reaches the scan."""
    reps = repetitions(names)
    if not reps:
        return clips.where(F.lit(False)).withColumn("dataset_reps", F.lit(0))
    lookup = F.create_map(*[F.lit(x) for kv in sorted(reps.items()) for x in kv])
    return clips.where(F.col("dataset").isin(sorted(reps))).withColumn("dataset_reps", lookup[F.col("dataset")])


def drop_labelless(clips: DataFrame, events: str = "events") -> DataFrame:
    """Keep clips with at least one event; unlabeled (NULL) and empty ones go."""
    return clips.where(F.coalesce(F.size(events), F.lit(0)) > 0)


def longer_than(clips: DataFrame, min_length: float = MIN_AUDIO_LENGTH, length: str = "audio_length") -> DataFrame:
    return clips.where(F.col(length) > float(min_length))


def raw_clips(clips: DataFrame, names, train: bool = False, exclude: DataFrame | None = None,
              min_length: float = MIN_AUDIO_LENGTH) -> DataFrame:
    """Scan, drop label-less clips (training only), excluded ids and short clips."""
    rows = scan_datasets(clips, names)
    if train:
        rows = drop_labelless(rows)
    if exclude is not None:
        rows = rows.join(exclude.select("clip_id"), "clip_id", "left_anti")
    return longer_than(rows, min_length)


def vocabulary(events: DataFrame, label: str = "label") -> DataFrame:
    """``(label, index)`` in alphabetical order.

    The list of classes fits one row: it is collected as a set with partial aggregation.
    """
    return (events.select(F.col(label).alias("label")).distinct()
            .agg(F.sort_array(F.collect_set("label")).alias("l"))
            .select(F.posexplode("l").alias("index", "label")).select("label", "index"))


def clip_labels(clips: DataFrame, events: str = "events") -> Column:
    return F.array_distinct(F.transform(events, lambda e: e.label))


def label_counts(clips: DataFrame, reps: str = "dataset_reps") -> DataFrame:
    """Each clip counts once per distinct label, times its dataset repetitions."""
    return (clips.select(F.explode(clip_labels(clips)).alias("label"), reps)
            .groupBy("label").agg(F.sum(reps).alias("n")))


def label_repetitions(counts: DataFrame, min_counts) -> DataFrame:
    """How often clips of a label must repeat to reach ``min_counts`` (int, or share of the largest)."""
    top = counts.agg(F.max("n")).scalar()
    rows = counts.withColumn("_m", top)
    m = F.col("_m")
    if isinstance(min_counts, float):
        if not 0.0 < min_counts < 1.0:
            raise ValueError(min_counts)
        least = F.ceil(m * F.lit(min_counts))
    else:
        least = F.lit(int(min_counts)).cast("bigint")
    bad = (least <= 1) | ((least - 1) > m * 0.9)
    least = F.when(bad, F.raise_error(F.lit("min_counts out of range")).cast("bigint")).otherwise(least)
    base = F.floor(F.lit(1.0) / (F.lit(1.0) - (least - 1) / m))
    return rows.select("label", "n", F.ceil(least * base / F.col("n")).cast("bigint").alias("reps"))


def clip_repetitions(clips: DataFrame, label_reps: DataFrame, reps: str = "dataset_reps") -> DataFrame:
    """``reps`` per clip: dataset repetitions times the largest repetition among its labels."""
    per_label = clips.select("dataset", "clip_id", reps, F.explode(clip_labels(clips)).alias("label"))
    return (per_label.join(label_reps.select("label", F.col("reps").alias("_r")), "label")
            .groupBy("dataset", "clip_id").agg((F.max("_r") * F.max(reps)).cast("bigint").alias("reps")))


def tile(rows: DataFrame, reps: str = "reps", copy: str = "copy") -> DataFrame:
    """Repeat each row ``reps`` times, numbered from 0; rows with 0 go."""
    return rows.where(F.col(reps) > 0).withColumn(
        copy, F.explode(F.sequence(F.lit(0), (F.col(reps) - 1).cast("int"))))


def shuffled_index(rows: DataFrame, ids, seed: int = 0, epoch: int = 0, keys=(), name: str = "index") -> DataFrame:
    """Reproducible shuffle: position of each row in hash order, a new order per epoch.

    Leading hash bits make even buckets, so the index needs no single-task window.
    """
    rows = rows.withColumn("_h", hash_order(*ids, seed=seed + epoch))
    rows = rows.withColumn("_b", hash_bucket(F.col("_h")))
    return running_index(rows, keys, "_b", ["_h", *ids], name).drop("_h", "_b")


def ordered_index(rows: DataFrame, order: str, ids=(), keys=("dataset",), name: str = "index", **kw) -> DataFrame:
    """Position of each row per ``keys`` in the order of a numeric column."""
    rows = value_buckets(rows, keys, order, name="_b", ties=ids, **kw)
    return running_index(rows, keys, "_b", [order, *ids], name).drop("_b")


def intersperse(rows: DataFrame, source: str = "dataset", index: str = "index", name: str = "position",
                sizes: DataFrame | None = None) -> DataFrame:
    """Even interleaving of sources: row i of n sits at ``(i + 1) / n``; ties by source.

    ``sizes (source, n)`` saves counting the indexed rows again.
    """
    if sizes is None:
        sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(source, F.col("n").alias("_n"))
    rows = rows.join(sizes, source)
    return rows.withColumn(name, (F.col(index) + 1) / F.col("_n")).drop("_n")


def oversample(clips: DataFrame, min_counts, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Balance classes by repeating clips, then interleave the copies of all repetition groups.

    Returns the tiled rows with ``copy`` and ``position``; sort by ``position, dataset, clip_id, copy``.
    """
    reps = label_repetitions(label_counts(clips), min_counts)
    per_clip = clip_repetitions(clips, reps)
    per_clip = per_clip.withColumn("group", F.concat_ws("/", F.col("dataset"), F.col("reps").cast("string")))
    sizes = per_clip.groupBy("group").agg(F.sum("reps").alias("n"))
    tiled = tile(clips.join(per_clip, ["dataset", "clip_id"]))
    indexed = shuffled_index(tiled, ["clip_id", "copy"], seed, epoch, keys=["group"])
    return intersperse(indexed, "group", sizes=sizes).drop("index", "dataset_reps")


def mixing_pairs(rows: DataFrame, partners: DataFrame, interval: float = 1.5, index: str = "index",
                 columns=("clip_id",)) -> DataFrame:
    """Row i is mixed if ``i mod interval < 1``; its partner is row ``floor(i / interval)``.

    Both inputs carry a 0-based ``index``. Partner columns get the prefix ``mix_``; NULL = not mixed.
    Raises if the partner set is smaller than the input.
    """
    if interval < 1:
        raise ValueError("interval must be at least 1")
    x = F.lit(float(interval))
    i = F.col(index)
    mixed = (i - F.floor(i / x) * x) < 1
    rows = rows.withColumns({"_last": rows.agg(F.max(index).alias("n")).scalar(),
                             "_last_partner": partners.agg(F.max(index).alias("n")).scalar()})
    too_few = F.coalesce("_last_partner", F.lit(-1)) < F.col("_last")
    partner = (F.when(too_few, F.raise_error(F.lit("fewer partners than rows")).cast("bigint"))
               .when(mixed, F.floor(i / x).cast("bigint")))
    # rows without a partner get keys of their own below 0, which match nothing and spread evenly
    rows = rows.withColumn("_p", F.coalesce(partner, -1 - i)).drop("_last", "_last_partner")
    other = partners.select(F.col(index).alias("_p"), *[F.col(c).alias(f"mix_{c}") for c in columns])
    return rows.join(other, "_p", "left").drop("_p")


def length_bucket(length, max_padding_rate: float = 0.1) -> Column:
    """Bucket number; lengths in one bucket differ by at most the padding rate. NULL for no length, or none above 0."""
    c = F.col(length) if isinstance(length, str) else length
    return F.when(c > 0, F.floor(F.ln(c) / F.lit(-math.log(1.0 - max_padding_rate))).cast("bigint"))


def batches(rows: DataFrame, batch_size: int, length: str = "seq_len", max_padding_rate: float = 0.1,
            drop_incomplete: bool = False, min_dataset_examples: dict | None = None, ids=("clip_id",),
            seed: int = 0, epoch: int = 0) -> DataFrame:
    """Assign rows of similar length to batches: ``bucket, batch, batch_pos`` (longest first).

    A bucket may hold most rows (all clips equally long), so positions in a bucket come from hash
    buckets, not from one window. ``min_dataset_examples`` reserves slots of every full batch for listed
    datasets as long as they have rows; all other rows, of these datasets too, fill the slots that are left.
    Only the last batch of a bucket is smaller. Rows without a length above 0 make a bucket of their own (NULL).
    """
    rows = rows.withColumn("bucket", length_bucket(length, max_padding_rate))
    if not min_dataset_examples:
        rows = shuffled_index(rows, ids, seed, epoch, keys=["bucket"], name="_i")
        rows = rows.withColumn("batch", F.floor(F.col("_i") / batch_size).cast("bigint")).drop("_i")
    else:
        rows = _with_quotas(rows, {d: int(q) for d, q in min_dataset_examples.items()}, batch_size, ids, seed, epoch)
    one = W.partitionBy("bucket", "batch")  # at most batch_size rows
    rows = rows.withColumn("batch_pos", F.row_number().over(one.orderBy(F.col(length).desc(), *ids)) - 1)
    if drop_incomplete:
        rows = (rows.withColumn("_n", F.count(F.lit(1)).over(one)).where(F.col("_n") == batch_size).drop("_n"))
    return rows


def _with_quotas(rows: DataFrame, quota: dict, batch_size: int, ids, seed: int, epoch: int) -> DataFrame:
    """Add ``batch``: reserved slots of full batches first, then the free slots in order."""
    if sum(quota.values()) > batch_size:
        raise ValueError("quotas exceed the batch size")
    slots = F.create_map(*[F.lit(x) for kv in sorted(quota.items()) for x in kv])
    listed = F.col("dataset").isin(sorted(quota))
    sizes = rows.groupBy("bucket").agg(
        F.floor(F.count(F.lit(1)) / batch_size).cast("bigint").alias("_full"),
        *[F.count_if(F.col("dataset") == d).alias(f"_n{k}") for k, d in enumerate(sorted(quota))])
    rows = rows.withColumn("_lane", F.when(listed, F.col("dataset")).otherwise(F.lit("")))
    rows = shuffled_index(rows, ids, seed, epoch, keys=["bucket", "_lane"], name="_i")
    rows = join_same(rows, sizes.select("bucket", "_full"), ["bucket"])
    share = F.try_element_at(slots, F.col("_lane"))
    rows = rows.withColumn("batch", F.when(listed & (share > 0) & (F.col("_i") < share * F.col("_full")),
                                           F.floor(F.col("_i") / share).cast("bigint")))
    reserved = rows.where("batch is not null").drop("_i", "_lane", "_full")
    rest = shuffled_index(rows.where("batch is null").drop("_i", "_lane", "batch"), ids, seed, epoch, keys=["bucket"], name="_i")

    def free_before(k):
        """Free slots of all full batches before batch ``k``."""
        taken = F.lit(0).cast("bigint")
        for j, d in enumerate(sorted(quota)):
            taken = taken + F.least(F.col(f"_n{j}"), k * quota[d])
        return k * batch_size - taken

    full = sizes.where("_full > 0").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)))
    low, high = free_before(F.col("batch")), free_before(F.col("batch") + 1)
    free = full.where(high > low).select("bucket", "batch", F.explode(F.sequence(low, high - 1)).alias("_i"))
    filled = join_same(rest, free, ["bucket", "_i"], "left")
    filled = filled.withColumn("batch", F.coalesce("batch", "_full")).drop("_i", "_full")
    return reserved.unionByName(filled.select(*reserved.columns))


def batch_diversity(batched: DataFrame, events: str = "events") -> DataFrame:
    """Rows and distinct labels of each batch."""
    rows = batched.select("bucket", "batch", "clip_id", F.explode_outer(clip_labels(batched, events)).alias("label"))
    return rows.groupBy("bucket", "batch").agg(
        F.count_distinct("label").alias("n_labels"), F.count_distinct("clip_id").alias("n_clips"))


def unbatch(batched: DataFrame, rows: str = "rows") -> DataFrame:
    return batched.select("bucket", "batch", F.explode(rows).alias("r")).select("bucket", "batch", "r.*")


def collate(batched: DataFrame, columns) -> DataFrame:
    """One row per batch with its rows in order; a batch holds at most ``batch_size`` rows."""
    return batched.groupBy("bucket", "batch").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("batch_pos", *columns))),
        lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias("rows"))

"""Building blocks that keep one hot key from landing in one task.

A plain window partitioned by a series puts that whole series into one task. The helpers
below split a series into chunks, work inside each chunk and carry small per-chunk summaries
across, so the largest unit of work is a chunk, not a key.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

CHUNK = 8192          # frames of one series handled together
ROWS_PER_BUCKET = 1_000_000  # more rows are cut into ranges of their values
BUCKETS_PER_LIMIT = 4  # bounds come from a sample, so ranges aim at a part of the limit


# ---------------------------------------------------------------- shared storage

def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written between two steps."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to shared storage and read back.

    Survives the loss of executors, computes a result used several times only once, and gives the
    planner the true size of what follows.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- frame chunks

def chunk_of(frame: Column | str, size: int) -> Column:
    frame = F.col(frame) if isinstance(frame, str) else frame
    return F.floor(frame / F.lit(size)).cast("bigint")


def with_halo(df: DataFrame, before: int, after: int, size: int = CHUNK,
              frame: str = "frame") -> DataFrame:
    """Add ``_chunk``; rows near a chunk border are copied to the chunks that look at them.

    A window over ``(series, _chunk)`` then sees ``before`` earlier and ``after`` later frames
    of every frame the chunk owns. ``own_rows`` drops the copies again.
    """
    if before == 0 and after == 0:
        return df.withColumn("_chunk", chunk_of(frame, size))
    first = chunk_of(F.greatest(F.col(frame) - after, F.lit(0)), size)
    last = chunk_of(F.col(frame) + before, size)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last)))


def own_rows(df: DataFrame, size: int = CHUNK, frame: str = "frame") -> DataFrame:
    return df.where(F.col("_chunk") == chunk_of(frame, size))


def chunk_window(series, frame: str = "frame"):
    return W.partitionBy(*series, "_chunk").orderBy(frame)


# ---------------------------------------------------------------- running aggregates

def join_large(rows: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two sides that grow with the input. Both are shuffled: files hold intervals in a few bytes a row, and by their size
    the planner would send such a table, hundreds of bytes a row in memory, whole to every executor."""
    return rows.join(other.hint("merge"), on, how)


def join_same(rows: DataFrame, other: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys, so that no row is lost; the keys come once, from ``rows``."""
    other = other.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = [rows[k].eqNullSafe(other[f"_same_{k}"]) for k in keys]
    return rows.join(other, same, how).drop(*[f"_same_{k}" for k in keys])


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,   # greatest/least skip NULL
    "min": F.least,
}


def running(df: DataFrame, keys, chunk: str, order, specs: dict, backward: bool = False,
            strict: bool = False, later: DataFrame | None = None) -> DataFrame:
    """Running aggregates per ``keys`` in ``order``, exact, one chunk per task unit.

    ``specs`` maps output name to ``(kind, column)`` with kind ``sum``, ``max`` or ``min``.
    ``chunk`` must be monotone in the column names ``order``. ``backward`` aggregates from the row to
    the end.
    ``strict`` leaves the current row out. A backward run needs the totals of later chunks only: ``later``
    may give ``df`` without chunk 0, made from pruned input, so that short series cost nothing.
    """
    keys = list(keys)
    tmp = {name: f"_in_{i}" for i, name in enumerate(specs)}
    def inputs(rows):
        return rows.withColumns({tmp[name]: F.col(col) if isinstance(col, str) else col for name, (_, col) in specs.items()})

    rows = inputs(df)
    totals = (rows if later is None else inputs(later)).groupBy(*keys, chunk).agg(*[
        getattr(F, kind)(tmp[name]).alias(f"_tot{tmp[name]}") for name, (kind, _) in specs.items()])
    # backward means descending order: a frame that ends at "unbounded following" is quadratic in Spark
    def way(c):
        return F.col(c).desc() if backward else F.col(c).asc()

    if later is not None:
        # chunk 0 receives a carry but gives none: add an empty row for it
        head = totals.select(*keys).distinct().withColumn(chunk, F.lit(0).cast(df.schema[chunk].dataType))
        totals = totals.unionByName(head, allowMissingColumns=True)
    across = W.partitionBy(*keys).orderBy(way(chunk)).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, chunk, *[
        getattr(F, kind)(f"_tot{tmp[name]}").over(across).alias(f"_carry{tmp[name]}")
        for name, (kind, _) in specs.items()])
    # only series of several chunks carry anything, so this side is small
    carried = carried.where(" or ".join(f"_carry{t} is not null" for t in tmp.values()))
    rows = join_same(rows, carried, [*keys, chunk], "left")
    inside = W.partitionBy(*keys, chunk).orderBy(*[way(o) for o in order])
    inside = inside.rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    for name, (kind, _) in specs.items():
        value = _COMBINE[kind](getattr(F, kind)(tmp[name]).over(inside), F.col(f"_carry{tmp[name]}"))
        rows = rows.withColumn(name, value)
    return rows.drop(*tmp.values(), *[f"_carry{t}" for t in tmp.values()])


def running_index(df: DataFrame, keys, chunk: str, order, name: str = "index") -> DataFrame:
    """0-based position per ``keys`` in ``order``; ``chunk`` must be monotone in ``order``."""
    keys = list(keys)
    sizes = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    across = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(chunk)
    offsets = sizes.select(*keys, chunk, F.coalesce(
        F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, chunk).orderBy(
        *[F.col(o) if isinstance(o, str) else o for o in order])
    return (join_same(df, offsets, [*keys, chunk])
            .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("bigint"))
            .drop("_offset"))


def hash_order(*ids, seed: int = 0) -> Column:
    """Reproducible pseudo-random order key."""
    return F.xxhash64(*[F.col(i) if isinstance(i, str) else i for i in ids], F.lit(seed))


def hash_bucket(key: Column, bits: int = 12) -> Column:
    """Leading bits of a hash: 2**bits buckets of even size, monotone in the hash."""
    return F.shiftright(key, 64 - bits)


# ---------------------------------------------------------------- value buckets

def value_buckets(df: DataFrame, keys, value: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                  name: str = "_bucket", ties=(), written: bool = False) -> DataFrame:
    """Add a bucket number that is monotone in ``value`` within ``keys``; buckets are about equally large.

    Rows are written once (unless ``written`` says they are) and counted. If they need more than one bucket, Spark deals them
    out by ranges of ``keys, value, ties``: as many ranges as the count asks for, with bounds from a sample. Columns in ``ties``
    spread rows of one value over several buckets, so an order by ``value`` and ``ties`` has no piece that cannot be cut.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("value_buckets needs at least one key column")
    rows = df if written else cut_lineage(df)
    pieces = math.ceil(BUCKETS_PER_LIMIT * rows.count() / rows_per_bucket)
    if pieces <= BUCKETS_PER_LIMIT:
        return rows.withColumn(name, F.lit(0))
    return cut_lineage(rows.repartitionByRange(pieces, *keys, value, *ties).withColumn(name, F.spark_partition_id()))

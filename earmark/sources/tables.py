"""Tables on storage: clip database, scores, detections, hyper-parameters, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from earmark import schema
from earmark.functions.labels import natural_key
from earmark.operators.detect import linspace, score_intervals


# ---------------------------------------------------------------- clip database

def write_database(clips: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per dataset."""
    clips.write.mode("overwrite").partitionBy("dataset").format(fmt).save(path)


def read_database(spark: SparkSession, path: str, datasets=None, fmt: str = "parquet",
                  table_schema: str | None = None) -> DataFrame:
    """Only the folders of the chosen datasets are read."""
    reader = spark.read.format(fmt)
    if fmt == "json" or table_schema:
        reader = reader.schema(table_schema or schema.CLIPS)
    clips = reader.load(path)
    if datasets is None:
        return clips
    names = [datasets] if isinstance(datasets, str) else list(datasets)
    return clips.where(F.col("dataset").isin(names))


def natural_order(clips: DataFrame, clip_id: str = "clip_id") -> DataFrame:
    return clips.orderBy(*natural_key(clip_id))


# ---------------------------------------------------------------- scores

def write_scores(scores: DataFrame, path: str) -> None:
    """Long score table, one folder per run (hyper-parameter set)."""
    scores.write.mode("overwrite").partitionBy("run").parquet(path)


def read_scores(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    scores = spark.read.schema(schema.SCORES).parquet(path)
    return scores if run is None else scores.where(F.col("run") == run)


def wide_scores(scores: DataFrame, classes, keys=("clip_id", "frame", "onset", "offset")) -> DataFrame:
    """One column per class, in the given order; for a clip length check see the frame grid."""
    return scores.groupBy(*keys).pivot("label", list(classes)).agg(F.first("score"))


def write_wide_scores(scores: DataFrame, path: str, classes) -> None:
    """TSV with ``onset, offset, <class>...``, one folder per clip."""
    wide = wide_scores(scores, classes).drop("frame")
    (wide.repartition("clip_id").sortWithinPartitions("clip_id", "onset")
     .write.mode("overwrite").partitionBy("clip_id").csv(path, sep="\t", header=True))


def read_wide_scores(spark: SparkSession, path: str, frame_length: float | None = None) -> DataFrame:
    """Wide score files back as ``clip_id, onset, offset, label, score`` (and ``frame`` where ``frame_length`` is given).

    Files are TSV, one folder ``clip_id=...`` per clip; each has a header of its own, ``onset, offset`` and any classes in any
    order. Lines are read as text, so files are split as Spark likes; only headers are looked up, by their file. Empty cells are
    left out. A clip may have several files. Files without lines below the header give nothing.
    """
    files = spark.read.text(path, recursiveFileLookup=False)          # lists all folders, once
    lines = files.select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"),
        *(["clip_id"] if "clip_id" in files.columns else [F.lit(None).cast("string").alias("clip_id")]))
    is_head = F.col("value").startswith("onset\t")
    heads = lines.where(is_head).select("_file", F.split("value", "\t").alias("_names")).dropDuplicates(["_file"])
    rows = lines.where(~is_head & (F.col("value") != "")).join(heads, "_file").withColumn("_cells", F.split("value", "\t"))
    cell = F.explode(F.arrays_zip(F.slice("_names", 3, 1 << 20).alias("label"), F.slice("_cells", 3, 1 << 20).alias("score")))
    rows = rows.select(F.col("clip_id").cast("string").alias("clip_id"), F.get("_cells", F.lit(0)).cast("double").alias("onset"),
                       F.get("_cells", F.lit(1)).cast("double").alias("offset"), cell.alias("_c"))
    rows = rows.select("clip_id", "onset", "offset", "_c.label", F.col("_c.score").try_cast("double").alias("score")).where("score is not null")
    if frame_length is not None:
        rows = rows.withColumn("frame", F.round(F.col("onset") / F.lit(float(frame_length))).cast("bigint"))
    return rows


# ---------------------------------------------------------------- detections

def write_threshold_detections(scores: DataFrame, path: str, thresholds=None) -> None:
    """Intervals for every threshold (default 50 points .01 to .99), one folder per threshold."""
    det = score_intervals(scores, thresholds or linspace(0.01, 0.99, 50))
    (det.write.mode("overwrite").partitionBy("threshold").csv(path, sep="\t", header=True))


def read_threshold_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True,
                          schema="clip_id string, label string, onset double, offset double, threshold double")


def write_detections(detections: DataFrame, path: str) -> None:
    """Intervals of one operating point."""
    detections.select("clip_id", "onset", "offset", "label").write.mode("overwrite").csv(path, sep="\t", header=True)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="clip_id string, onset double, offset double, label string")


def pseudo_label_rows(clips: DataFrame, detections: DataFrame) -> DataFrame:
    """``filename, onset, offset, event_label``; a clip without events keeps one row of empty cells."""
    return clips.select("clip_id").distinct().join(detections, "clip_id", "left").select(
        F.concat("clip_id", F.lit(".wav")).alias("filename"), "onset", "offset", F.col("label").alias("event_label"))


def write_pseudo_labels(clips: DataFrame, detections: DataFrame, path: str) -> None:
    pseudo_label_rows(clips, detections).write.mode("overwrite").csv(path, sep="\t", header=True)


# ---------------------------------------------------------------- parameters and reports

def write_json(table: DataFrame, path: str) -> None:
    """Metrics, leaderboards and hyper-parameters."""
    table.write.mode("overwrite").json(path)


def read_hyper_params(spark: SparkSession, path: str, metrics=None) -> DataFrame:
    """Parameter sets by name; sets with different window shifts raise."""
    params = spark.read.schema(schema.HYPER_PARAMS).json(path)
    if metrics is not None:
        params = params.where(F.col("metric").isin(list(metrics)))
    shifts = params.agg(F.count_distinct("window_shift").alias("n")).scalar()
    ok = F.when(shifts > 1, F.raise_error(F.lit("parameter sets with several window shifts")).cast("boolean")).otherwise(F.lit(True))
    return params.where(ok)


def class_ordered_params(params: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per set, arrays of parameters in class order."""
    fields = [c for c in params.columns if c not in ("metric", "label")]
    rows = params.join(vocabulary.select("label", "index"), "label")
    packed = rows.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("index", "label", *fields))).alias("p"))
    return packed.select("metric", F.col("p.label").alias("labels"), *[F.col(f"p.{f}").alias(f) for f in fields])


def write_text_report(rows: DataFrame, path: str, column: str = "audio_path") -> None:
    rows.orderBy(column).select(column).write.mode("overwrite").text(path)

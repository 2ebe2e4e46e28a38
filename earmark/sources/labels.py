"""Readers for label files. Every reader has an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from earmark import schema
from earmark.functions.labels import cut_last_part, strip_wav
from earmark.operators.catalog import map_codes

CODE_PATTERN = r"(/[mtg]/[\d_a-z]+)"  # fixed value: label codes inside a segment line


def _by_header(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """TSV with header; columns are found by name, whatever their order, and raise if missing. Cells that do not fit the
    type are NULL."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(layout)])


def read_code_names(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV ``code, name``."""
    return spark.read.csv(path, sep="\t", schema=schema.CODE_NAMES)


def read_class_indices(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header holding ``mid`` and ``display_name``; quotes around names go."""
    raw = spark.read.csv(path, header=True, escape='"', schema="index string, mid string, display_name string",
                         enforceSchema=False)
    return raw.select(F.col("mid").alias("code"), F.btrim("display_name", F.lit('"')).alias("name"))


def read_weak_segments(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Segment file to ``(clip_id, label)``, one row per tag.

    Lines starting with ``#`` are skipped. The cells after the id are searched for codes as text: they
    hold unquoted commas.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = lines.select(F.trim(F.substring_index("value", ",", 1)).alias("clip_id"),
                         F.regexp_replace("value", "^[^,]*,?", "").alias("rest"))
    codes = parts.select("clip_id", F.explode(F.regexp_extract_all("rest", F.lit(CODE_PATTERN), 1)).alias("code"))
    return map_codes(codes, names)


def read_strong_labels(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """TSV with header ``segment_id, onset, offset, code`` to ``(clip_id, onset, offset, label)``."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema.STRONG_LABELS)   # names of the header vary
    rows = raw.select(cut_last_part("segment_id").alias("clip_id"), "onset", "offset", "code")
    return map_codes(rows, names)


def read_strong_clip_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct clip ids of a strong label file."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema.STRONG_LABELS)   # names of the header vary
    return raw.select(cut_last_part("segment_id").alias("clip_id")).distinct()


def read_ontology(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON array of nodes to ``(id, name, child_ids)``; ``multi_line=False`` for one array per line."""
    return spark.read.json(path, schema=schema.ONTOLOGY_FILE, multiLine=multi_line)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """TSV with header to ``(clip_id, pos, onset, offset, label)``.

    With an ``onset`` column rows are events, and empty cells mean a clip without events (label NULL).
    Otherwise the second column lists the tags of a clip, separated by commas; times are NULL.
    ``pos`` numbers the tags of a line, or the events of a clip in the order of the file.
    """
    header = spark.read.csv(path, sep="\t", header=True, inferSchema=False).columns
    none = F.lit(None)
    if "onset" in header:
        raw = _by_header(spark, path, schema.GROUND_TRUTH_EVENTS).withColumn("_line", F.monotonically_increasing_id())
        place = F.row_number().over(W.partitionBy("filename").orderBy("_line")) - 1      # a clip has few events
        return raw.select(strip_wav("filename").alias("clip_id"), place.alias("pos"), "onset", "offset", F.col("event_label").alias("label"))
    raw = _by_header(spark, path, schema.GROUND_TRUTH_TAGS)
    tags = raw.select(strip_wav("filename").alias("clip_id"), F.posexplode_outer(F.split("event_labels", ",")).alias("pos", "label"))
    return tags.select("clip_id", "pos", none.cast("double").alias("onset"), none.cast("double").alias("offset"),
                       F.trim("label").alias("label"))


def read_segment_list(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``clip_id, start, end``; comments and empty rows are skipped."""
    return spark.read.csv(path, comment="#", schema=schema.SEGMENT_LIST, ignoreLeadingWhiteSpace=True).where(
        F.col("clip_id").isNotNull())

"""Tags as per-clip vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def condition_vectors(tags: DataFrame, classes) -> DataFrame:
    """``(clip_id, tag_condition)``: one boolean per class, in the given order; absent tags are false.

    One column per class is aggregated first, so a clip never gathers a list.
    """
    cols = [F.coalesce(F.bool_or(F.when(F.col("label") == c, F.col("tag"))), F.lit(False)) for c in classes]
    return tags.groupBy("clip_id").agg(F.array(*cols).alias("tag_condition"))


def attach_condition(rows: DataFrame, tags: DataFrame, classes) -> DataFrame:
    """Add the tag condition to rows of the clip."""
    return rows.join(condition_vectors(tags, classes), "clip_id", "left")

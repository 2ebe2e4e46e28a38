"""Threshold curves per class, and the best operating point on them.

Input rows carry ``label``, a ``target`` (0/1) and a ``score``. ``keys`` lists further grouping
columns, e.g. a tuning candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.scale import ROWS_PER_BUCKET, join_same, value_buckets

INF = float("inf")


def positives_curve(scored: DataFrame, keys=("label",), target: str = "target", score: str = "score",
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Counts of positives for every decision threshold between two neighbouring scores.

    One row per distinct score and one at +inf: ``threshold, n_pos, tps, n_ref`` plus the
    counts of the score itself, ``tp_at`` and ``n_at``. Ties collapse before any ordering, and a
    class with very many distinct scores is cut at its quantiles.
    """
    keys = list(keys)
    ties = scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(target).cast("double")).alias("tp_at"), F.count(F.lit(1)).alias("n_at"))
    ties = value_buckets(ties, keys, "score", rows_per_bucket)
    totals = ties.groupBy(*keys, "_bucket").agg(
        F.sum("tp_at").alias("tp"), F.sum("n_at").alias("n"), F.max("score").alias("top"))
    w = W.partitionBy(*keys).orderBy(F.col("_bucket").desc())  # from the highest score down
    above = w.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*keys)
    carried = totals.select(
        *keys, "_bucket",
        F.coalesce(F.sum("tp").over(above), F.lit(0.0)).alias("_tp_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n_above"),
        F.lead("top").over(w).alias("_below"),
        F.max("top").over(everything).alias("_top"),
        F.sum("tp").over(everything).alias("n_ref"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(F.col("score").desc())
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    below = F.coalesce(F.lead("score").over(inside), F.col("_below"))
    rows = (join_same(ties, carried, [*keys, "_bucket"])
            .withColumn("tps", F.sum("tp_at").over(upto) + F.col("_tp_above"))
            .withColumn("n_pos", F.sum("n_at").over(upto) + F.col("_n_above"))
            .withColumn("threshold", F.coalesce((F.col("score") + below) / 2, F.lit(-INF))))
    point = F.struct("threshold", "n_pos", "tps", "tp_at", "n_at")
    none_above = F.struct(F.lit(INF).alias("threshold"), F.lit(0).cast("bigint").alias("n_pos"),
                          F.lit(0.0).alias("tps"), F.lit(0.0).alias("tp_at"),
                          F.lit(0).cast("bigint").alias("n_at"))
    points = F.when(F.col("score") == F.col("_top"), F.array(point, none_above)).otherwise(F.array(point))
    return rows.select(*keys, "n_ref", F.explode(points).alias("p")).select(*keys, "n_ref", "p.*")


def fscore_columns(beta=1.0, tp_bias=0.0, n_ref_bias=0.0, n_pos_bias=0.0):
    """precision, recall and F-score from ``tps``, ``n_pos`` and ``n_ref``."""
    b2 = float(beta) ** 2
    tp = F.col("tps") + F.lit(float(tp_bias))
    p = tp / F.greatest(F.col("n_pos") + F.lit(float(n_pos_bias)), F.lit(1.0))
    r = tp / F.greatest(F.col("n_ref") + F.lit(float(n_ref_bias)), F.lit(1.0))
    f = F.lit(1.0 + b2) * p * r / (F.lit(b2) * p + r + F.lit(1e-18))
    return p, r, f


def fscore_curve(scored: DataFrame, keys=("label",), beta=1.0, tp_bias=0.0, n_ref_bias=0.0,
                 n_pos_bias=0.0, **kw) -> DataFrame:
    """``threshold, fscore, precision, recall`` for every threshold."""
    p, r, f = fscore_columns(beta, tp_bias, n_ref_bias, n_pos_bias)
    return positives_curve(scored, keys, **kw).select(
        *keys, "threshold", f.alias("fscore"), p.alias("precision"), r.alias("recall"),
        "tps", "n_pos", "n_ref")


def error_rate_curve(scored: DataFrame, keys=("label",), **kw) -> DataFrame:
    """``threshold, error_rate, insertion_rate, deletion_rate`` for every threshold."""
    ref = F.greatest(F.col("n_ref"), F.lit(1.0))
    ins, dele = F.col("n_pos") - F.col("tps"), F.col("n_ref") - F.col("tps")
    return positives_curve(scored, keys, **kw).select(
        *keys, "threshold", ((ins + dele) / ref).alias("error_rate"),
        (ins / ref).alias("insertion_rate"), (dele / ref).alias("deletion_rate"))


def best_fscore(curve: DataFrame, keys=("label",), min_precision: float = 0.0,
                min_recall: float = 0.0) -> DataFrame:
    """Best F-score per class; points below the minimum count as 0, ties take the highest threshold."""
    if min_precision > 0 and min_recall > 0:
        raise ValueError("give min_precision or min_recall, not both")
    low = (F.col("precision") < min_precision) | (F.col("recall") < min_recall)
    f = F.when(low, F.lit(0.0)).otherwise(F.col("fscore"))
    best = F.max_by(F.struct("threshold", f.alias("fscore"), "precision", "recall"),
                    F.struct(f.alias("f"), "threshold"))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def best_error_rate(curve: DataFrame, keys=("label",), max_insertion_rate=None,
                    max_deletion_rate=None) -> DataFrame:
    """Lowest error rate per class; points above a limit count as inf, ties take the highest threshold."""
    er = F.col("error_rate")
    if max_insertion_rate is not None:
        er = F.when(F.col("insertion_rate") > max_insertion_rate, F.lit(INF)).otherwise(er)
    if max_deletion_rate is not None:
        er = F.when(F.col("deletion_rate") > max_deletion_rate, F.lit(INF)).otherwise(er)
    best = F.max_by(F.struct("threshold", er.alias("error_rate"), "insertion_rate", "deletion_rate"),
                    F.struct((-er).alias("e"), "threshold"))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def average_precision(curve: DataFrame, keys=("label",)) -> DataFrame:
    """Sum of precision times recall step over a ``positives_curve``."""
    gain = F.col("tps") / F.greatest(F.col("n_pos"), F.lit(1)) * F.col("tp_at")
    return curve.groupBy(*keys).agg(
        (F.sum(gain) / F.greatest(F.max("n_ref"), F.lit(1.0))).alias("average_precision"),
        F.max("n_ref").alias("n_ref"))


def roc_auc(curve: DataFrame, keys=("label",)) -> DataFrame:
    """Mann-Whitney area: share of (positive, negative) pairs in order, ties count half."""
    neg = F.col("n_at") - F.col("tp_at")
    won = neg * (F.col("tps") - F.col("tp_at") / 2)
    n_neg = F.max("n_pos") - F.max("n_ref")
    pairs = F.max("n_ref") * n_neg
    return curve.groupBy(*keys).agg(
        F.when(pairs > 0, F.sum(won) / F.greatest(pairs, F.lit(1.0))).alias("roc_auc"),
        F.max("n_ref").alias("n_ref"))

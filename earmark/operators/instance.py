"""Instance-based metrics: counts, F-score, error rate, label ranking, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from earmark.operators import curves


def element_counts(pairs: DataFrame, target: str = "target", decision: str = "decision") -> DataFrame:
    """Element-level ``tp, fp, tn, fn``; soft values multiply."""
    t, d = F.col(target).cast("double"), F.col(decision).cast("double")
    one = F.lit(1.0)
    return pairs.withColumns({"tp": t * d, "fp": (one - t) * d, "tn": (one - t) * (one - d), "fn": t * (one - d)})


def counts(pairs: DataFrame, keys=("label",), target: str = "target", decision: str = "decision") -> DataFrame:
    """``tp, fp, tn, fn`` summed per ``keys``."""
    return element_counts(pairs, target, decision).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])


def _with_overall(per_label: DataFrame, sums, label: str = "label") -> DataFrame:
    # the micro row comes from the few per-class rows, not from a second pass over the elements
    overall = per_label.agg(*[F.sum(c).alias(c) for c in sums])
    return per_label.unionByName(overall, allowMissingColumns=True)


def prf(beta: float = 1.0) -> tuple[Column, Column, Column]:
    """F-score, precision and recall from ``tp, fp, fn``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = tp / F.greatest(tp + fp, F.lit(1.0))
    r = tp / F.greatest(tp + fn, F.lit(1.0))
    b2 = float(beta) ** 2
    f = F.lit(1 + b2) * p * r / F.greatest(F.lit(b2) * p + r, F.lit(1e-15))
    return f, p, r


def fscore(pairs: DataFrame, beta: float = 1.0, event_wise: bool = False, **cols) -> DataFrame:
    """F-score, precision, recall: one micro row (label NULL), and per class if ``event_wise``."""
    per_label = counts(pairs, ("label",), **cols)
    rows = _with_overall(per_label, ("tp", "fp", "tn", "fn"))
    if not event_wise:
        rows = rows.where(F.col("label").isNull())
    f, p, r = prf(beta)
    return rows.select("label", f.alias("fscore"), p.alias("precision"), r.alias("recall"))


def substitutions_insertions_deletions(pairs: DataFrame, instance=("clip_id",), event_wise: bool = False,
                                       target: str = "target", decision: str = "decision") -> DataFrame:
    """Totals of substitutions, insertions, deletions and references.

    Over all classes a substitution pairs an insertion with a deletion of the same instance;
    per class there are none.
    """
    e = element_counts(pairs, target, decision)
    ref = F.sum(F.col(target).cast("double")).alias("n_ref")
    if event_wise:
        return e.groupBy("label").agg(F.sum(F.lit(0.0)).alias("substitutions"), F.sum("fp").alias("insertions"),
                                      F.sum("fn").alias("deletions"), ref)
    per = e.groupBy(*instance).agg(F.sum("fp").alias("i"), F.sum("fn").alias("d"), ref)
    s = F.least("i", "d")
    return per.agg(F.sum(s).alias("substitutions"), F.sum(F.col("i") - s).alias("insertions"),
                   F.sum(F.col("d") - s).alias("deletions"), F.sum("n_ref").alias("n_ref"))


def error_rate(pairs: DataFrame, instance=("clip_id",), event_wise: bool = False, **cols) -> DataFrame:
    sid = substitutions_insertions_deletions(pairs, instance, event_wise, **cols)
    n = F.greatest(F.col("n_ref"), F.lit(1.0))
    keys = ["label"] if event_wise else []
    s, i, d = F.col("substitutions"), F.col("insertions"), F.col("deletions")
    return sid.select(*keys, ((i + d + s) / n).alias("error_rate"), (s / n).alias("substitution_rate"),
                      (i / n).alias("insertion_rate"), (d / n).alias("deletion_rate"))


def positive_class_precisions(scored: DataFrame, instance=("clip_id",), target: str = "target",
                              score: str = "score") -> DataFrame:
    """Precision of the class ranking of an instance, cut at each of its true classes.

    The window is one instance; its rows are bounded by the number of classes.
    """
    ranked = W.partitionBy(*instance).orderBy(F.col(score).desc(), F.col("label").desc())
    hit = (F.col(target) > 0).cast("int")
    upto = ranked.rowsBetween(W.unboundedPreceding, 0)
    return (scored.withColumn("rank", F.row_number().over(ranked))
            .withColumn("hits", F.sum(hit).over(upto))
            .where(hit == 1)
            .select(*instance, "label", (F.col("hits") / F.col("rank")).alias("precision_at_hit")))


def lwlrap_per_class(precisions: DataFrame) -> DataFrame:
    """Mean precision per class and its share of all labels."""
    per = precisions.groupBy("label").agg(F.avg("precision_at_hit").alias("lwlrap"),
                                          F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())  # one row per class
    return per.select("label", "lwlrap", (F.col("n") / total).alias("weight"))


def lwlrap(scored: DataFrame, instance=("clip_id",), classes: DataFrame | None = None, **cols) -> DataFrame:
    """Label-weighted label-ranking average precision: per class and overall (label NULL).

    Classes without a positive get value 0 and weight 0; without any positive the overall value is 0.
    """
    classes = scored.select("label").distinct() if classes is None else classes
    per = lwlrap_per_class(positive_class_precisions(scored, instance, **cols))
    per = classes.join(per, "label", "left").na.fill(0.0, ["lwlrap", "weight"])
    overall = per.agg(F.coalesce(F.sum(F.col("lwlrap") * F.col("weight")), F.lit(0.0)).alias("lwlrap"),
                      F.sum("weight").alias("weight"))
    return per.unionByName(overall, allowMissingColumns=True)


def report(scored: DataFrame, instance=("clip_id",), labelwise=(), labels=None) -> DataFrame:
    """Macro metrics as ``(metric, label, value)``; names in ``labelwise`` also per class.

    ``map`` and ``mauc`` appear only if every class has more than one positive.
    """
    if labels is not None:
        scored = scored.where(F.col("label").isin(list(labels)))
    curve = curves.positives_curve(scored)
    _, _, f = curves.fscore_columns()
    n_ref, n_pos, tps = F.col("n_ref"), F.col("n_pos"), F.col("tps")
    er = (n_pos + n_ref - tps - tps) / F.greatest(n_ref, F.lit(1.0))
    won = (F.col("n_at") - F.col("tp_at")) * (tps - F.col("tp_at") / 2)
    n_neg = F.max("n_pos") - F.max("n_ref")
    # one pass over the curve gives every per-class metric
    per_class = curve.groupBy("label").agg(
        F.max(f).alias("fscore"), F.min(er).alias("error_rate"),
        (F.sum(tps / F.greatest(n_pos, F.lit(1)) * F.col("tp_at")) / F.greatest(F.max("n_ref"), F.lit(1.0))).alias("ap"),
        (F.sum(won) / F.greatest(F.max("n_ref") * n_neg, F.lit(1.0))).alias("auc"), F.max("n_ref").alias("n_ref"))
    rank = lwlrap(scored, instance)

    def tall(row, pairs):
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in pairs])).alias("c")
        return row.select(*[c for c in row.columns if c == "label"], cells).select(
            "c.metric", *[c for c in row.columns if c == "label"], "c.value")

    enough = F.min("n_ref") > 1
    means = per_class.agg(F.avg("fscore").alias("f"), F.avg("error_rate").alias("e"),
                          F.when(enough, F.avg("ap")).alias("map"), F.when(enough, F.avg("auc")).alias("mauc"))
    macro = tall(means, [("macro_fscore", F.col("f")), ("macro_error_rate", F.col("e")), ("map", F.col("map")),
                         ("mauc", F.col("mauc"))]).where(F.col("value").isNotNull())
    out = macro.unionByName(rank.where(F.col("label").isNull()).select(F.lit("lwlrap").alias("metric"), F.col("lwlrap").alias("value")))
    out = out.withColumn("label", F.lit(None).cast("string"))
    names = [m for m in ("fscore", "error_rate", "ap", "auc") if m in labelwise]
    if names:
        out = out.unionByName(tall(per_class, [(m, F.col(m)) for m in names]))
    if "lwlrap" in labelwise:
        out = out.unionByName(rank.where(F.col("label").isNotNull()).select(
            F.lit("lwlrap").alias("metric"), "label", F.col("lwlrap").alias("value")))
    return out.select("metric", "label", "value")


def mean_scalars(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Mean of scalar metrics over batches."""
    return rows.groupBy(key).agg(F.avg(value).alias(value))


def restrict_labels(rows: DataFrame, labels=None, indices=None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Keep the classes given by name, or by index in a ``(label, index)`` vocabulary."""
    if labels is not None:
        return rows.where(F.col("label").isin(list(labels)))
    wanted = vocabulary.where(F.col("index").isin(list(indices))).select("label")
    return rows.join(wanted, "label", "left_semi")

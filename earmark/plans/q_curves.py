"""Curves, operating points and instance metrics."""

from pyspark.sql import functions as F

from earmark.operators import collar, curves, instance, losses
from earmark.operators.detect import clip_scores, clip_tags
from earmark.plans import views as v
from earmark.plans.registry import query, tidy

_FINITE = "CASE WHEN isfinite(threshold) THEN round(threshold, 6) END AS threshold"


@query("r1_positives_curve", f"""
SELECT label, {_FINITE}, CAST(n_pos AS BIGINT) AS n_pos, CAST(tps AS DOUBLE) AS tps,
       CAST(n_ref AS DOUBLE) AS n_ref FROM v_curve""", "v_curve")
def positives_curve(spark, sf_dir):
    return tidy(curves.positives_curve(v.targets(spark, sf_dir)).drop("tp_at", "n_at"))


@query("r2_fscore_curve", f"""
SELECT label, {_FINITE}, round(fscore, 6) AS fscore, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM v_fcurve""", "v_fcurve")
def fscore_curve(spark, sf_dir):
    c = curves.fscore_curve(v.targets(spark, sf_dir))
    return tidy(c.select("label", "threshold", "fscore", "precision", "recall"))


@query("r2_fscore_curve_biased", f"""
SELECT label, {_FINITE}, round(5e0 * p * r / (4e0 * p + r + 1e-18), 6) AS fscore FROM (
  SELECT label, threshold, (tps + 1) / greatest(n_pos + 2, 1e0) AS p, (tps + 1) / greatest(n_ref + 3, 1e0) AS r
  FROM v_curve)""", "v_curve")
def fscore_curve_biased(spark, sf_dir):
    c = curves.fscore_curve(v.targets(spark, sf_dir), beta=2.0, tp_bias=1, n_pos_bias=2, n_ref_bias=3)
    return tidy(c.select("label", "threshold", "fscore"))


@query("r3_error_rate_curve", f"""
SELECT label, {_FINITE}, round(error_rate, 6) AS error_rate, round(insertion_rate, 6) AS insertion_rate,
       round(deletion_rate, 6) AS deletion_rate FROM v_ecurve""", "v_ecurve")
def error_rate_curve(spark, sf_dir):
    return tidy(curves.error_rate_curve(v.targets(spark, sf_dir)))


_BEST_F = """
SELECT label, {finite}, round(f, 6) AS fscore, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, threshold DESC) AS rn FROM (
    SELECT *, CASE WHEN precision < {p} OR recall < {r} THEN 0e0 ELSE fscore END AS f FROM v_fcurve)) WHERE rn = 1"""


@query("k1_best_fscore", _BEST_F.format(finite=_FINITE, p="0e0", r="0e0"), "v_fcurve")
def best_fscore(spark, sf_dir):
    return tidy(curves.best_fscore(curves.fscore_curve(v.targets(spark, sf_dir))))


@query("k1_best_fscore_min_precision", _BEST_F.format(finite=_FINITE, p="0.53e0", r="0e0"), "v_fcurve")
def best_fscore_min_precision(spark, sf_dir):
    return tidy(curves.best_fscore(curves.fscore_curve(v.targets(spark, sf_dir)), min_precision=0.53))


@query("k1_best_fscore_min_recall", _BEST_F.format(finite=_FINITE, p="0e0", r="0.9e0"), "v_fcurve")
def best_fscore_min_recall(spark, sf_dir):
    return tidy(curves.best_fscore(curves.fscore_curve(v.targets(spark, sf_dir)), min_recall=0.9))


_BEST_ER = """
SELECT label, {finite}, CASE WHEN isfinite(e) THEN round(e, 6) END AS error_rate,
       round(insertion_rate, 6) AS insertion_rate, round(deletion_rate, 6) AS deletion_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY e, threshold DESC) AS rn FROM (
    SELECT *, CASE WHEN insertion_rate > {i} OR deletion_rate > {d} THEN 'inf'::DOUBLE ELSE error_rate END AS e
    FROM v_ecurve)) WHERE rn = 1"""


@query("k2_best_error_rate", _BEST_ER.format(finite=_FINITE, i="1e9", d="1e9"), "v_ecurve")
def best_error_rate(spark, sf_dir):
    return tidy(curves.best_error_rate(curves.error_rate_curve(v.targets(spark, sf_dir))))


@query("k2_best_error_rate_limited", _BEST_ER.format(finite=_FINITE, i="0.3e0", d="0.9e0"), "v_ecurve")
def best_error_rate_limited(spark, sf_dir):
    return tidy(curves.best_error_rate(curves.error_rate_curve(v.targets(spark, sf_dir)), max_insertion_rate=0.3,
                                       max_deletion_rate=0.9))


# ---------------------------------------------------------------- fixed decisions

def _decided(spark, sf_dir):
    """One decision per clip and class: soft target, score above .4."""
    w, s = v.weak_truth(spark, sf_dir), clip_scores(v.scores(spark, sf_dir))
    return w.join(s, ["clip_id", "label"]).withColumn("decision", (F.col("score") > 0.6).cast("double"))


_DECIDED = """
decided AS (SELECT clip_id, label, target, score, CASE WHEN score > 0.6e0 THEN 1e0 ELSE 0e0 END AS decision
            FROM v_weak JOIN v_clip_scores USING (clip_id, label)),
el AS (SELECT *, target * decision AS tp, (1 - target) * decision AS fp, (1 - target) * (1 - decision) AS tn,
              target * (1 - decision) AS fn FROM decided)"""


@query("a10_element_counts", f"WITH {_DECIDED} SELECT clip_id, label, tp, fp, tn, fn FROM el", "v_weak", "v_clip_scores")
def element_counts(spark, sf_dir):
    return tidy(instance.element_counts(_decided(spark, sf_dir)).select("clip_id", "label", "tp", "fp", "tn", "fn"))


@query("a10_counts", f"WITH {_DECIDED} SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM el GROUP BY 1",
       "v_weak", "v_clip_scores")
def counts(spark, sf_dir):
    return tidy(instance.counts(_decided(spark, sf_dir)))


@query("a11_fscore", f"""WITH {_DECIDED}
SELECT label, round(2e0 * p * r / greatest(p + r, 1e-15), 6) AS fscore, round(p, 6) AS precision, round(r, 6) AS recall FROM (
  SELECT label, sum(tp) / greatest(sum(tp) + sum(fp), 1e0) AS p, sum(tp) / greatest(sum(tp) + sum(fn), 1e0) AS r
  FROM el GROUP BY GROUPING SETS ((label), ()))""", "v_weak", "v_clip_scores")
def fscore(spark, sf_dir):
    return tidy(instance.fscore(_decided(spark, sf_dir), event_wise=True))


@query("a12_substitutions", f"""WITH {_DECIDED},
per AS (SELECT clip_id, sum(fp) AS i, sum(fn) AS d, sum(target) AS n FROM el GROUP BY 1)
SELECT sum(least(i, d)) AS substitutions, sum(i - least(i, d)) AS insertions, sum(d - least(i, d)) AS deletions,
       sum(n) AS n_ref FROM per""", "v_weak", "v_clip_scores")
def substitutions(spark, sf_dir):
    return tidy(instance.substitutions_insertions_deletions(_decided(spark, sf_dir)))


@query("a13_error_rate", f"""WITH {_DECIDED},
per AS (SELECT clip_id, sum(fp) AS i, sum(fn) AS d, sum(target) AS n FROM el GROUP BY 1),
s AS (SELECT sum(least(i, d)) AS s, sum(i - least(i, d)) AS i, sum(d - least(i, d)) AS d, greatest(sum(n), 1) AS n FROM per)
SELECT round((s + i + d) / n, 6) AS error_rate, round(s / n, 6) AS substitution_rate, round(i / n, 6) AS insertion_rate,
       round(d / n, 6) AS deletion_rate FROM s""", "v_weak", "v_clip_scores")
def error_rate(spark, sf_dir):
    return tidy(instance.error_rate(_decided(spark, sf_dir)))


@query("a13_error_rate_per_class", f"""WITH {_DECIDED}
SELECT label, round((sum(fp) + sum(fn)) / greatest(sum(target), 1), 6) AS error_rate, 0e0 AS substitution_rate,
       round(sum(fp) / greatest(sum(target), 1), 6) AS insertion_rate,
       round(sum(fn) / greatest(sum(target), 1), 6) AS deletion_rate FROM el GROUP BY 1""", "v_weak", "v_clip_scores")
def error_rate_per_class(spark, sf_dir):
    return tidy(instance.error_rate(_decided(spark, sf_dir), event_wise=True))


# ---------------------------------------------------------------- label ranking

_RANK = """
rk AS (SELECT *, row_number() OVER w AS rank,
              sum(CASE WHEN target > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY score DESC, label DESC
                  ROWS UNBOUNDED PRECEDING) AS hits FROM v_rank WINDOW w AS (PARTITION BY clip_id ORDER BY score DESC, label DESC)),
prec AS (SELECT clip_id, label, hits / CAST(rank AS DOUBLE) AS p FROM rk WHERE target > 0),
per AS (SELECT label, avg(p) AS l, count(*) AS n FROM prec GROUP BY 1),
lw AS (SELECT c.label, coalesce(l, 0e0) AS l, coalesce(n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM per) AS w
       FROM (SELECT DISTINCT label FROM v_rank) c LEFT JOIN per USING (label))"""


@query("r5_positive_class_precisions", f"WITH {_RANK} SELECT clip_id, label, round(p, 6) AS precision_at_hit FROM prec", "v_rank")
def positive_class_precisions(spark, sf_dir):
    return tidy(instance.positive_class_precisions(v.ranked(spark, sf_dir)))


@query("a14_lwlrap", f"""WITH {_RANK}
SELECT label, round(l, 6) AS lwlrap, round(w, 6) AS weight FROM lw
UNION ALL SELECT NULL, round(sum(l * w), 6), round(sum(w), 6) FROM lw""", "v_rank")
def lwlrap(spark, sf_dir):
    return tidy(instance.lwlrap(v.ranked(spark, sf_dir)))


_AP = """
ap AS (SELECT label, sum(tps / greatest(n_pos, 1e0) * tp_at) / greatest(max(n_ref), 1e0) AS a, max(n_ref) AS n FROM {curve} GROUP BY 1)"""
_AUC = """
auc AS (SELECT label, sum((n_at - tp_at) * (tps - tp_at / 2e0)) / greatest(max(n_ref) * (max(n_pos) - max(n_ref)), 1e0) AS a,
               max(n_ref) AS n FROM {curve} GROUP BY 1)"""


@query("a15_average_precision", f"WITH {_AP.format(curve='v_curve')} SELECT label, round(a, 6) AS average_precision FROM ap", "v_curve")
def average_precision(spark, sf_dir):
    return tidy(curves.average_precision(curves.positives_curve(v.targets(spark, sf_dir))).drop("n_ref"))


@query("a16_roc_auc", """
WITH r AS (SELECT label, target, rank() OVER (PARTITION BY label ORDER BY score)
                  + (count(*) OVER (PARTITION BY label, score) - 1) / 2e0 AS rk FROM v_targets)
SELECT label, round((sum(CASE WHEN target > 0 THEN rk ELSE 0 END) - sum(target) * (sum(target) + 1) / 2e0)
             / (sum(target) * (count(*) - sum(target))), 6) AS roc_auc FROM r GROUP BY 1""", "v_targets")
def roc_auc(spark, sf_dir):
    return tidy(curves.roc_auc(curves.positives_curve(v.targets(spark, sf_dir))).drop("n_ref"))


_RANK_CURVE = """
rcurve AS (
  SELECT label, coalesce((score + lag(score) OVER (PARTITION BY label ORDER BY score)) / 2, '-inf'::DOUBLE) AS threshold,
         sum(n_at) OVER (PARTITION BY label ORDER BY score DESC) AS n_pos,
         sum(tp_at) OVER (PARTITION BY label ORDER BY score DESC) AS tps,
         sum(tp_at) OVER (PARTITION BY label) AS n_ref, tp_at, n_at
  FROM (SELECT label, score, sum(target) AS tp_at, count(*) AS n_at FROM v_rank GROUP BY 1, 2)
  UNION ALL SELECT label, 'inf'::DOUBLE, 0, 0, sum(target), 0, 0 FROM v_rank GROUP BY label),
best AS (SELECT label, max(2e0 * p * r / (p + r + 1e-18)) AS f, min(e) AS e FROM (
  SELECT label, tps / greatest(n_pos, 1e0) AS p, tps / greatest(n_ref, 1e0) AS r,
         ((n_pos - tps) + (n_ref - tps)) / greatest(n_ref, 1e0) AS e FROM rcurve) GROUP BY 1)"""


@query("a20_report", f"""WITH {_RANK}, {_RANK_CURVE}, {_AP.format(curve='rcurve')}, {_AUC.format(curve='rcurve')}
SELECT 'macro_fscore' AS metric, CAST(NULL AS VARCHAR) AS label, round(avg(f), 6) AS value FROM best
UNION ALL SELECT 'macro_error_rate', NULL, round(avg(e), 6) FROM best
UNION ALL SELECT 'lwlrap', NULL, round(sum(l * w), 6) FROM lw
UNION ALL SELECT 'map', NULL, round(avg(a), 6) FROM ap
UNION ALL SELECT 'mauc', NULL, round(avg(a), 6) FROM auc
UNION ALL SELECT 'fscore', label, round(f, 6) FROM best
UNION ALL SELECT 'auc', label, round(a, 6) FROM auc""", "v_rank")
def report(spark, sf_dir):
    return tidy(instance.report(v.ranked(spark, sf_dir), labelwise=("fscore", "auc")))


@query("p15_label_subset", f"""WITH {_RANK}
SELECT clip_id, label, round(score, 6) AS score FROM v_rank WHERE label IN ('c01', 'c04', 'c07')""", "v_rank")
def label_subset(spark, sf_dir):
    from earmark.operators.prepare import vocabulary
    rows = v.ranked(spark, sf_dir)
    picked = instance.restrict_labels(rows, indices=[1, 4, 7], vocabulary=vocabulary(rows))
    return tidy(picked.select("clip_id", "label", "score"))


@query("a21_mean_scalars", """
SELECT event_type AS key, round(avg(value), 6) AS value FROM events GROUP BY 1""")
def mean_scalars(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value")
    return tidy(instance.mean_scalars(e))


# ---------------------------------------------------------------- losses

def _loss_frames(spark, sf_dir):
    t = v.frame_targets(spark, sf_dir)
    return t.select("clip_id", "label", "frame", (F.col("score") * 0.98 + 0.01).alias("fwd"),
                    (F.col("score") * 0.5 + 0.25).alias("bwd"), F.col("target").alias("boundary_target"), "soft")


_LOSS = """
lf AS (SELECT clip_id, label, frame, score * 0.98e0 + 0.01e0 AS fwd, score * 0.5e0 + 0.25e0 AS bwd, target AS bt, soft
       FROM v_frame_targets),
lw AS (SELECT clip_id, label, CASE WHEN target < 0.01e0 OR target > 0.99e0 THEN target ELSE 0e0 END AS weak,
              CASE WHEN target < 0.01e0 OR target > 0.99e0 THEN 1e0 ELSE 0e0 END AS known FROM v_weak),
sm AS (SELECT *, least(greatest(weak, 0.1e0), 0.9e0) AS t, greatest(fwd, bwd) AS p FROM lf JOIN lw USING (clip_id, label))"""


@query("p10_masked_targets", """
SELECT clip_id, label, frame, soft < 0.01e0 OR soft > 0.99e0 AS known,
       CASE WHEN soft < 0.01e0 OR soft > 0.99e0 THEN soft ELSE 0e0 END AS target FROM v_frame_targets""", "v_frame_targets")
def masked_targets(spark, sf_dir):
    t = v.frame_targets(spark, sf_dir).select("clip_id", "label", "frame", F.col("soft").alias("target"))
    return tidy(losses.mask_targets(t))


@query("p10_label_rate", """
SELECT round(avg(CASE WHEN target < 0.01e0 OR target > 0.99e0 THEN 1e0 ELSE 0e0 END), 6) AS label_rate FROM v_weak""", "v_weak")
def label_rate(spark, sf_dir):
    return tidy(losses.label_rate(v.weak_truth(spark, sf_dir)))


@query("p11_fully_labeled", """
SELECT clip_id FROM v_weak GROUP BY 1 HAVING bool_and(target < 0.01e0 OR target > 0.99e0)""", "v_weak")
def fully_labeled(spark, sf_dir):
    return losses.fully_labeled_clips(v.weak_truth(spark, sf_dir))


@query("p11_fully_labeled_frames", """
SELECT clip_id FROM (SELECT clip_id, label, avg(CASE WHEN sure < 0.01e0 OR sure > 0.99e0 THEN 1e0 ELSE 0e0 END) AS r
  FROM v_frame_targets GROUP BY 1, 2) GROUP BY 1 HAVING min(r) > 0.999e0""", "v_frame_targets")
def fully_labeled_frames(spark, sf_dir):
    t = v.frame_targets(spark, sf_dir).select("clip_id", "label", F.col("sure").alias("target"))
    return losses.fully_labeled_clips(t, framewise=True)


@query("a17_weak_loss", f"""WITH {_LOSS},
per AS (SELECT clip_id, label, avg(-(t * ln(p) + (1 - t) * ln(1 - p)) * known) AS l, max(known) AS k FROM sm GROUP BY 1, 2)
SELECT round(sum(l * k * CASE WHEN label = 'click' THEN 2e0 ELSE 1e0 END)
             / sum(k * CASE WHEN label = 'click' THEN 2e0 ELSE 1e0 END), 6) AS loss FROM per""", "v_frame_targets", "v_weak")
def weak_loss(spark, sf_dir):
    weights = {"click": 2.0, "error": 1.0, "purchase": 1.0, "signup": 1.0, "view": 1.0}
    return tidy(losses.weak_log_loss(_loss_frames(spark, sf_dir), v.weak_truth(spark, sf_dir), 0.1, weights))


@query("a17_weak_loss_with_boundaries", f"""WITH {_LOSS},
bt AS (SELECT *, max(least(greatest(bt, 0.1e0), 0.9e0)) OVER (PARTITION BY clip_id, label ORDER BY frame) AS tf,
              max(least(greatest(bt, 0.1e0), 0.9e0)) OVER (PARTITION BY clip_id, label ORDER BY frame DESC) AS tb FROM sm),
per AS (SELECT clip_id, label, avg(-(t * ln(p) + (1 - t) * ln(1 - p)) * known) AS w,
               avg((-(tf * ln(fwd) + (1 - tf) * ln(1 - fwd)) - (tb * ln(bwd) + (1 - tb) * ln(1 - bwd))) / 2) AS s,
               max(known) AS k, max(weak) AS weak FROM bt GROUP BY 1, 2)
SELECT round(sum(CASE WHEN weak > 0.99e0 THEN 0.7e0 * s + 0.3e0 * w ELSE w END * k) / sum(k), 6) AS loss FROM per""",
       "v_frame_targets", "v_weak")
def weak_loss_with_boundaries(spark, sf_dir):
    return tidy(losses.weak_log_loss(_loss_frames(spark, sf_dir), v.weak_truth(spark, sf_dir), 0.1,
                                     strong_fwd_bwd_loss_weight=0.7))


@query("a17_weak_loss_forward", f"""WITH {_LOSS},
lt AS (SELECT clip_id, label, max_by(fwd, frame) AS p, max(t) AS t, max(known) AS k FROM sm GROUP BY 1, 2)
SELECT round(sum(-(t * ln(p) + (1 - t) * ln(1 - p)) * k) / sum(k), 6) AS loss FROM lt""", "v_frame_targets", "v_weak")
def weak_loss_forward(spark, sf_dir):
    """Scores of one direction: the last frame of a clip counts."""
    return tidy(losses.weak_log_loss(_loss_frames(spark, sf_dir).drop("bwd"), v.weak_truth(spark, sf_dir), 0.1))


@query("a17_weak_targets_as_boundaries", f"""WITH {_LOSS},
per AS (SELECT clip_id, label, avg(-(t * ln(p) + (1 - t) * ln(1 - p)) * known) AS w, avg(-(t * ln(fwd) + (1 - t) * ln(1 - fwd)) / 2
               - (t * ln(bwd) + (1 - t) * ln(1 - bwd)) / 2) AS s, max(known) AS k, max(weak) AS weak FROM sm GROUP BY 1, 2)
SELECT round(sum(CASE WHEN weak > 0.99e0 THEN 0.7e0 * s + 0.3e0 * w ELSE w END * k) / sum(k), 6) AS loss FROM per""", "v_frame_targets", "v_weak")
def weak_targets_as_boundaries(spark, sf_dir):
    return tidy(losses.weak_log_loss(_loss_frames(spark, sf_dir).drop("boundary_target"), v.weak_truth(spark, sf_dir), 0.1,
                                     strong_fwd_bwd_loss_weight=0.7, weak_as_boundaries=True))


@query("a18_strong_loss", """
SELECT round(sum(CASE WHEN k THEN -(soft * ln(p) + (1 - soft) * ln(1 - p)) END) / greatest(count(*) FILTER (k), 1), 6) AS loss
FROM (SELECT soft, score * 0.98e0 + 0.01e0 AS p, soft < 0.01e0 OR soft > 0.99e0 AS k FROM v_frame_targets)""", "v_frame_targets")
def strong_loss(spark, sf_dir):
    return tidy(losses.strong_log_loss(_loss_frames(spark, sf_dir), "fwd", "soft"))


@query("a18_fwd_bwd_loss", f"""WITH {_LOSS},
c AS (SELECT *, max(bt) OVER (PARTITION BY clip_id, label ORDER BY frame) AS tf,
             max(bt) OVER (PARTITION BY clip_id, label ORDER BY frame DESC) AS tb FROM lf)
SELECT clip_id, label, frame,
       round((-(tf * ln(fwd) + (1 - tf) * ln(1 - fwd)) - (tb * ln(bwd) + (1 - tb) * ln(1 - bwd))) / 2, 6) AS strong_loss
FROM c""", "v_frame_targets", "v_weak")
def fwd_bwd_loss(spark, sf_dir):
    out = losses.fwd_bwd_log_loss(_loss_frames(spark, sf_dir))
    return tidy(out.select("clip_id", "label", "frame", "strong_loss"))


@query("a18_fwd_loss", f"""WITH {_LOSS},
c AS (SELECT *, max(bt) OVER (PARTITION BY clip_id, label ORDER BY frame) AS tf FROM lf)
SELECT clip_id, label, frame, round(-(tf * ln(fwd) + (1 - tf) * ln(1 - fwd)), 6) AS strong_loss FROM c""", "v_frame_targets", "v_weak")
def fwd_loss(spark, sf_dir):
    out = losses.fwd_bwd_log_loss(_loss_frames(spark, sf_dir).drop("bwd"))
    return tidy(out.select("clip_id", "label", "frame", "strong_loss"))


@query("a19_segment_max", """
SELECT clip_id, label, frame // 5 AS segment, round(max(score), 6) AS score, max(target) AS target
FROM v_frame_targets GROUP BY 1, 2, 3""", "v_frame_targets")
def segment_max(spark, sf_dir):
    return tidy(losses.segment_max(v.frame_targets(spark, sf_dir), 5))


# ---------------------------------------------------------------- clip based

_THR = {"click": 0.7, "error": 0.75, "purchase": 0.6, "signup": 0.65, "view": 0.7}
_THR_SQL = "(VALUES " + ", ".join(f"('{k}', {x}e0)" for k, x in _THR.items()) + ") t(label, threshold)"


@query("p12_clip_tags", f"""
SELECT clip_id, s.label, s.score > t.threshold AS tag FROM v_clip_scores s JOIN {_THR_SQL} ON s.label = t.label""", "v_clip_scores")
def tags(spark, sf_dir):
    return clip_tags(clip_scores(v.scores(spark, sf_dir)), _THR)


@query("a8_clip_scores", "SELECT clip_id, label, round(score, 6) AS score FROM v_clip_scores", "v_clip_scores")
def clip_score(spark, sf_dir):
    return tidy(clip_scores(v.scores(spark, sf_dir)))


def _hard(spark, sf_dir):
    return v.weak_truth(spark, sf_dir).withColumn("target", F.when(F.col("target") > 0.9, 1.0).otherwise(0.0))


@query("a22_clip_based_fscore", f"""
WITH d AS (SELECT s.label, CASE WHEN s.score > t.threshold THEN 1e0 ELSE 0e0 END AS d, CASE WHEN w.target > 0.9e0 THEN 1e0 ELSE 0e0 END AS g
           FROM v_clip_scores s JOIN {_THR_SQL} ON s.label = t.label JOIN v_weak w ON w.clip_id = s.clip_id AND w.label = s.label),
c AS (SELECT label, sum(d * g) AS tp, sum(d) AS n_sys, sum(g) AS n_ref FROM d GROUP BY 1
      UNION ALL SELECT 'micro_average', sum(d * g), sum(d), sum(g) FROM d),
f AS (SELECT label, tp, n_sys, n_ref, tp / greatest(n_sys, 1) AS p, tp / greatest(n_ref, 1) AS r FROM c),
x AS (SELECT *, 2e0 * p * r / greatest(p + r, 1e-15) AS f FROM f)
SELECT label, tp, n_sys, n_ref, round(f, 6) AS fscore, round(p, 6) AS precision, round(r, 6) AS recall FROM x
UNION ALL SELECT 'macro_average', sum(tp), sum(n_sys), sum(n_ref), round(avg(f), 6), round(avg(p), 6), round(avg(r), 6)
FROM x WHERE label <> 'micro_average'""", "v_clip_scores", "v_weak")
def clip_based_fscore(spark, sf_dir):
    t = clip_tags(clip_scores(v.scores(spark, sf_dir)), _THR).join(_hard(spark, sf_dir), ["clip_id", "label"])
    return tidy(collar.prf_table(collar.clip_based_counts(t)))


@query("a23_clip_based_best_fscore", f"""
WITH t AS (SELECT s.label, s.score, CASE WHEN w.target > 0.9e0 THEN 1e0 ELSE 0e0 END AS g
           FROM v_clip_scores s JOIN v_weak w ON w.clip_id = s.clip_id AND w.label = s.label),
c AS (SELECT label, coalesce((score + lag(score) OVER (PARTITION BY label ORDER BY score)) / 2, '-inf'::DOUBLE) AS threshold,
             sum(n) OVER d AS n_pos, sum(g) OVER d AS tps, sum(g) OVER (PARTITION BY label) AS n_ref
      FROM (SELECT label, score, sum(g) AS g, count(*) AS n FROM t GROUP BY 1, 2)
      WINDOW d AS (PARTITION BY label ORDER BY score DESC)),
f AS (SELECT label, threshold, tps / greatest(n_pos, 1) AS p, tps / greatest(n_ref, 1) AS r FROM c),
x AS (SELECT *, 2e0 * p * r / (1e0 * p + r + 1e-18) AS f FROM f)
SELECT label, {_FINITE}, round(f, 6) AS fscore, round(p, 6) AS precision, round(r, 6) AS recall FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, threshold DESC) AS rn FROM x) WHERE rn = 1""",
       "v_clip_scores", "v_weak")
def clip_based_best(spark, sf_dir):
    t = clip_scores(v.scores(spark, sf_dir)).join(_hard(spark, sf_dir), ["clip_id", "label"])
    return tidy(collar.clip_based_best_fscore(t))

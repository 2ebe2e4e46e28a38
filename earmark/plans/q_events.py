"""Event matching, collar and intersection metrics, tuning, pseudo-labels
(J13-J16, A7, A24-A32, K3, U3, U7s, S13-S15)."""

from pyspark.sql import functions as F

from earmark.operators import collar, detect, intersection, matching, pseudo, targets, tuning
from earmark.plans import views as v
from earmark.plans.registry import query, tidy
from earmark.scale import cut_lineage

# ---------------------------------------------------------------- collar based

_PAIRS = """
pairs AS (SELECT d.clip_id, d.label, det_id, gt_id, d.onset - g.onset AS od, d."offset" - g."offset" AS fd,
                 d.onset AS d_on, d."offset" AS d_off, g.onset AS g_on, g."offset" AS g_off
          FROM v_det d JOIN v_gt g ON d.clip_id = g.clip_id AND d.label = g.label
          WHERE abs(d.onset - g.onset) <= {c}e0
            AND abs(d."offset" - g."offset") <= greatest({c}e0, {rate}e0 * (g."offset" - g.onset)))"""


def _timed_sql(pairs, series, det, gt, kind):
    """Detections in order of time take the free candidate with the earliest deadline, one detection of every series a step."""
    order = f"d_on, d_off, {det}"
    same = " AND ".join(f"mr.{c} = cd.{c}" for c in series)
    by = ", ".join(series)
    return f"""
dk AS (SELECT *, dense_rank() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {pairs}),
dl AS (SELECT *, max(k) OVER (PARTITION BY {by}, {gt}) AS deadline FROM dk),
cd AS (SELECT {by}, k, list({gt} ORDER BY deadline, g_on, g_off, {gt}) AS gts FROM dl GROUP BY {by}, k),
mr AS (SELECT DISTINCT {by}, 0::BIGINT AS k, CAST([] AS {kind}[]) AS used, NULL::{kind} AS pick FROM {pairs}
       UNION ALL SELECT {by}, k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, p FROM (
         SELECT {", ".join("mr." + c for c in series)}, mr.k + 1 AS k, mr.used, list_filter(cd.gts, lambda x: NOT list_contains(mr.used, x))[1] AS p
         FROM mr JOIN cd ON {same} AND cd.k = mr.k + 1)),
m AS (SELECT cd.* FROM dl cd JOIN mr ON {same} AND cd.k = mr.k AND cd.{gt} = mr.pick)"""


def _greedy_sql(collar_, rate):
    return _PAIRS.format(c=collar_, rate=rate).strip() + "," + _timed_sql("pairs", ("clip_id", "label"), "det_id", "gt_id", "BIGINT")


@query("j13_collar_pairs", f"""WITH {_PAIRS.format(c=2, rate=0.2)}
SELECT clip_id, label, det_id, gt_id, round(od, 6) AS onset_dist, round(fd, 6) AS offset_dist FROM pairs""", "v_gt", "v_det")
def collar_pairs(spark, sf_dir):
    p = matching.collar_pairs(v.detections(spark, sf_dir), v.ground_truth(spark, sf_dir), 2.0, 2.0, 0.2)
    return tidy(p.select("clip_id", "label", "det_id", "gt_id", "onset_dist", "offset_dist"))


@query("j13_collar_unique_pairs", f"""WITH {_PAIRS.format(c=12, rate=0.2)}
SELECT clip_id, label, det_id, gt_id FROM pairs
WHERE det_id IN (SELECT det_id FROM pairs GROUP BY 1 HAVING count(*) = 1)
  AND gt_id IN (SELECT gt_id FROM pairs GROUP BY 1 HAVING count(*) = 1)""", "v_gt", "v_det")
def collar_unique_pairs(spark, sf_dir):
    p = matching.collar_pairs(v.detections(spark, sf_dir), v.ground_truth(spark, sf_dir), 12.0, 12.0, 0.2)
    return tidy(matching.unique_pairs(p, ["det_id"], ["gt_id"]).select("clip_id", "label", "det_id", "gt_id"))


@query("j13_collar_one_to_one", f"""WITH RECURSIVE {_greedy_sql(12, 0.2)}
SELECT clip_id, label, det_id, gt_id FROM m""", "v_gt", "v_det")
def collar_one_to_one(spark, sf_dir):
    p = matching.collar_pairs(v.detections(spark, sf_dir), v.ground_truth(spark, sf_dir), 12.0, 12.0, 0.2)
    return tidy(matching.one_to_one(p, ["det_id"], ["gt_id"]).select("clip_id", "label", "det_id", "gt_id"))


@query("a24_collar_fscore", f"""WITH RECURSIVE {_greedy_sql(12, 0.2)},
t AS (SELECT label, count(*) AS tp, sum(od) AS os, sum(fd) AS fs FROM m GROUP BY 1),
c AS (SELECT label, coalesce(tp, 0) AS tp, n_sys, n_ref, coalesce(os, 0e0) AS os, coalesce(fs, 0e0) AS fs
      FROM (SELECT label, count(*) AS n_sys FROM v_det GROUP BY 1) JOIN (SELECT label, count(*) AS n_ref FROM v_gt GROUP BY 1) USING (label)
      LEFT JOIN t USING (label)),
u AS (SELECT label, tp, n_sys, n_ref FROM c UNION ALL SELECT 'micro_average', sum(tp), sum(n_sys), sum(n_ref) FROM c),
f AS (SELECT *, CAST(tp AS DOUBLE) / greatest(n_sys, 1) AS p, CAST(tp AS DOUBLE) / greatest(n_ref, 1) AS r FROM u),
x AS (SELECT *, 2e0 * p * r / greatest(p + r, 1e-15) AS f FROM f),
y AS (SELECT * FROM x UNION ALL SELECT 'macro_average', sum(tp), sum(n_sys), sum(n_ref), avg(p), avg(r), avg(f) FROM x WHERE label <> 'micro_average')
SELECT y.label, round(f, 6) AS fscore, round(p, 6) AS precision, round(r, 6) AS recall,
       round(os / greatest(c.tp, 1), 6) AS onset_bias, round(fs / greatest(c.tp, 1), 6) AS offset_bias
FROM y LEFT JOIN c USING (label)""", "v_gt", "v_det")
def collar_fscore(spark, sf_dir):
    table = collar.collar_counts(v.detections(spark, sf_dir), v.ground_truth(spark, sf_dir), 12.0, 12.0, 0.2,
                                 det_id=["clip_id", "label", "det_id"])
    out = collar.prf_table(table).join(collar.with_biases(table).select("label", "onset_bias", "offset_bias"), "label", "left")
    return tidy(out.drop("tp", "n_sys", "n_ref"))


_THRESHOLDS = [0.2, 0.4, 0.6]


def _frame_greedy_sql(det, key, collar_, rate):
    """Matching of ``det`` with the frame ground truth, separately for each ``key``."""
    pairs = f"""p0 AS (SELECT d.{key}, d.clip_id, d.label, d.onset - g.onset AS od, d."offset" - g."offset" AS fd, d.onset AS d_on, d."offset" AS d_off,
               g.onset AS g_on, g."offset" AS g_off FROM {det} d JOIN v_frame_gt g ON d.clip_id = g.clip_id AND d.label = g.label
        WHERE abs(d.onset - g.onset) <= {collar_}e0 AND abs(d."offset" - g."offset") <= greatest({collar_}e0, {rate}e0 * (g."offset" - g.onset)))"""
    return pairs + "," + _timed_sql("p0", (key, "clip_id", "label"), "d_on", "g_on", "DOUBLE")


_BEST_COLLAR = """
cc AS (SELECT g.{key}, g.label, coalesce(t.tp, 0) AS tp, coalesce(s.n, 0) AS n_sys, coalesce(r.n, 0) AS n_ref, coalesce(os, 0e0) AS os, coalesce(fs, 0e0) AS fs
       FROM {grid} g LEFT JOIN (SELECT {key}, label, count(*) AS tp, sum(od) AS os, sum(fd) AS fs FROM m GROUP BY 1, 2) t ON t.{key} = g.{key} AND t.label = g.label
       LEFT JOIN (SELECT {key}, label, count(*) AS n FROM {det} GROUP BY 1, 2) s ON s.{key} = g.{key} AND s.label = g.label
       LEFT JOIN (SELECT label, count(*) AS n FROM v_frame_gt GROUP BY 1) r ON r.label = g.label),
fc AS (SELECT *, 2e0 * p * r / greatest(p + r, 1e-15) AS f FROM (
       SELECT *, CAST(tp AS DOUBLE) / greatest(n_sys, 1) AS p, CAST(tp AS DOUBLE) / greatest(n_ref, 1) AS r FROM cc))"""
_THR3 = """
td AS (SELECT clip_id, label, threshold, min(onset) AS onset, max("offset") AS "offset" FROM (
  SELECT s.*, t.threshold, frame - row_number() OVER (PARTITION BY t.threshold, clip_id, label ORDER BY frame) AS g
  FROM v_scores s JOIN (VALUES (0.2e0), (0.4e0), (0.6e0)) t(threshold) ON s.score > t.threshold) GROUP BY clip_id, label, threshold, g),
tgrid AS (SELECT DISTINCT label, threshold FROM v_scores, (VALUES (0.2e0), (0.4e0), (0.6e0)) t(threshold))"""


@query("a25_collar_best_fscore", f"""WITH RECURSIVE {_THR3}, {_frame_greedy_sql('td', 'threshold', 0.02, 0.2)}, {_BEST_COLLAR.format(key='threshold', grid='tgrid', det='td')}
SELECT label, threshold, round(f, 6) AS fscore, round(p, 6) AS precision, round(r, 6) AS recall,
       round(os / greatest(tp, 1), 6) AS onset_bias, round(fs / greatest(tp, 1), 6) AS offset_bias FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, threshold DESC) AS rn FROM fc) WHERE rn = 1""", "v_scores", "v_frame_gt")
def collar_best_fscore(spark, sf_dir):
    return tidy(collar.collar_best_fscore(v.scores(spark, sf_dir), _frame_gt(spark, sf_dir), _THRESHOLDS,
                                          0.02, 0.02, 0.2))


# ---------------------------------------------------------------- intersection based

_OVER = 'd.onset < g."offset" AND g.onset < d."offset"'
_INTER = 'least(d."offset", g."offset") - greatest(d.onset, g.onset)'


@query("j14_intersection", f"""
SELECT d.clip_id, d.label, det_id, gt_id, round({_INTER}, 6) AS overlap
FROM v_det d JOIN v_gt g ON d.clip_id = g.clip_id AND d.label = g.label AND {_OVER}""", "v_gt", "v_det")
def intersection_pairs(spark, sf_dir):
    p = matching.overlap_pairs(v.detections(spark, sf_dir), v.ground_truth(spark, sf_dir), True)
    return tidy(p.select("clip_id", "label", "det_id", "gt_id", "overlap"))


@query("j15_cross_trigger", f"""
SELECT d.clip_id, d.label, g.label AS gt_label, det_id, gt_id, round({_INTER}, 6) AS overlap
FROM v_det d JOIN v_gt g ON d.clip_id = g.clip_id AND d.label <> g.label AND {_OVER}""", "v_gt", "v_det")
def cross_trigger(spark, sf_dir):
    p = matching.overlap_pairs(v.detections(spark, sf_dir), v.ground_truth(spark, sf_dir), False)
    return tidy(p.select("clip_id", "label", "gt_label", "det_id", "gt_id", "overlap"))


def _stats_sql(det, gt, dtc, gtc, cttc):
    return f"""
pr AS (SELECT d.threshold, d.clip_id, d.label, d.det_id, g.gt_id, {_INTER} AS o FROM {det} d JOIN {gt} g
       ON d.clip_id = g.clip_id AND d.label = g.label AND {_OVER}),
dt AS (SELECT d.*, round(coalesce(o, 0e0) / (d."offset" - d.onset), 9) >= {dtc}e0 AS dtc FROM {det} d LEFT JOIN (
         SELECT threshold, clip_id, label, det_id, sum(o) AS o FROM pr GROUP BY 1, 2, 3, 4) USING (threshold, clip_id, label, det_id)),
tp AS (SELECT threshold, label, count(*) AS tp FROM (
         SELECT p.threshold, p.label, p.clip_id, p.gt_id, round(sum(o) / (max(g."offset") - max(g.onset)), 9) AS s
         FROM pr p JOIN dt USING (threshold, clip_id, label, det_id)
         JOIN {gt} g ON g.clip_id = p.clip_id AND g.label = p.label AND g.gt_id = p.gt_id
         WHERE dtc GROUP BY 1, 2, 3, 4) WHERE s >= {gtc}e0 GROUP BY 1, 2),
cn AS (SELECT threshold, label, coalesce(tp, 0) AS tp, fp, coalesce(n_ref, 0) AS n_ref FROM (
         SELECT threshold, label, count(*) FILTER (NOT dtc) AS fp FROM dt GROUP BY 1, 2) LEFT JOIN tp USING (threshold, label)
       LEFT JOIN (SELECT label, count(*) AS n_ref FROM {gt} GROUP BY 1) USING (label)),
ct AS (SELECT threshold, label, gt_label, count(*) AS ct FROM (
         SELECT d.threshold, d.label, g.label AS gt_label, d.clip_id, d.det_id,
                round(sum({_INTER}) / (max(d."offset") - max(d.onset)), 9) AS s
         FROM dt d JOIN {gt} g ON d.clip_id = g.clip_id AND d.label <> g.label AND {_OVER}
         WHERE NOT dtc GROUP BY 1, 2, 3, 4, 5) WHERE s >= {cttc}e0 GROUP BY 1, 2, 3)"""


_HOURS = "dur AS (SELECT 720e0 * count(DISTINCT user_id) AS h FROM events)"
_RATES = """
gl AS (SELECT label, sum("offset" - onset) AS h FROM {gt} GROUP BY 1),
cr AS (SELECT threshold, ct.label, sum(ct / gl.h) AS s FROM ct JOIN gl ON gl.label = ct.gt_label GROUP BY 1, 2),
rt AS (SELECT cn.threshold, cn.label, tp, fp, n_ref, tp / greatest(n_ref, 1e0) AS tpr,
              fp / (SELECT h FROM dur) + {alpha}e0 * coalesce(s, 0e0) / (SELECT greatest(count(*) - 1, 1) FROM gl) AS efpr
       FROM cn LEFT JOIN cr USING (threshold, label)),
roc AS (SELECT label, efpr, max(tpr) OVER (PARTITION BY label ORDER BY efpr) AS tpr,
               coalesce(lead(efpr) OVER (PARTITION BY label ORDER BY efpr), {m}e0) AS until
        FROM (SELECT label, efpr, max(tpr) AS tpr FROM rt WHERE efpr <= {m}e0 GROUP BY 1, 2))"""
_PSDS = """
bp AS (SELECT efpr AS x, coalesce(lead(efpr) OVER (ORDER BY efpr), {m}e0) AS nx FROM (SELECT DISTINCT efpr FROM roc)),
mt AS (SELECT x, nx, avg(t) AS mu, stddev_pop(t) AS sd FROM (
         SELECT x, nx, l.label, coalesce(max(CASE WHEN r.efpr <= x THEN r.tpr END), 0e0) AS t
         FROM bp CROSS JOIN gl l LEFT JOIN roc r ON r.label = l.label GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _hours(spark, sf_dir):
    """30 days per clip."""
    users = v.table(spark, sf_dir, "events").select("user_id").distinct()
    return intersection.total_duration(users.withColumn("audio_length", F.lit(720.0)))


@query("a26_intersection_counts", f"""WITH {_stats_sql('v_thr_det', 'v_gt', 0.1, 0.1, 0.3)}
SELECT threshold, label, tp, fp, n_ref FROM cn""", "v_thr_det", "v_gt")
def intersection_counts(spark, sf_dir):
    counts, _ = intersection.intersection_counts(v.threshold_detections(spark, sf_dir), v.ground_truth(spark, sf_dir),
                                                 0.1, 0.1, None)
    return tidy(counts)


@query("a26_cross_trigger_counts", f"""WITH {_stats_sql('v_thr_det', 'v_gt', 0.1, 0.1, 0.3)}
SELECT threshold, label, gt_label, ct FROM ct""", "v_thr_det", "v_gt")
def cross_trigger_counts(spark, sf_dir):
    _, crossed = intersection.intersection_counts(v.threshold_detections(spark, sf_dir), v.ground_truth(spark, sf_dir),
                                                  0.1, 0.1, 0.3)
    return tidy(crossed)


def _rates(spark, sf_dir, alpha=0.5):
    gt = v.ground_truth(spark, sf_dir)
    counts, crossed = intersection.intersection_counts(v.threshold_detections(spark, sf_dir), gt, 0.1, 0.1, 0.3)
    return intersection.effective_rates(counts, crossed, gt, _hours(spark, sf_dir), alpha, unit=1.0)


_SC2 = f"{_stats_sql('v_thr_det', 'v_gt', 0.1, 0.1, 0.3)}, {_HOURS}, {_RATES.format(gt='v_gt', alpha=0.5, m=0.05)}"


@query("a27_psd_roc", f"""WITH {_SC2}
SELECT label, round(efpr, 6) AS efpr, round(tpr, 6) AS tpr, round(until, 6) AS until FROM roc""", "v_thr_det", "v_gt")
def psd_roc(spark, sf_dir):
    return tidy(intersection.psd_roc(_rates(spark, sf_dir), 0.05))


@query("a27_staircase_auc", f"""WITH {_SC2}
SELECT label, round(coalesce(a, 0e0), 6) AS auc FROM gl LEFT JOIN (
  SELECT label, sum(tpr * (until - efpr)) / 0.05e0 AS a FROM roc GROUP BY 1) USING (label)""", "v_thr_det", "v_gt")
def staircase_auc(spark, sf_dir):
    roc = intersection.psd_roc(_rates(spark, sf_dir), 0.05)
    return tidy(intersection.staircase_auc(roc, 0.05, labels=v.ground_truth(spark, sf_dir).select("label").distinct()))


@query("a28_psds", f"""WITH {_SC2}, {_PSDS.format(m=0.05)}
SELECT round(sum(greatest(mu - 1e0 * sd, 0e0) * (nx - x)) / 0.05e0, 6) AS psds FROM mt""", "v_thr_det", "v_gt")
def psds(spark, sf_dir):
    roc = intersection.psd_roc(_rates(spark, sf_dir), 0.05)
    return tidy(intersection.psds(roc, 5, 1.0, 0.05))


_THR5 = [0.1, 0.3, 0.5, 0.7, 0.9]
_THR_DET = """
thr AS (SELECT clip_id, label, threshold, min(onset) AS onset, max("offset") AS "offset", min(onset) AS det_id FROM (
  SELECT s.*, t.threshold, frame - row_number() OVER (PARTITION BY t.threshold, clip_id, label ORDER BY frame) AS g
  FROM v_scores s JOIN (SELECT 1e-2 + 2e-2 * unnest(range(50)) AS threshold) t ON s.score > t.threshold)
  GROUP BY clip_id, label, threshold, g)"""


def _frame_gt(spark, sf_dir):
    """Ground truth is a table that metrics read several times, so the derived one is written once."""
    return cut_lineage(v.frame_events(spark, sf_dir))


def _frame_hours(spark, sf_dir):
    s = v.targets(spark, sf_dir)      # as many rows as frames, without their numbers
    return s.agg((F.count(F.lit(1)) * 0.02).alias("seconds"))


@query("a29_approximate_psds", f"""WITH {_THR_DET}, {_stats_sql('thr', 'v_frame_gt', 0.5, 0.5, 0.3)},
dur AS (SELECT count(*) * 2e-2 AS h FROM v_scores), {_RATES.format(gt='v_frame_gt', alpha=0.5, m=100)}, {_PSDS.format(m=100)}
SELECT round(sum(greatest(mu - 1e0 * sd, 0e0) * (nx - x)) / 100e0, 6) AS psds FROM mt""", "v_scores", "v_frame_gt")
def approximate_psds(spark, sf_dir):
    p, _ = intersection.approximate_psds(v.scores(spark, sf_dir), _frame_gt(spark, sf_dir), _frame_hours(spark, sf_dir),
                                         0.5, 0.5, 0.3, 0.5, 1.0, unit=1.0)
    return tidy(p)


@query("a30_total_duration", "SELECT round(sum(audio_length), 6) AS seconds FROM v_orders WHERE audio_length IS NOT NULL", "v_orders")
def total_duration(spark, sf_dir):
    return tidy(intersection.total_duration(v.order_clips(spark, sf_dir)))


# ---------------------------------------------------------------- boundaries from events

_POS = "(SELECT *, row_number() OVER (PARTITION BY clip_id, label ORDER BY gt_id) AS pos FROM v_gt)"


@query("a7_event_boundaries", f"""
SELECT clip_id, label, round(min_by(onset, pos), 6) AS onset, round(max_by("offset", pos), 6) AS "offset" FROM {_POS} GROUP BY 1, 2""", "v_gt")
def event_boundaries(spark, sf_dir):
    return tidy(targets.boundaries_from_events(v.ground_truth(spark, sf_dir).withColumnRenamed("gt_id", "pos")))


@query("a7_event_boundaries_max", f"""
SELECT clip_id, label, round(min_by(onset, pos), 6) AS onset, round(max("offset"), 6) AS "offset" FROM {_POS} GROUP BY 1, 2""", "v_gt")
def event_boundaries_max(spark, sf_dir):
    return tidy(targets.boundaries_from_events(v.ground_truth(spark, sf_dir).withColumnRenamed("gt_id", "pos"), "max"))


# ---------------------------------------------------------------- tuning

_GRID = tuning.candidate_grid([1, 3, 5], tag_masked=(False, True))
_MED = """
c AS (SELECT clip_id, label, frame, 1 AS n, score FROM v_scores
      UNION ALL SELECT clip_id, label, frame, 3, list_sort(list_concat(x3, list_transform(range(3 - len(x3)), lambda i: 0e0)))[2] FROM ws
      UNION ALL SELECT clip_id, label, frame, 5, list_sort(list_concat(x5, list_transform(range(5 - len(x5)), lambda i: 0e0)))[3] FROM ws),
grid AS (SELECT * FROM (VALUES (0, 1, false), (1, 1, true), (2, 3, false), (3, 3, true), (4, 5, false), (5, 5, true)) g(candidate_id, n, masked)),
cand AS (SELECT candidate_id, c.n, masked, c.clip_id, c.label, frame,
                c.score * CASE WHEN masked AND t.score <= 0.7e0 THEN 0e0 ELSE 1e0 END AS score
         FROM c JOIN grid USING (n) JOIN v_clip_scores t ON t.clip_id = c.clip_id AND t.label = c.label)"""
_WS = """ws AS (SELECT clip_id, label, frame, list(score) OVER (PARTITION BY clip_id, label ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x3,
         list(score) OVER (PARTITION BY clip_id, label ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x5 FROM v_scores)"""


def _grid_scores(spark, sf_dir):
    s = v.scores(spark, sf_dir)
    return s, detect.clip_tags(detect.clip_scores(s), 0.7)


@query("j16_candidate_grid", f"""WITH {_WS}, {_MED}
SELECT candidate_id, clip_id, label, frame, n AS medfilt_length, masked AS tag_masked, round(score, 6) AS score FROM cand""",
       "v_scores", "v_clip_scores")
def candidate_grid(spark, sf_dir):
    s, tags = _grid_scores(spark, sf_dir)
    out = tuning.apply_candidates(s, _GRID, tags)
    return tidy(out.select("candidate_id", "clip_id", "label", "frame", "medfilt_length", "tag_masked", "score"))


def _truth(spark, sf_dir):
    return v.weak_truth(spark, sf_dir).where("target > 0.9").select("clip_id", "label")


_TUNE = f"""{_WS}, {_MED},
cs AS (SELECT candidate_id, clip_id, label, max(score) AS score FROM cand GROUP BY 1, 2, 3),
tg AS (SELECT cs.*, CASE WHEN w.target > 0.9e0 THEN 1e0 ELSE 0e0 END AS g FROM cs LEFT JOIN v_weak w USING (clip_id, label)),
cv AS (SELECT candidate_id, label, score, coalesce((score + lag(score) OVER (PARTITION BY candidate_id, label ORDER BY score)) / 2, '-inf'::DOUBLE) AS threshold,
              sum(n) OVER d AS n_pos, sum(g) OVER d AS tps, sum(g) OVER (PARTITION BY candidate_id, label) AS n_ref
       FROM (SELECT candidate_id, label, score, sum(g) AS g, count(*) AS n FROM tg GROUP BY 1, 2, 3)
       WINDOW d AS (PARTITION BY candidate_id, label ORDER BY score DESC)),
fs AS (SELECT *, 2e0 * p * r / (1e0 * p + r + 1e-18) AS f FROM (
       SELECT candidate_id, label, threshold, tps / greatest(n_pos, 1) AS p, tps / greatest(n_ref, 1) AS r FROM cv)),
bf AS (SELECT candidate_id, label, f, threshold FROM (
       SELECT *, row_number() OVER (PARTITION BY candidate_id, label ORDER BY f DESC, threshold DESC) AS rn FROM fs) WHERE rn = 1),
lb AS (SELECT label, candidate_id, f, threshold FROM (
       SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, candidate_id DESC) AS rn FROM bf) WHERE rn = 1)"""


@query("u3_metric_plugin", f"""WITH {_TUNE}
SELECT candidate_id, label, round(f, 6) AS value, CASE WHEN isfinite(threshold) THEN round(threshold, 6) END AS threshold FROM bf""",
       "v_scores", "v_clip_scores", "v_weak")
def metric_plugin(spark, sf_dir):
    s, tags = _grid_scores(spark, sf_dir)
    return tidy(tuning.f_tag(_truth(spark, sf_dir))(tuning.apply_candidates(s, _GRID, tags)))


def _board(spark, sf_dir):
    s, tags = _grid_scores(spark, sf_dir)
    return tuning.tune(s, _GRID, {"f": tuning.f_tag(_truth(spark, sf_dir))}, tags)


@query("k3_leaderboard", f"""WITH {_TUNE}
SELECT 'f' AS metric, label, round(f, 6) AS value, candidate_id, n AS medfilt_length, masked AS tag_masked,
       CASE WHEN isfinite(threshold) THEN round(threshold, 6) END AS threshold FROM lb JOIN grid USING (candidate_id)""",
       "v_scores", "v_clip_scores", "v_weak")
def leaderboard(spark, sf_dir):
    b = _board(spark, sf_dir)
    return tidy(b.select("metric", "label", "value", "candidate_id", "medfilt_length", "tag_masked", "threshold"))


@query("k3_leaderboard_minimize", """
WITH r AS (SELECT event_type AS label, user_id AS candidate_id, round(avg(value), 3) AS value FROM events GROUP BY 1, 2)
SELECT 'loss' AS metric, label, value, candidate_id FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY value, candidate_id DESC) AS rn FROM r) WHERE rn = 1""")
def leaderboard_minimize(spark, sf_dir):
    r = (v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label"), F.col("user_id").alias("candidate_id"))
         .agg(F.round(F.avg("value"), 3).alias("value")).withColumn("metric", F.lit("loss")))
    return tidy(tuning.leaderboard(r, minimize=["loss"]))


@query("a32_macro_average", f"""WITH {_TUNE}
SELECT label, round(f, 6) AS value FROM lb UNION ALL SELECT 'macro_average', round(avg(f), 6) FROM lb""",
       "v_scores", "v_clip_scores", "v_weak")
def macro_average(spark, sf_dir):
    return tidy(tuning.macro_average(_board(spark, sf_dir)).select("label", "value"))


@query("k3_winning_scores", f"""WITH {_TUNE}
SELECT cand.clip_id, cand.label, frame, round(score, 6) AS score FROM cand JOIN lb ON lb.candidate_id = cand.candidate_id AND lb.label = cand.label""",
       "v_scores", "v_clip_scores", "v_weak")
def winning_scores(spark, sf_dir):
    s, tags = _grid_scores(spark, sf_dir)
    out = tuning.winning_scores(tuning.apply_candidates(s, _GRID, tags), _board(spark, sf_dir))
    return tidy(out.select("clip_id", "label", "frame", "score"))


# key = 10 * candidate + threshold
_TUNE_DET = """
td AS (SELECT clip_id, label, threshold, min(onset) AS onset, max("offset") AS "offset", min(onset) AS det_id FROM (
  SELECT s.*, candidate_id * 10 + t.x AS threshold, frame * 2e-2 AS onset, frame * 2e-2 + 2e-2 AS "offset",
         frame - row_number() OVER (PARTITION BY candidate_id, t.x, clip_id, label ORDER BY frame) AS g
  FROM cand s JOIN (VALUES (0.2e0), (0.5e0)) t(x) ON s.score > t.x WHERE candidate_id < 4) GROUP BY clip_id, label, threshold, g),
tgrid AS (SELECT DISTINCT label, candidate_id * 10 + t.x AS threshold FROM cand, (VALUES (0.2e0), (0.5e0)) t(x) WHERE candidate_id IN (1, 3))"""
_TUNE_AUC = """
dur AS (SELECT count(*) * 2e-2 AS h FROM v_scores),
rt AS (SELECT CAST(floor(threshold / 10) AS INTEGER) AS candidate_id, label, tp / greatest(n_ref, 1e0) AS tpr, fp / (SELECT h FROM dur) AS efpr FROM cn),
roc AS (SELECT candidate_id, label, efpr, max(tpr) OVER (PARTITION BY candidate_id, label ORDER BY efpr) AS tpr,
               coalesce(lead(efpr) OVER (PARTITION BY candidate_id, label ORDER BY efpr), 100e0) AS until
        FROM (SELECT candidate_id, label, efpr, max(tpr) AS tpr FROM rt WHERE efpr <= 100 GROUP BY 1, 2, 3)),
au AS (SELECT candidate_id, label, sum(tpr * (until - efpr)) / 100e0 AS value FROM roc GROUP BY 1, 2)"""


@query("j16_tune_events", f"""WITH RECURSIVE {_WS}, {_MED}, {_TUNE_DET}, {_frame_greedy_sql('td', 'threshold', 0.02, 0.2)},
{_BEST_COLLAR.format(key='threshold', grid='tgrid', det='td')}, {_stats_sql('td', 'v_frame_gt', 0.5, 0.5, 2)}, {_TUNE_AUC},
bf AS (SELECT *, CAST(floor(threshold / 10) AS INTEGER) AS candidate_id, threshold % 10 AS x, row_number() OVER (
       PARTITION BY CAST(floor(threshold / 10) AS INTEGER), label ORDER BY f DESC, threshold DESC) AS rn FROM fc),
rs AS (SELECT 'f' AS metric, label, f AS value, candidate_id, x AS threshold, os / greatest(tp, 1) AS ob, fs / greatest(tp, 1) AS fb FROM bf WHERE rn = 1
       UNION ALL SELECT 'auc', label, value, candidate_id, NULL, NULL, NULL FROM au)
SELECT metric, label, round(value, 6) AS value, candidate_id, n AS medfilt_length, masked AS tag_masked, round(threshold, 6) AS threshold,
       round(ob, 6) AS onset_bias, round(fb, 6) AS offset_bias FROM (
  SELECT *, row_number() OVER (PARTITION BY metric, label ORDER BY value DESC, candidate_id DESC) AS rn FROM rs) JOIN grid USING (candidate_id)
WHERE rn = 1""", "v_scores", "v_clip_scores", "v_frame_gt")
def tune_events(spark, sf_dir):
    """Collar-based F and PSD area over medians and tag masking."""
    s, tags = _grid_scores(spark, sf_dir)
    gt = _frame_gt(spark, sf_dir)
    grid = tuning.candidate_grid([1, 3], tag_masked=(False, True))
    metrics = {"f": tuning.f_collar(gt, [0.2, 0.5], True, onset_collar=0.02, offset_collar=0.02),
               "auc": tuning.psd_auc(gt, _frame_hours(spark, sf_dir), [0.2, 0.5], dtc_threshold=0.5, gtc_threshold=0.5, unit=1.0)}
    out = tuning.tune(s, grid, metrics, tags, {"f": True, "auc": "?"})
    return tidy(out.drop("stepfilt_length", "window_length", "window_shift"))


@query("j16_tune_boundaries", f"""
WITH steps AS (SELECT clip_id, label, frame, score,
  (coalesce(sum(score) OVER (w ROWS BETWEEN 0 FOLLOWING AND 1 FOLLOWING), 0e0) - coalesce(sum(score) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0e0)) / 2e0 AS f,
  (coalesce(sum(score) OVER (w ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING), 0e0) - coalesce(sum(score) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0e0)) / 2e0 AS b
  FROM v_scores WINDOW w AS (PARTITION BY clip_id, label ORDER BY frame))
SELECT clip_id, label, frame, 0 AS stepfilt_length, round(least(max(score) OVER u, max(score) OVER d), 6) AS score FROM steps
WINDOW u AS (PARTITION BY clip_id, label ORDER BY frame), d AS (PARTITION BY clip_id, label ORDER BY frame DESC)
UNION ALL SELECT clip_id, label, frame, 4, round(least(max(f) OVER u, max(b) OVER d), 6) FROM steps
WINDOW u AS (PARTITION BY clip_id, label ORDER BY frame), d AS (PARTITION BY clip_id, label ORDER BY frame DESC)""", "v_scores")
def tune_boundaries(spark, sf_dir):
    grid = tuning.candidate_grid([1], [0, 4])
    out = tuning.apply_candidates(v.scores(spark, sf_dir), grid, boundary=True)
    return tidy(out.select("clip_id", "label", "frame", "stepfilt_length", "score"))


# ---------------------------------------------------------------- pseudo-labels

_TAGGED = "tg AS (SELECT clip_id, label FROM v_clip_scores WHERE score > 0.8e0)"
_DETS = """
dd AS (SELECT clip_id, label, min(onset) AS onset, max("offset") AS "offset" FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY clip_id, label ORDER BY frame) AS g FROM v_scores WHERE score > 0.85e0)
  GROUP BY clip_id, label, g)"""
_PSEUDO = f"""{_TAGGED}, {_DETS},
ps AS (SELECT clip_id, onset, "offset", label, 'strong' AS label_type FROM dd WHERE (clip_id, label) IN (SELECT (clip_id, label) FROM tg)
       UNION ALL SELECT clip_id, 0e0, CAST(n AS DOUBLE), label, 'weak' FROM tg JOIN (SELECT clip_id, max(frame) AS n FROM v_scores GROUP BY 1) USING (clip_id)
       WHERE (clip_id, label) NOT IN (SELECT (clip_id, label) FROM dd))"""


def _pseudo_inputs(spark, sf_dir):
    s = v.scores(spark, sf_dir)
    clips = s.groupBy("clip_id").agg(F.max("frame").cast("double").alias("audio_length"))
    tags = detect.clip_tags(detect.clip_scores(s), 0.8)
    return clips, tags, detect.score_intervals(s, 0.85).drop("threshold")


@query("u7s_pseudo_label", f"""WITH {_PSEUDO}
SELECT clip_id, round(onset, 6) AS onset, round("offset", 6) AS "offset", label, label_type FROM ps""", "v_scores", "v_clip_scores")
def pseudo_label(spark, sf_dir):
    clips, tags, det = _pseudo_inputs(spark, sf_dir)
    return tidy(pseudo.pseudo_label(clips, tags.where("tag"), tags, det))


@query("u7s_pseudo_tags", f"""WITH {_TAGGED}
SELECT clip_id, CAST(NULL AS DOUBLE) AS onset, CAST(NULL AS DOUBLE) AS "offset", label, 'weak' AS label_type FROM tg""", "v_clip_scores")
def pseudo_tags(spark, sf_dir):
    clips, tags, _ = _pseudo_inputs(spark, sf_dir)
    return tidy(pseudo.pseudo_label(clips, tags.where("tag"), tags))


@query("a31_pseudo_label_statistics", f"""WITH {_PSEUDO}
SELECT 'label_rate' AS name, round((SELECT count(DISTINCT clip_id) FROM ps) / (SELECT CAST(count(DISTINCT clip_id) AS DOUBLE) FROM v_scores), 6) AS value
UNION ALL SELECT k || '_rate', round(avg(CASE WHEN label_type = k THEN 1e0 ELSE 0e0 END), 6)
FROM ps, (VALUES ('weak'), ('boundaries'), ('strong')) t(k) GROUP BY k""", "v_scores", "v_clip_scores")
def pseudo_label_statistics(spark, sf_dir):
    clips, tags, det = _pseudo_inputs(spark, sf_dir)
    labels = cut_lineage(pseudo.pseudo_label(clips, tags.where("tag"), tags, det))
    return tidy(pseudo.pseudo_label_statistics(clips, labels))


@query("j12_replace_labels", f"""WITH {_DETS}
SELECT 'd' AS dataset, clip_id, round(onset, 6) AS onset, round("offset", 6) AS "offset", label, 'strong' AS label_type
FROM dd WHERE label IN ('click', 'error', 'view')""", "v_scores")
def replace_labels(spark, sf_dir):
    clips, _, det = _pseudo_inputs(spark, sf_dir)
    table = clips.select("clip_id").join(det, "clip_id", "left")  # one empty row for silent clips
    out = pseudo.replace_labels(clips.withColumn("dataset", F.lit("d")), table, ["click", "error", "view"])
    return tidy(out)

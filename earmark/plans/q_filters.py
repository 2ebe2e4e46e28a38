"""Filters, running maxima, score combination, intervals."""

from functools import partial

from pyspark.sql import functions as F

from earmark.functions.labels import floored_sigmoid
from earmark.operators import detect, ensemble, filters
from earmark.plans import views as v
from earmark.plans.registry import query, tidy

_W = "(PARTITION BY clip_id, label ORDER BY frame"
_KEEP = ("clip_id", "label", "frame", "score")


def _out(df):
    return tidy(df.select(*_KEEP))


def _corr(kernel, base):
    terms = []
    for k, c in enumerate(kernel):
        s = base + k
        x = "score" if s == 0 else f"{'lead' if s > 0 else 'lag'}(score, {abs(s)}) OVER {_W})"
        terms.append(f"coalesce({x}, 0e0) * {c}e0")
    return " + ".join(terms)


_KERNEL = [0.5, -1.0, 2.0, 0.25]


@query("w1_correlate_same", f"""
SELECT clip_id, label, frame, round({_corr(_KERNEL, -2)}, 6) AS score FROM v_scores""", "v_scores")
def correlate_same(spark, sf_dir):
    return _out(filters.correlate(v.scores(spark, sf_dir), _KERNEL, "same"))


@query("w1_correlate_valid", f"""
SELECT clip_id, label, frame, round(s, 6) AS score FROM (
  SELECT clip_id, label, frame, {_corr(_KERNEL, 0)} AS s, lead(score, 3) OVER {_W}) IS NOT NULL AS ok FROM v_scores) WHERE ok""", "v_scores")
def correlate_valid(spark, sf_dir):
    return _out(filters.correlate(v.scores(spark, sf_dir), _KERNEL, "valid"))


@query("w1_correlate_full", f"""WITH terms AS (SELECT clip_id, label, frame + 3 - k AS frame, score * c AS t
          FROM v_scores, (VALUES {", ".join(f"({k}, {c}e0)" for k, c in enumerate(_KERNEL))}) z(k, c))
SELECT clip_id, label, frame, round(sum(t), 6) AS score FROM terms GROUP BY 1, 2, 3""", "v_scores")
def correlate_full(spark, sf_dir):
    return _out(filters.correlate(v.scores(spark, sf_dir), _KERNEL, "full"))


@query("w2_meanfilt", f"""
SELECT clip_id, label, frame, round(sum(score) OVER {_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5e0, 6) AS score FROM v_scores""", "v_scores")
def meanfilt(spark, sf_dir):
    return _out(filters.meanfilt(v.scores(spark, sf_dir), 5))


@query("w2_meanfilt_even", f"""
SELECT clip_id, label, frame, round(sum(score) OVER {_W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6e0, 6) AS score FROM v_scores""", "v_scores")
def meanfilt_even(spark, sf_dir):
    return _out(filters.meanfilt(v.scores(spark, sf_dir), 6))


def _med(n, src="v_scores"):
    h = (n - 1) // 2
    return f"""
SELECT clip_id, label, frame, list_sort(list_concat(x, list_transform(range({n} - len(x)), lambda i: 0e0)))[{h + 1}] AS score
FROM (SELECT *, list(score) OVER {_W} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS x FROM {src})"""


@query("w3_medfilt", f"SELECT clip_id, label, frame, round(score, 6) AS score FROM ({_med(5)})", "v_scores")
def medfilt(spark, sf_dir):
    return _out(filters.medfilt(v.scores(spark, sf_dir), 5))


@query("w3_medfilt_long", f"SELECT clip_id, label, frame, round(score, 6) AS score FROM ({_med(61)})", "v_scores")
def medfilt_long(spark, sf_dir):
    return _out(filters.medfilt(v.scores(spark, sf_dir), 61))


@query("w4_maxfilt", f"""
SELECT clip_id, label, frame, round(CASE WHEN n < 5 THEN greatest(m, 0e0) ELSE m END, 6) AS score FROM (
  SELECT *, max(x) OVER w AS m, count(*) OVER w AS n FROM (SELECT *, score - 0.5e0 AS x FROM v_scores)
  WINDOW w AS {_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""", "v_scores")
def maxfilt(spark, sf_dir):
    shifted = v.scores(spark, sf_dir).withColumn("score", F.col("score") - 0.5)  # negative values meet the zero padding
    return _out(filters.maxfilt(shifted, 5))


_STEP = f"""(coalesce(sum(score) OVER {_W} ROWS BETWEEN 0 FOLLOWING AND 1 FOLLOWING), 0e0)
  - coalesce(sum(score) OVER {_W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0e0)) / 2e0"""
_BACK = f"""(coalesce(sum(score) OVER {_W} ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING), 0e0)
  - coalesce(sum(score) OVER {_W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0e0)) / 2e0"""


@query("w5_stepfilt", f"SELECT clip_id, label, frame, round({_STEP}, 6) AS score FROM v_scores", "v_scores")
def stepfilt(spark, sf_dir):
    return _out(filters.stepfilt(v.scores(spark, sf_dir), 4))


@query("w6_boundariesfilt", f"""
SELECT clip_id, label, frame, round(least(max(f) OVER {_W}), max(b) OVER (PARTITION BY clip_id, label ORDER BY frame DESC)), 6) AS score
FROM (SELECT clip_id, label, frame, {_STEP} AS f, {_BACK} AS b FROM v_scores)""", "v_scores")
def boundariesfilt(spark, sf_dir):
    return _out(filters.boundariesfilt(v.scores(spark, sf_dir), 4))


@query("w6_boundariesfilt_raw", f"""
SELECT clip_id, label, frame, round(least(max(score) OVER {_W}), max(score) OVER (PARTITION BY clip_id, label ORDER BY frame DESC)), 6) AS score
FROM v_scores""", "v_scores")
def boundariesfilt_raw(spark, sf_dir):
    return _out(filters.boundariesfilt(v.scores(spark, sf_dir), 0))


_PER_CLASS = {"a": {"click": 1, "error": 3, "purchase": 5, "signup": 3, "view": 1},
              "b": {"click": 5, "error": 5, "purchase": 1, "signup": 3, "view": 3}}
_LEN_SQL = "(VALUES " + ", ".join(f"('{s}', '{k}', {n})" for s, m in _PER_CLASS.items() for k, n in m.items()) + ") t(set_name, label, n)"


@query("w7_filter_sets", f"""
WITH m1 AS (SELECT clip_id, label, frame, score FROM v_scores), m3 AS ({_med(3)}), m5 AS ({_med(5)})
SELECT m1.clip_id, m1.label, m1.frame, t.set_name,
       round(CASE t.n WHEN 1 THEN m1.score WHEN 3 THEN m3.score ELSE m5.score END, 6) AS score
FROM m1 JOIN m3 USING (clip_id, label, frame) JOIN m5 USING (clip_id, label, frame) JOIN {_LEN_SQL} ON t.label = m1.label""", "v_scores")
def filter_sets(spark, sf_dir):
    out = filters.filter_by_length(v.scores(spark, sf_dir), "median", _PER_CLASS)
    return tidy(out.select("clip_id", "label", "frame", "set_name", "score"))


@query("w8_length_mask", """
SELECT clip_id, label, frame, round(CASE WHEN frame < CAST(clip_id AS BIGINT) % 9 THEN score ELSE 0e0 END, 6) AS score FROM v_scores""", "v_scores")
def length_mask(spark, sf_dir):
    s = v.scores(spark, sf_dir).withColumn("seq_len", F.col("clip_id").cast("bigint") % 9)
    return _out(filters.mask_beyond_length(s))


@query("r4_cumulative_targets", f"""
SELECT clip_id, label, frame, max(target) OVER {_W}) AS target_fwd,
       max(target) OVER (PARTITION BY clip_id, label ORDER BY frame DESC) AS target_bwd FROM v_frame_targets""", "v_frame_targets")
def cumulative_targets(spark, sf_dir):
    out = filters.cumulative_targets(v.frame_targets(spark, sf_dir))
    return tidy(out.select("clip_id", "label", "frame", "target_fwd", "target_bwd"))


# ---------------------------------------------------------------- scoring

def _mean_window(window, pad_left, n):
    return F.aggregate(window, F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))


@query("w9_sliding_scores", f"""
WITH a AS (SELECT clip_id, label, frame, sum(score) OVER {_W} ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) / 5e0 AS s
           FROM v_scores WHERE label IN ('click', 'view')),
b AS (SELECT clip_id, label, frame, sum(score) OVER {_W} ROWS BETWEEN 0 PRECEDING AND 2 FOLLOWING) / 3e0 AS s
      FROM v_scores WHERE label NOT IN ('click', 'view'))
SELECT clip_id, label, frame // 2 AS frame, round(s, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE frame % 2 = 0""", "v_scores")
def sliding_scores(spark, sf_dir):
    frames = v.scores(spark, sf_dir).withColumnRenamed("score", "features")
    lengths = {"click": 5, "view": 5, "error": 3, "purchase": 3, "signup": 3}
    return _out(ensemble.sliding_scores(frames, _mean_window, lengths, window_shift=2))


def _fwd_bwd(spark, sf_dir):
    return v.scores(spark, sf_dir).withColumnRenamed("score", "fwd").withColumn("bwd", F.lit(1.0) - F.col("fwd"))


@query("w10_tag_combination", """
SELECT clip_id, label, round((max_by(score, frame) + min_by(1 - score, frame)) / 2, 6) AS score FROM v_scores GROUP BY 1, 2""", "v_scores")
def tag_combination(spark, sf_dir):
    return tidy(ensemble.combine_tags(_fwd_bwd(spark, sf_dir)))


@query("w10_frame_combination", """
SELECT clip_id, label, frame, round(least(score, 1 - score), 6) AS score FROM v_scores""", "v_scores")
def frame_combination(spark, sf_dir):
    return _out(ensemble.combine_frames(_fwd_bwd(spark, sf_dir), "min"))


def _scaled_scores(batches, power):
    for pdf in batches:
        yield pdf.assign(score=pdf["score"] ** power)[["clip_id", "label", "frame", "score"]]


def _model_runs(spark, sf_dir):
    models = {"one": partial(_scaled_scores, power=1.0), "two": partial(_scaled_scores, power=2.0)}
    return ensemble.score_with(v.frame_targets(spark, sf_dir).select("clip_id", "label", "frame", "score"), models,
                               "clip_id string, label string, frame bigint, score double")


@query("u1_user_scoring", """
SELECT clip_id, label, frame, 'one' AS run, round(score, 6) AS score FROM v_scores
UNION ALL SELECT clip_id, label, frame, 'two', round(score * score, 6) FROM v_scores""", "v_scores")
def user_scoring(spark, sf_dir):
    return tidy(_model_runs(spark, sf_dir))


@query("a9_ensemble_mean", """
SELECT clip_id, label, frame, round((score + score * score) / 2, 6) AS score FROM v_scores""", "v_scores")
def ensemble_mean(spark, sf_dir):
    return _out(ensemble.ensemble_mean(_model_runs(spark, sf_dir), 2))


@query("j9_ensemble_alignment", """
SELECT clip_id, label, frame, round((score + (1 - score) * 0.5e0 + 0.3e0) / 3, 6) AS score FROM v_scores""", "v_scores")
def ensemble_alignment(spark, sf_dir):
    s = v.scores(spark, sf_dir)
    runs = (s.unionByName(s.withColumn("score", (F.lit(1.0) - F.col("score")) * 0.5))
            .unionByName(s.withColumn("score", F.lit(0.3))))
    return _out(ensemble.ensemble_mean(runs, 3))


@query("u2_post_processing", """
SELECT clip_id, label, max(frame) AS frame, round(max(score), 6) AS score FROM v_scores GROUP BY 1, 2""", "v_scores")
def post_processing(spark, sf_dir):
    def keep_max(df):
        return df.groupBy("clip_id", "label").agg(F.max("frame").alias("frame"), F.max("score").alias("score"))
    return _out(ensemble.post_process(v.scores(spark, sf_dir), keep_max))


@query("u4_filter_plugin", f"""
SELECT clip_id, label, frame, round(max(score) OVER w - min(score) OVER w, 6) AS score FROM v_scores
WINDOW w AS {_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""", "v_scores")
def filter_plugin(spark, sf_dir):
    def spread(value, n, window):
        w = window.rowsBetween(-n, n - 1)
        return F.max(value).over(w) - F.min(value).over(w)
    plug = filters.Filter(lambda n: (n, n - 1), spread)
    out = filters.filter_series(v.scores(spark, sf_dir), {"spread": (plug, 2)})
    return _out(out.drop("score").withColumnRenamed("spread", "score"))


@query("p9_score_floor", "SELECT clip_id, label, frame, round(1e-5 + (1 - 2e-5) / (1 + exp(-20 * (score - 0.5e0))), 6) AS score FROM v_scores", "v_scores")
def score_floor(spark, sf_dir):
    s = v.scores(spark, sf_dir)
    return _out(s.withColumn("score", floored_sigmoid((F.col("score") - 0.5) * 20)))


@query("p16_drop_targets", "SELECT clip_id, label, frame, round(score, 6) AS score FROM v_scores", "v_scores")
def drop_targets(spark, sf_dir):
    t = v.frame_targets(spark, sf_dir).select(*_KEEP, F.col("target").alias("strong_targets"), F.col("soft").alias("weak_targets"))
    return tidy(ensemble.drop_targets(t))


# ---------------------------------------------------------------- masks and intervals

@query("j10_tag_masking", """
SELECT s.clip_id, s.label, s.frame,
       round(s.score * greatest(CASE WHEN c.score > 0.7e0 THEN 1e0 ELSE 0e0 END, CASE WHEN s.label IN ('click', 'error') THEN 0e0 ELSE 1e0 END), 6) AS score
FROM v_scores s JOIN v_clip_scores c ON c.clip_id = s.clip_id AND c.label = s.label""", "v_scores", "v_clip_scores")
def tag_masking(spark, sf_dir):
    s = v.scores(spark, sf_dir)
    tags = detect.clip_tags(detect.clip_scores(s), 0.7)
    mask = {"click": True, "error": True, "purchase": False, "signup": False, "view": False}
    return _out(detect.mask_by_tags(s, tags, mask))


_CLASSES = ["click", "error", "purchase", "signup", "view"]


@query("j11_tag_condition", "SELECT clip_id, " + ", ".join(
    f"bool_or(label = '{c}' AND score > 0.7e0) AS \"{c}\"" for c in _CLASSES) + " FROM v_clip_scores GROUP BY 1", "v_clip_scores")
def tag_condition(spark, sf_dir):
    from earmark.operators.tags import condition_vectors
    tags = detect.clip_tags(detect.clip_scores(v.scores(spark, sf_dir)), 0.7)
    vec = condition_vectors(tags, _CLASSES)
    return vec.select("clip_id", *[F.get("tag_condition", F.lit(i)).alias(c) for i, c in enumerate(_CLASSES)])


def _islands(src, threshold):
    return f"""SELECT clip_id, label, min(onset) AS onset, max("offset") AS "offset" FROM (
  SELECT *, frame - row_number() OVER {_W}) AS g FROM {src} WHERE score > {threshold}) GROUP BY clip_id, label, g"""


@query("d1_score_intervals", f"""
SELECT clip_id, label, round(onset, 6) AS onset, round("offset", 6) AS "offset" FROM ({_islands('v_scores', '0.5e0')})""", "v_scores")
def score_intervals(spark, sf_dir):
    return tidy(detect.score_intervals(v.scores(spark, sf_dir), 0.5).drop("threshold"))


@query("d1_score_intervals_per_class", """
SELECT clip_id, label, round(min(onset), 6) AS onset, round(max("offset"), 6) AS "offset" FROM (
  SELECT s.*, frame - row_number() OVER (PARTITION BY s.clip_id, s.label ORDER BY frame) AS g FROM v_scores s
  JOIN (VALUES ('click', 0.3e0), ('error', 0.4e0), ('purchase', 0.5e0), ('signup', 0.6e0), ('view', 0.7e0)) t(label, thr)
    ON t.label = s.label WHERE s.score > t.thr) GROUP BY clip_id, label, g""", "v_scores")
def score_intervals_per_class(spark, sf_dir):
    thr = {"click": 0.3, "error": 0.4, "purchase": 0.5, "signup": 0.6, "view": 0.7}
    return tidy(detect.score_intervals(v.scores(spark, sf_dir), thr).drop("threshold"))


@query("s12_threshold_intervals", """
SELECT round(thr, 6) AS threshold, clip_id, label, round(min(onset), 6) AS onset, round(max("offset"), 6) AS "offset" FROM (
  SELECT s.*, thr, frame - row_number() OVER (PARTITION BY thr, clip_id, label ORDER BY frame) AS g
  FROM v_scores s JOIN (SELECT 1e-2 + 2e-2 * unnest(range(50)) AS thr) ON s.score > thr) GROUP BY thr, clip_id, label, g""", "v_scores")
def threshold_intervals(spark, sf_dir):
    return tidy(detect.score_intervals(v.scores(spark, sf_dir), detect.linspace(0.01, 0.99, 50)))


@query("p13_boundary_correction", """
SELECT clip_id, label, onset, "offset" FROM (
  SELECT det_id, clip_id, label, greatest(round_even(onset - 0.25e0 - b, 3), 0e0) AS onset, round_even("offset" + 0.25e0 - o, 3) AS "offset"
  FROM (SELECT *, CASE WHEN label = 'click' THEN 1.5e0 ELSE 0e0 END AS b, CASE WHEN label = 'view' THEN 7e0 ELSE 0e0 END AS o FROM v_det))
WHERE "offset" > onset""", "v_det")
def boundary_correction(spark, sf_dir):
    out = detect.correct_intervals(v.detections(spark, sf_dir), {"click": 1.5}, {"view": 7.0}, 0.25, decimals=3)
    return tidy(out.drop("det_id"))


@query("p14_event_correction", """
SELECT clip_id, label, round(onset, 6) AS onset, round("offset", 6) AS "offset" FROM (
  SELECT clip_id, label, greatest(onset - 0.25e0 - b, 0e0) AS onset, "offset" + 0.25e0 - o AS "offset"
  FROM (SELECT *, CASE WHEN label = 'click' THEN 1.5e0 ELSE 0e0 END AS b, CASE WHEN label = 'view' THEN 7e0 ELSE 0e0 END AS o FROM v_det))
WHERE "offset" > onset""", "v_det")
def event_correction(spark, sf_dir):
    out = detect.correct_intervals(v.detections(spark, sf_dir), {"click": 1.5}, {"view": 7.0}, 0.25)
    return tidy(out.drop("det_id"))

"""Operating curves over every score value."""

from earmark.operators import exact, intersection, runs
from earmark.plans import views as v
from earmark.plans.q_events import _frame_greedy_sql, _frame_gt, _frame_hours, _PSDS
from earmark.plans.registry import query, tidy

_TICK = "CAST(round(({}) * 1e6) AS BIGINT)"
_LENGTH = f"""({_TICK.format('d."offset"')} - {_TICK.format('d.onset')})"""
_SHARED = (f"""({_TICK.format('least(d."offset", g."offset")')} - {_TICK.format('greatest(d.onset, g.onset)')})""")
_MEET = 'd.clip_id = g.clip_id AND d.onset < g."offset" AND g.onset < d."offset"'


@query("d1_score_runs", """
SELECT clip_id, label, round(onset, 6) AS onset, round("offset", 6) AS "offset", CASE WHEN low > '-inf'::DOUBLE THEN round(low, 6) END AS low, round(high, 6) AS high
FROM v_runs""", "v_runs")
def score_runs(spark, sf_dir):
    """Every run of every series with the thresholds at which it stands."""
    return tidy(runs.score_runs(v.scores(spark, sf_dir)))


def _points_sql(dtc, gtc, cttc, alpha):
    """Counts and rates just below every score of a class."""
    return f"""
covered AS (
    SELECT d.clip_id, d.label, d.onset, d."offset", d.low, d.high, {_LENGTH} AS len, coalesce(sum({_SHARED}) FILTER (g.clip_id IS NOT NULL), 0) AS cover
    FROM v_runs d LEFT JOIN v_frame_gt g ON {_MEET} AND d.label = g.label GROUP BY 1, 2, 3, 4, 5, 6),
judged AS (SELECT *, cover >= {dtc}e0 * len AS passed FROM covered),
lives AS (
    SELECT d.label, g.clip_id, g.gt_id, {_TICK.format('g."offset"')} - {_TICK.format('g.onset')} AS len, {_SHARED} AS o, d.low, d.high
    FROM judged d JOIN v_frame_gt g ON {_MEET} AND d.label = g.label WHERE passed),
gsteps AS (
    SELECT label, clip_id, gt_id, len, x, sum(o) AS o FROM (
        SELECT label, clip_id, gt_id, len, high AS x, o FROM lives UNION ALL SELECT label, clip_id, gt_id, len, low, -o FROM lives)
    WHERE x > '-inf'::DOUBLE GROUP BY 1, 2, 3, 4, 5),
found AS (
    SELECT label, x, CAST(sum(o) OVER w >= {gtc}e0 * len AS INT) - CAST(sum(o) OVER w - o >= {gtc}e0 * len AS INT) AS tp
    FROM gsteps WINDOW w AS (PARTITION BY label, clip_id, gt_id ORDER BY x DESC)),
per AS (SELECT label, sum("offset" - onset) AS units, count(*) AS n_ref FROM v_frame_gt GROUP BY 1),
crossed AS (
    SELECT d.label, g.label AS other, d.low, d.high
    FROM judged d JOIN v_frame_gt g ON {_MEET} AND d.label <> g.label WHERE NOT passed
    GROUP BY d.clip_id, d.label, g.label, d.onset, d."offset", d.low, d.high, d.len HAVING sum({_SHARED}) >= {cttc}e0 * d.len),
changes AS (
    SELECT label, high AS x, 1 AS n, CAST(NOT passed AS INT) AS fp, 0 AS tp, 0::BIGINT AS ct FROM judged
    UNION ALL SELECT label, low, -1, -CAST(NOT passed AS INT), 0, 0 FROM judged
    UNION ALL SELECT label, x, 0, 0, tp, 0 FROM found
    UNION ALL SELECT c.label, high, 0, 0, 0, CAST(floor(1e12 / units + 5e-1) AS BIGINT) FROM crossed c JOIN per ON per.label = c.other
    UNION ALL SELECT c.label, low, 0, 0, 0, -CAST(floor(1e12 / units + 5e-1) AS BIGINT) FROM crossed c JOIN per ON per.label = c.other),
sums AS (
    SELECT label, x, sum(n) OVER w AS n_sys, sum(fp) OVER w AS fp, sum(tp) OVER w AS tp, sum(ct) OVER w AS ct FROM (
        SELECT label, x, sum(n) AS n, sum(fp) AS fp, sum(tp) AS tp, sum(ct) AS ct FROM changes WHERE x > '-inf'::DOUBLE GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY label ORDER BY x DESC)),
pts AS (
    SELECT label, x, tp, fp, n_sys, coalesce(n_ref, 0) AS n_ref, tp / greatest(coalesce(n_ref, 0), 1e0) AS tpr,
           fp / (SELECT count(*) * 2e-2 FROM v_scores) + {alpha}e0 * ct / 1e12 / (SELECT greatest(count(*) - 1, 1) FROM per) AS efpr
    FROM sums LEFT JOIN per USING (label))"""


def _roc_sql(m):
    return f"""
best AS (SELECT label, efpr, max(tpr) AS tpr FROM pts WHERE efpr <= {m}e0 GROUP BY 1, 2),
rising AS (
    SELECT *, coalesce(max(tpr) OVER (PARTITION BY label ORDER BY efpr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM best),
roc AS (
    SELECT label, efpr, tpr, before, coalesce(lead(efpr) OVER (PARTITION BY label ORDER BY efpr), {m}e0) AS until
    FROM rising WHERE tpr > before)"""


def _exact_points(spark, sf_dir):
    gt = _frame_gt(spark, sf_dir)
    return gt, exact.operating_points(v.scores(spark, sf_dir), gt, _frame_hours(spark, sf_dir), 0.5, 0.5, 0.3, 0.5, unit=1.0)


@query("a26_exact_operating_points", f"""WITH {_points_sql(0.5, 0.5, 0.3, 0.5)}
SELECT label, round(x, 6) AS below, tp::BIGINT AS tp, fp::BIGINT AS fp, n_sys::BIGINT AS n_sys, n_ref::BIGINT AS n_ref, round(tpr, 6) AS tpr,
       round(efpr, 6) AS efpr FROM pts""", "v_runs", "v_frame_gt")
def exact_operating_points(spark, sf_dir):
    """Intersection-based counts and rates at every score of a class."""
    return tidy(_exact_points(spark, sf_dir)[1])


@query("a27_psd_roc_exact", f"""WITH {_points_sql(0.5, 0.5, 0.3, 0.5)}, {_roc_sql(100)}
SELECT label, round(efpr, 6) AS efpr, round(tpr, 6) AS tpr, round(until, 6) AS until, round(before, 6) AS before FROM roc""", "v_runs", "v_frame_gt")
def psd_roc_exact(spark, sf_dir):
    return tidy(exact.exact_psd_roc(_exact_points(spark, sf_dir)[1]))


@query("a27_staircase_auc_exact", f"""WITH {_points_sql(0.5, 0.5, 0.3, 0.5)}, {_roc_sql(100)}
SELECT per.label, round(coalesce(a, 0e0), 6) AS auc FROM per LEFT JOIN (
    SELECT label, sum(tpr * (until - efpr)) / 100e0 AS a FROM roc GROUP BY 1) USING (label)""", "v_runs", "v_frame_gt")
def staircase_auc_exact(spark, sf_dir):
    gt, points = _exact_points(spark, sf_dir)
    return tidy(intersection.staircase_auc(exact.exact_psd_roc(points), labels=gt.select("label").distinct()))


@query("a28_psds_exact", f"""WITH {_points_sql(0.5, 0.5, 0.3, 0.5)}, {_roc_sql(100)}, gl AS (SELECT label FROM per), {_PSDS.format(m=100)}
SELECT round(sum(greatest(mu - 1e0 * sd, 0e0) * (nx - x)) / 100e0, 6) AS psds FROM mt""", "v_runs", "v_frame_gt")
def psds_exact(spark, sf_dir):
    """PSDS over all scores."""
    p, _ = exact.exact_psds(v.scores(spark, sf_dir), _frame_gt(spark, sf_dir), _frame_hours(spark, sf_dir), 0.5, 0.5, 0.3, 0.5, 1.0, unit=1.0)
    return tidy(p)


def _collar_sql(c, rate):
    """Matching of every series at each of its own scores; between them nothing changes."""
    return f"""
own AS (SELECT DISTINCT clip_id, label, x FROM (SELECT clip_id, label, high AS x FROM v_runs UNION ALL SELECT clip_id, label, low FROM v_runs)
        WHERE x > '-inf'::DOUBLE),
td AS (SELECT o.x AS threshold, r.* FROM own o JOIN v_runs r ON r.clip_id = o.clip_id AND r.label = o.label AND low < x AND x <= high),
{_frame_greedy_sql('td', 'threshold', c, rate)},
states AS (SELECT o.clip_id, o.label, x, count(m.k) AS tp, coalesce(sum({_TICK.format('od')}), 0) AS os, coalesce(sum({_TICK.format('fd')}), 0) AS fs
       FROM own o LEFT JOIN m ON m.clip_id = o.clip_id AND m.label = o.label AND m.threshold = o.x GROUP BY 1, 2, 3),
moves AS (
    SELECT label, x, 0 AS n, tp - coalesce(lag(tp) OVER w, 0) AS tp, os - coalesce(lag(os) OVER w, 0) AS os, fs - coalesce(lag(fs) OVER w, 0) AS fs
    FROM states WINDOW w AS (PARTITION BY clip_id, label ORDER BY x DESC)
    UNION ALL SELECT label, high, 1, 0, 0, 0 FROM v_runs UNION ALL SELECT label, low, -1, 0, 0, 0 FROM v_runs),
cv AS (
    SELECT label, x, lag(x) OVER (PARTITION BY label ORDER BY x) AS prev, sum(n) OVER w AS n_sys, sum(tp) OVER w AS tp, sum(os) OVER w AS os, sum(fs) OVER w AS fs
    FROM (SELECT label, x, sum(n) AS n, sum(tp) AS tp, sum(os) AS os, sum(fs) AS fs FROM moves WHERE x > '-inf'::DOUBLE GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY label ORDER BY x DESC)
    UNION ALL SELECT label, 'inf'::DOUBLE, max(high), 0, 0, 0, 0 FROM v_runs GROUP BY 1),
cs AS (
    SELECT *, CASE WHEN x < 'inf'::DOUBLE THEN (prev + x) / 2 END AS threshold, 2e0 * p * r / greatest(p + r, 1e-15) AS f FROM (
        SELECT cv.*, n_ref, tp / greatest(n_sys, 1e0) AS p, tp / greatest(n_ref, 1e0) AS r
        FROM cv JOIN (SELECT label, count(*) AS n_ref FROM v_frame_gt GROUP BY 1) USING (label)))"""


_BEST = """
SELECT label, round(threshold, 6) AS threshold, round(g, 6) AS fscore, round(p, 6) AS precision, round(r, 6) AS recall,
       round(os / greatest(tp, 1e0) / 1e6, 6) AS onset_bias, round(fs / greatest(tp, 1e0) / 1e6, 6) AS offset_bias
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY g DESC, x DESC) AS rn FROM (
        SELECT *, CASE WHEN p < {p}e0 OR r < {r}e0 THEN 0e0 ELSE f END AS g FROM cs)) WHERE rn = 1"""


@query("a25_collar_curve_exact", f"""WITH RECURSIVE {_collar_sql(0.02, 0.2).strip()}
SELECT label, round(prev, 6) AS above, CASE WHEN x < 'inf'::DOUBLE THEN round(x, 6) END AS below, tp::BIGINT AS tp, n_sys::BIGINT AS n_sys, n_ref,
       round(os / greatest(tp, 1e0) / 1e6, 6) AS onset_bias, round(fs / greatest(tp, 1e0) / 1e6, 6) AS offset_bias FROM cs""", "v_runs", "v_frame_gt")
def collar_curve_exact(spark, sf_dir):
    """Collar-based counts at every score of a class."""
    return tidy(exact.exact_collar_curve(v.scores(spark, sf_dir), _frame_gt(spark, sf_dir), 0.02, 0.02, 0.2))


@query("a25_collar_best_fscore_exact", f"""WITH RECURSIVE {_collar_sql(0.02, 0.2).strip()}
{_BEST.format(p=0.3, r=0.2)}""", "v_runs", "v_frame_gt")
def collar_best_fscore_exact(spark, sf_dir):
    """Best collar-based F over all scores with a precision of .3 and a recall of .2 at least."""
    return tidy(exact.exact_collar_best_fscore(v.scores(spark, sf_dir), _frame_gt(spark, sf_dir), 0.02, 0.02, 0.2, 0.3, 0.2))

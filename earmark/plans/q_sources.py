"""Readers and writers (S1-S3, S5, S9-S16): files are written from the driver tables and read back."""

from pyspark.sql import functions as F

from earmark.operators import detect, tuning
from earmark.operators.catalog import ontology_edges
from earmark.operators.prepare import vocabulary
from earmark.plans import views as v
from earmark.plans.registry import query, tidy
from earmark.scale import cut_lineage, scratch_path
from earmark.sources import labels, tables


def _text(df, path, column):
    df.select(column).write.text(path)
    return path


def _names(spark, sf_dir):
    """Code table of the return flags, as a headerless TSV."""
    path = scratch_path(spark, "names")
    flags = v.table(spark, sf_dir, "lineitem").select("l_returnflag").distinct()
    _text(flags, path, F.concat(F.lit("/m/0"), F.lower("l_returnflag"), F.lit("\tFlag "), "l_returnflag"))
    return labels.read_code_names(spark, path)


def _code(label):
    return F.concat(F.lit("/m/0"), F.lower(label))


@query("s1_weak_segments", """
SELECT CAST(l_orderkey AS VARCHAR) AS clip_id, 'Flag ' || l_returnflag AS label FROM lineitem""")
def weak_segments(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(', 0.000, 10.000, "'), _code("l_returnflag"), F.lit('"'))
    rows = li.select(line.alias("value")).unionByName(
        li.select("l_suppkey").distinct().select(F.concat(F.lit("# supplier "), F.col("l_suppkey").cast("string")).alias("value")))
    return labels.read_weak_segments(spark, _text(rows, scratch_path(spark, "weak"), "value"), _names(spark, sf_dir))


@query("s2_strong_labels", """
SELECT clip_id, onset, round("offset", 6) AS "offset", 'Flag ' || label AS label FROM v_strong""", "v_strong")
def strong_labels(spark, sf_dir):
    s = v.order_strong(spark, sf_dir)
    path = scratch_path(spark, "strong")
    s.select(F.concat("clip_id", F.lit("_30000")).alias("segment_id"), "onset", "offset", _code("label").alias("code")).write.csv(
        path, sep="\t", header=True)
    return tidy(labels.read_strong_labels(spark, path, _names(spark, sf_dir)))


@query("s3_code_tables", """
SELECT '/m/' || n_nationkey AS code, n_name || ', "the"' AS name FROM nation""")
def code_tables(spark, sf_dir):
    n = v.table(spark, sf_dir, "nation")
    path = scratch_path(spark, "classes")
    n.select(F.col("n_nationkey").alias("index"), F.concat(F.lit("/m/"), F.col("n_nationkey").cast("string")).alias("mid"),
             F.concat(F.lit('"'), "n_name", F.lit(', "the" "')).alias("display_name")).write.csv(
        path, header=True, escape='"', quoteAll=True)
    return labels.read_class_indices(spark, path).withColumn("name", F.regexp_replace("name", ' $', ""))


@query("s4_ontology_file", """
SELECT p_brand AS parent, p_name AS child FROM (SELECT DISTINCT p_brand, p_name FROM part)""")
def ontology_file(spark, sf_dir):
    """Brands list their part names; each line holds an array of nodes."""
    p = v.table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    leaf = p.select("p_name").distinct()

    def node(i, name, kids):
        return F.to_json(F.struct(i.alias("id"), name.alias("name"), kids.alias("child_ids")))

    # a brand node may be split over several array entries: edges are what is read
    rows = (p.select(F.concat(F.lit("["), node(F.concat(F.lit("b:"), "p_brand"), F.col("p_brand"),
                                               F.array(F.concat(F.lit("p:"), "p_name"))), F.lit("]")).alias("value"))
            .unionByName(leaf.select(F.concat(F.lit("["), node(F.concat(F.lit("p:"), "p_name"), F.col("p_name"),
                                                               F.array().cast("array<string>")), F.lit("]")).alias("value"))))
    path = _text(rows, scratch_path(spark, "ontology"), "value")
    return ontology_edges(labels.read_ontology(spark, path, multi_line=False))


@query("s5_ground_truth_events", """
SELECT clip_id, round(onset, 6) AS onset, round("offset", 6) AS "offset", label FROM v_frame_gt
UNION ALL SELECT clip_id, NULL, NULL, NULL FROM (SELECT DISTINCT clip_id FROM v_scores) WHERE clip_id NOT IN (SELECT clip_id FROM v_frame_gt)""",
       "v_scores", "v_frame_gt")
def ground_truth_events(spark, sf_dir):
    path = scratch_path(spark, "gt")
    tables.write_pseudo_labels(v.scores(spark, sf_dir), v.frame_events(spark, sf_dir).drop("gt_id"), path)
    return tidy(labels.read_ground_truth(spark, path).select("clip_id", "onset", "offset", "label"))


@query("s5_ground_truth_tags", """
SELECT CAST(doc_id AS VARCHAR) AS clip_id, pos, CASE pos WHEN 0 THEN lang ELSE source END AS label FROM documents, (VALUES (0), (1)) t(pos)""")
def ground_truth_tags(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    path = scratch_path(spark, "tags")
    d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("filename"),
             F.concat_ws(",", "lang", "source").alias("event_labels")).write.csv(path, sep="\t", header=True)
    return tidy(labels.read_ground_truth(spark, path).select("clip_id", "pos", "label"))


@query("s9_clip_database", "SELECT clip_id, dataset, round(audio_length, 6) AS audio_length FROM v_orders", "v_orders")
def clip_database(spark, sf_dir):
    path = scratch_path(spark, "clips")
    tables.write_database(v.order_clips(spark, sf_dir), path)
    return tidy(tables.read_database(spark, path).select("clip_id", "dataset", "audio_length"))


@query("s9_clip_database_json", """
SELECT clip_id, dataset, round(audio_length, 6) AS audio_length, labeled, n FROM (
  SELECT *, CASE WHEN labeled THEN quality + toxic END AS n FROM v_clips)""", "v_clips")
def clip_database_json(spark, sf_dir):
    path = scratch_path(spark, "clips")
    tables.write_database(v.clips(spark, sf_dir).select("dataset", "clip_id", "audio_length", "events"), path, "json")
    clips = tables.read_database(spark, path, fmt="json")
    return tidy(clips.select("clip_id", "dataset", "audio_length", F.col("events").isNotNull().alias("labeled"), F.array_size("events").alias("n")))


@query("s10_dataset_read", """
SELECT clip_id, dataset FROM v_orders WHERE dataset IN ('1-URGENT', '2-HIGH')""", "v_orders")
def dataset_read(spark, sf_dir):
    path = scratch_path(spark, "clips")
    tables.write_database(v.order_clips(spark, sf_dir), path)
    return tables.read_database(spark, path, ["1-URGENT", "2-HIGH"]).select("clip_id", "dataset")


@query("s11_score_sink", """
SELECT r.run, clip_id, label, frame, round(score * r.f, 6) AS score FROM v_scores, (VALUES ('a', 1e0), ('b', 0.5e0)) r(run, f)""", "v_scores")
def score_sink(spark, sf_dir):
    path = scratch_path(spark, "scores")
    s = v.scores(spark, sf_dir)
    tables.write_scores(s.withColumn("run", F.lit("a")).unionByName(
        s.withColumns({"run": F.lit("b"), "score": F.col("score") * 0.5})), path)
    return tidy(tables.read_scores(spark, path).select("run", "clip_id", "label", "frame", "score"))


_CLASSES = ["click", "error", "purchase", "signup", "view"]


@query("s11_wide_scores", "SELECT clip_id, frame, " + ", ".join(
    f"round(max(CASE WHEN label = '{c}' THEN score END), 6) AS \"{c}\"" for c in _CLASSES) + " FROM v_scores GROUP BY 1, 2", "v_scores")
def wide_scores(spark, sf_dir):
    return tidy(tables.wide_scores(v.scores(spark, sf_dir), _CLASSES).drop("onset", "offset"))


# clips differ in their classes: every third clip has no column for views
_SOME = "NOT (label = 'view' AND CAST(clip_id AS BIGINT) % 3 = 0)"


@query("s11_wide_round_trip", f"""
SELECT clip_id, label, round(min(onset), 6) AS onset, round(max("offset"), 6) AS "offset" FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY clip_id, label ORDER BY frame) AS g FROM v_scores WHERE score > 0.5e0 AND {_SOME})
GROUP BY clip_id, label, g""", "v_scores")
def wide_round_trip(spark, sf_dir):
    """Wide files of clips with different classes, read back and cut into intervals."""
    s = v.scores(spark, sf_dir)
    bare = F.col("clip_id").cast("bigint") % 3 == 0
    path = scratch_path(spark, "wide")
    tables.write_wide_scores(s.where(~bare), f"{path}/a", _CLASSES)
    tables.write_wide_scores(s.where(bare & (F.col("label") != "view")), f"{path}/b", ["signup", "purchase", "error", "click"])
    rows = tables.read_wide_scores(spark, f"{path}/a", v.FRAME).unionByName(tables.read_wide_scores(spark, f"{path}/b", v.FRAME))
    # intervals read scores twice, and files of a few lines each are slow to open
    return tidy(detect.score_intervals(cut_lineage(rows), 0.5).drop("threshold"))


@query("s12_detection_sink", """
SELECT round(thr, 6) AS threshold, clip_id, label, round(min(onset), 6) AS onset, round(max("offset"), 6) AS "offset" FROM (
  SELECT s.*, thr, frame - row_number() OVER (PARTITION BY thr, clip_id, label ORDER BY frame) AS g
  FROM v_scores s JOIN (SELECT 1e-2 + 2e-2 * unnest(range(50)) AS thr) t ON s.score > thr) GROUP BY thr, clip_id, label, g""", "v_scores")
def detection_sink(spark, sf_dir):
    path = scratch_path(spark, "detections")
    tables.write_threshold_detections(v.scores(spark, sf_dir), path)
    return tidy(tables.read_threshold_detections(spark, path))


@query("s12_detections", """
SELECT clip_id, label, round(min(onset), 6) AS onset, round(max("offset"), 6) AS "offset" FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY clip_id, label ORDER BY frame) AS g FROM v_scores WHERE score > 0.5e0) GROUP BY clip_id, label, g""", "v_scores")
def detections(spark, sf_dir):
    path = scratch_path(spark, "operating-point")
    tables.write_detections(detect.score_intervals(v.scores(spark, sf_dir), 0.5), path)
    return tidy(tables.read_detections(spark, path))


@query("s13_pseudo_label_rows", """
WITH d AS (SELECT clip_id, label, min(onset) AS onset, max("offset") AS "offset" FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY clip_id, label ORDER BY frame) AS g FROM v_scores WHERE score > 0.87e0) GROUP BY clip_id, label, g)
SELECT c.clip_id || '.wav' AS filename, round(onset, 6) AS onset, round("offset", 6) AS "offset", label AS event_label
FROM (SELECT DISTINCT clip_id FROM v_scores) c LEFT JOIN d ON d.clip_id = c.clip_id""", "v_scores")
def pseudo_label_rows(spark, sf_dir):
    s = v.scores(spark, sf_dir)
    return tidy(tables.pseudo_label_rows(s, detect.score_intervals(s, 0.87).drop("threshold")))


_PARAMS = """
SELECT m.metric, event_type AS label, round(avg(value), 3) AS threshold, CAST(count(*) AS BIGINT) AS medfilt_length, 1 AS window_shift
FROM events, (VALUES ('f'), ('auc')) m(metric) GROUP BY 1, 2"""


def _params(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    p = e.groupBy(F.col("event_type").alias("label")).agg(F.round(F.avg("value"), 3).alias("threshold"),
                                                         F.count(F.lit(1)).cast("int").alias("medfilt_length"))
    p = p.withColumns({"window_shift": F.lit(1), "tag_masked": F.lit(True)}).withColumn(
        "metric", F.explode(F.array(F.lit("f"), F.lit("auc"))))
    path = scratch_path(spark, "params")
    tables.write_json(p, path)
    return tables.read_hyper_params(spark, path, ["f", "auc"])


@query("s15_hyper_params", _PARAMS)
def hyper_params(spark, sf_dir):
    return tidy(_params(spark, sf_dir).select("metric", "label", "threshold", "medfilt_length", "window_shift"))


@query("s15_class_ordered_params", f"""
SELECT metric, string_agg(label, ',' ORDER BY label) AS labels, CAST(sum(medfilt_length) AS BIGINT) AS total FROM ({_PARAMS}) GROUP BY 1""")
def class_ordered_params(spark, sf_dir):
    p = _params(spark, sf_dir)
    vocab = vocabulary(v.table(spark, sf_dir, "events").select(F.col("event_type").alias("label")))
    out = tables.class_ordered_params(p, vocab)
    return tidy(out.select("metric", F.array_join("labels", ",").alias("labels"),
                           F.aggregate("medfilt_length", F.lit(0), lambda a, x: a + x).alias("total")))


@query("s14_leaderboard_json", """
SELECT 'm' AS metric, label, value, candidate_id FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY value DESC, candidate_id DESC) AS rn FROM (
    SELECT event_type AS label, user_id AS candidate_id, round(max(value), 3) AS value FROM events GROUP BY 1, 2)) WHERE rn = 1""")
def leaderboard_json(spark, sf_dir):
    r = (v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label"), F.col("user_id").alias("candidate_id"))
         .agg(F.round(F.max("value"), 3).alias("value")).withColumn("metric", F.lit("m")))
    path = scratch_path(spark, "board")
    tables.write_json(tuning.leaderboard(r), path)
    return tidy(spark.read.schema("metric string, label string, value double, candidate_id bigint").json(path))


@query("s16_segment_list", """
SELECT clip_id, 0e0 AS start, round(audio_length, 6) AS "end" FROM v_orders WHERE audio_length IS NOT NULL""", "v_orders")
def segment_list(spark, sf_dir):
    c = v.order_clips(spark, sf_dir)
    line = F.concat_ws(", ", "clip_id", F.lit("0.000"), F.col("audio_length").cast("string"))
    rows = c.select(F.when(F.col("audio_length").isNull(), F.concat(F.lit("# no length: "), "clip_id")).otherwise(line).alias("value"))
    return tidy(labels.read_segment_list(spark, _text(rows, scratch_path(spark, "segments"), "value")))

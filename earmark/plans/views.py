"""The driver tables seen as clips, events, scores, labels and ontology.

Each view exists twice: as a Spark function ``(spark, sf_dir) -> DataFrame`` and as SQL text in
``VIEWS`` (name -> (views it uses, SQL)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from earmark.operators.detect import score_intervals
from earmark.scale import running_index

FRAME = 0.02


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("clip_id"), F.col("event_type").alias("label"),
        "ts", "event_id", "value", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))
    # frame numbers: position inside the week plus the rows of earlier weeks
    e = e.withColumn("_week", F.trunc("ts", "week"))
    return running_index(e, ["clip_id", "label"], "_week", ["ts", "event_id"], "frame").drop("_week")


def scores(spark, sf_dir) -> DataFrame:
    """``clip_id, label, frame, onset, offset, score``."""
    s = _series(spark, sf_dir)
    on = F.col("frame") * F.lit(FRAME)
    return s.select("clip_id", "label", "frame", on.alias("onset"), (on + F.lit(FRAME)).alias("offset"),
                    (F.col("value") / (F.col("value") + 50.0)).alias("score"))


def frame_targets(spark, sf_dir) -> DataFrame:
    """Scores with a 0/1 ``target`` per frame and three-valued ``soft`` and ``sure`` targets."""
    s = _series(spark, sf_dir)
    on = F.col("frame") * F.lit(FRAME)
    return s.select("clip_id", "label", "frame", on.alias("onset"), (on + F.lit(FRAME)).alias("offset"),
                    (F.col("value") / (F.col("value") + 50.0)).alias("score"),
                    (F.col("k") >= 50).cast("double").alias("target"),
                    F.when(F.col("k") >= 70, 1.0).when(F.col("k") < 40, 0.0).otherwise(0.5).alias("soft"),
                    F.when(F.col("k") == 50, 0.5).when(F.col("k") > 50, 1.0).otherwise(0.0).alias("sure"))


def targets(spark, sf_dir) -> DataFrame:
    """Unordered instances ``event_id, clip_id, label, target, score`` without frame numbers."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("clip_id"), F.col("event_type").alias("label"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("int") >= 50).cast("double").alias("target"),
        (F.col("value") / (F.col("value") + 50.0)).alias("score"))


def frame_events(spark, sf_dir) -> DataFrame:
    """Ground truth on the frame axis: runs of positive targets, ``gt_id`` = onset."""
    t = frame_targets(spark, sf_dir).drop("score").withColumnRenamed("target", "score")
    return score_intervals(t, 0.5).select("clip_id", "label", "onset", "offset", F.col("onset").alias("gt_id"))


def weak_truth(spark, sf_dir) -> DataFrame:
    """Clip targets ``clip_id, label, target``: 1, 0 or .5 by the mean of the frame targets."""
    m = targets(spark, sf_dir).groupBy("clip_id", "label").agg(F.avg("target").alias("m"))
    return m.select("clip_id", "label", F.when(F.col("m") > 0.55, 1.0).when(F.col("m") < 0.4, 0.0)
                    .otherwise(0.5).alias("target"))


def _intervals(spark, sf_dir, parity, id_name):
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == parity)
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    t = micros / F.lit(3.6e9)
    return e.select(F.col("user_id").cast("string").alias("clip_id"), F.col("event_type").alias("label"),
                    t.alias("onset"), (t + F.col("value") / 5.0).alias("offset"), F.col("event_id").alias(id_name))


def ground_truth(spark, sf_dir) -> DataFrame:
    """Intervals in hours from even events."""
    return _intervals(spark, sf_dir, 0, "gt_id")


def detections(spark, sf_dir) -> DataFrame:
    """Intervals in hours from odd events."""
    return _intervals(spark, sf_dir, 1, "det_id")


def threshold_detections(spark, sf_dir) -> DataFrame:
    """Detections at three thresholds of their value."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("det_id"), "value")
    levels = F.filter(F.array(F.lit(0.0), F.lit(20.0), F.lit(50.0)), lambda t: F.col("value") > t)
    return detections(spark, sf_dir).join(e, "det_id").withColumn("threshold", F.explode(levels)).drop("value")


def ranked(spark, sf_dir) -> DataFrame:
    """A class score per vector component with two positive classes."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").cast("string").alias("clip_id"), F.col("label").alias("y"),
                    F.posexplode("embedding").alias("c", "s"))
    hit = (F.col("c") % 10 == F.col("y")) | (F.col("c") % 10 == (F.col("y") + 3) % 10)
    return rows.select("clip_id", F.concat(F.lit("c"), F.lpad(F.col("c").cast("string"), 2, "0")).alias("label"),
                       F.col("s").cast("double").alias("score"), hit.cast("double").alias("target"))


def waves(spark, sf_dir) -> DataFrame:
    """Short waveforms with events in samples."""
    e = table(spark, sf_dir, "embeddings")
    a = F.struct(F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), F.lit("strong").alias("label_type"),
                 (F.col("label") * 2).cast("int").alias("start"), (F.col("label") * 2 + 20).cast("int").alias("stop"))
    return e.select(F.col("vec_id").cast("string").alias("clip_id"), "vec_id",
                    F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("dataset"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("wave"),
                    F.array(a).alias("events"), (F.col("vec_id") % 5 == 0).alias("unlabeled"))


def clips(spark, sf_dir) -> DataFrame:
    """Documents as clips; ``events`` is NULL where a document has no label row."""
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("clip_id"), "doc_id",
        (F.col("n_chars") / 100.0).alias("audio_length"), F.col("n_chars").alias("seq_len"))
    lab = table(spark, sf_dir, "labels")

    def event(name):
        return F.struct(F.lit(0.0).alias("onset"), F.lit(1.0).alias("offset"), F.lit(name).alias("label"),
                        F.lit("weak").alias("label_type"))

    some = F.filter(F.array(F.when(F.col("quality") == 1, event("quality")), F.when(F.col("toxic") == 1, event("toxic"))),
                    lambda e: e.isNotNull())
    return d.join(lab.withColumn("events", some).select("doc_id", "events"), "doc_id", "left")


def order_tags(spark, sf_dir) -> DataFrame:
    """Weak tags: return flags of the odd lines of an order."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == 1)
    return li.select(F.col("l_orderkey").cast("string").alias("clip_id"), F.col("l_returnflag").alias("label")).distinct()


def order_strong(spark, sf_dir) -> DataFrame:
    """Strong events: even lines."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == 0)
    on = F.col("l_linenumber").cast("double")
    return li.select(F.col("l_orderkey").cast("string").alias("clip_id"), on.alias("onset"),
                     (on + F.col("l_quantity") / 10.0).alias("offset"), F.col("l_returnflag").alias("label"))


def order_clips(spark, sf_dir) -> DataFrame:
    """Orders as clips of five datasets; pending ones have no length."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("clip_id"), F.col("o_orderpriority").alias("dataset"),
                    F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000.0).alias("audio_length"),
                    F.concat(F.lit("audio/"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("audio_path"))


def ontology(spark, sf_dir) -> DataFrame:
    """Edges region -> nation -> customer / supplier."""
    n = table(spark, sf_dir, "nation")
    top = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    low = []
    for t, p in (("customer", "c"), ("supplier", "s")):
        low.append(table(spark, sf_dir, t).join(n, F.col(f"{p}_nationkey") == F.col("n_nationkey")).select(
            F.col("n_name").alias("parent"), F.col(f"{p}_name").alias("child")))
    return top.unionByName(low[0]).unionByName(low[1])


def customer_events(spark, sf_dir) -> DataFrame:
    """Events labelled with customer names: orders of a customer."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    on = F.expr("datediff(o_orderdate, timestamp_ntz'1992-01-01 00:00:00')").cast("double")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("clip_id"), on.alias("onset"), (on + 1.0).alias("offset"),
        F.col("c_name").alias("label"), F.lit("strong").alias("label_type"))


_T = "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 3.6e9"
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER)"

VIEWS: dict = {
    "v_series": ((), f"""
        SELECT CAST(user_id AS VARCHAR) AS clip_id, event_type AS label,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS frame,
               value, {_K} AS k FROM events"""),
    "v_scores": (("v_series",), """
        SELECT clip_id, label, frame, frame * 2e-2 AS onset, frame * 2e-2 + 2e-2 AS "offset",
               value / (value + 50e0) AS score FROM v_series"""),
    "v_frame_targets": (("v_series",), """
        SELECT clip_id, label, frame, frame * 2e-2 AS onset, frame * 2e-2 + 2e-2 AS "offset",
               value / (value + 50e0) AS score, CASE WHEN k >= 50 THEN 1e0 ELSE 0e0 END AS target,
               CASE WHEN k >= 70 THEN 1e0 WHEN k < 40 THEN 0e0 ELSE 5e-1 END AS soft,
               CASE WHEN k = 50 THEN 5e-1 WHEN k > 50 THEN 1e0 ELSE 0e0 END AS sure FROM v_series"""),
    "v_targets": ((), f"""
        SELECT event_id, CAST(user_id AS VARCHAR) AS clip_id, event_type AS label,
               CASE WHEN {_K} >= 50 THEN 1e0 ELSE 0e0 END AS target, value / (value + 50e0) AS score FROM events"""),
    "v_frame_gt": (("v_frame_targets",), """
        SELECT clip_id, label, min(onset) AS onset, max("offset") AS "offset", min(onset) AS gt_id FROM (
          SELECT *, frame - row_number() OVER (PARTITION BY clip_id, label ORDER BY frame) AS g
          FROM v_frame_targets WHERE target > 5e-1) GROUP BY clip_id, label, g"""),
    "v_weak": (("v_targets",), """
        SELECT clip_id, label, CASE WHEN m > 0.55e0 THEN 1e0 WHEN m < 0.4e0 THEN 0e0 ELSE 5e-1 END AS target
        FROM (SELECT clip_id, label, avg(target) AS m FROM v_targets GROUP BY 1, 2)"""),
    "v_gt": ((), f"""
        SELECT CAST(user_id AS VARCHAR) AS clip_id, event_type AS label, {_T} AS onset,
               {_T} + value / 5e0 AS "offset", event_id AS gt_id FROM events WHERE event_id % 2 = 0"""),
    "v_det": ((), f"""
        SELECT CAST(user_id AS VARCHAR) AS clip_id, event_type AS label, {_T} AS onset,
               {_T} + value / 5e0 AS "offset", event_id AS det_id FROM events WHERE event_id % 2 = 1"""),
    "v_thr_det": (("v_det",), """
        SELECT d.*, t.threshold FROM v_det d JOIN events e ON e.event_id = d.det_id
        JOIN (VALUES (0e0), (20e0), (50e0)) t(threshold) ON e.value > t.threshold"""),
    "v_rank": ((), """
        SELECT CAST(vec_id AS VARCHAR) AS clip_id, 'c' || lpad(CAST(c AS VARCHAR), 2, '0') AS label,
               CAST(embedding[c + 1] AS DOUBLE) AS score,
               CASE WHEN c % 10 = label OR c % 10 = (label + 3) % 10 THEN 1e0 ELSE 0e0 END AS target
        FROM (SELECT *, unnest(range(len(embedding))) AS c FROM embeddings)"""),
    "v_clips": ((), """
        SELECT source AS dataset, CAST(d.doc_id AS VARCHAR) AS clip_id, d.doc_id, n_chars / 1e2 AS audio_length,
               n_chars AS seq_len, l.doc_id IS NOT NULL AS labeled,
               coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "v_clip_labels": (("v_clips",), """
        SELECT dataset, clip_id, 'quality' AS label FROM v_clips WHERE quality = 1
        UNION ALL SELECT dataset, clip_id, 'toxic' FROM v_clips WHERE toxic = 1"""),
    "v_tags": ((), """
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS clip_id, l_returnflag AS label
        FROM lineitem WHERE l_linenumber % 2 = 1"""),
    "v_strong": ((), """
        SELECT CAST(l_orderkey AS VARCHAR) AS clip_id, CAST(l_linenumber AS DOUBLE) AS onset,
               l_linenumber + l_quantity / 10e0 AS "offset", l_returnflag AS label
        FROM lineitem WHERE l_linenumber % 2 = 0"""),
    "v_orders": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS clip_id, o_orderpriority AS dataset,
               CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1e3 END AS audio_length,
               'audio/' || CAST(o_orderkey AS VARCHAR) || '.wav' AS audio_path FROM orders"""),
    "v_ontology": ((), """
        SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "v_closure": (("v_ontology",), """
        SELECT parent AS ancestor, child AS node FROM v_ontology
        UNION SELECT a.parent, b.child FROM v_ontology a JOIN v_ontology b ON a.child = b.parent"""),
    "v_cust_events": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS clip_id,
               CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS onset,
               CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 1e0 AS "offset",
               c_name AS label, 'strong' AS label_type FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "v_curve": (("v_targets",), """
        SELECT label, coalesce((score + lag(score) OVER (PARTITION BY label ORDER BY score)) / 2, '-inf'::DOUBLE) AS threshold,
               sum(n_at) OVER (PARTITION BY label ORDER BY score DESC) AS n_pos,
               sum(tp_at) OVER (PARTITION BY label ORDER BY score DESC) AS tps,
               sum(tp_at) OVER (PARTITION BY label) AS n_ref, tp_at, n_at
        FROM (SELECT label, score, sum(target) AS tp_at, count(*) AS n_at FROM v_targets GROUP BY 1, 2)
        UNION ALL
        SELECT label, 'inf'::DOUBLE, 0, 0, sum(target), 0, 0 FROM v_targets GROUP BY label"""),
    "v_fcurve": (("v_curve",), """
        SELECT label, threshold, p AS precision, r AS recall, 2e0 * p * r / (1e0 * p + r + 1e-18) AS fscore FROM (
          SELECT label, threshold, tps / greatest(n_pos, 1e0) AS p, tps / greatest(n_ref, 1e0) AS r FROM v_curve)"""),
    "v_ecurve": (("v_curve",), """
        SELECT label, threshold, ((n_pos - tps) + (n_ref - tps)) / greatest(n_ref, 1e0) AS error_rate,
               (n_pos - tps) / greatest(n_ref, 1e0) AS insertion_rate,
               (n_ref - tps) / greatest(n_ref, 1e0) AS deletion_rate FROM v_curve"""),
    "v_runs": (("v_scores",), """
        SELECT n.clip_id, n.label, coalesce(l + 1, 0) * 2e-2 AS onset, coalesce(r - 1, top) * 2e-2 + 2e-2 AS "offset",
               greatest(coalesce(x.score, '-inf'::DOUBLE), coalesce(y.score, '-inf'::DOUBLE)) AS low, high
        FROM (SELECT a.clip_id, a.label, a.frame, a.score AS high, max(b.frame) AS top,
                     max(b.frame) FILTER (b.frame < a.frame AND b.score < a.score) AS l,
                     min(b.frame) FILTER (b.frame > a.frame AND b.score < a.score) AS r,
                     max(b.frame) FILTER (b.frame < a.frame AND b.score = a.score) AS e
              FROM v_scores a JOIN v_scores b ON a.clip_id = b.clip_id AND a.label = b.label GROUP BY 1, 2, 3, 4) n
        LEFT JOIN v_scores x ON x.clip_id = n.clip_id AND x.label = n.label AND x.frame = n.l
        LEFT JOIN v_scores y ON y.clip_id = n.clip_id AND y.label = n.label AND y.frame = n.r
        WHERE e IS NULL OR e < coalesce(l, -1)"""),
    "v_clip_scores": (("v_scores",), """
        SELECT clip_id, label, max(score) AS score FROM v_scores GROUP BY 1, 2"""),
}

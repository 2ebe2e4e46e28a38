"""Training-set preparation (P1-P4, P7, A3-A6, U1s-U7, J8, K6, K7, F2-F6)."""

from pyspark.sql import functions as F

from earmark.functions import labels as lab
from earmark.operators import prepare, segments, targets
from earmark.plans import views as v
from earmark.plans.registry import query, tidy

_REPS = {f"src{i}": i % 4 for i in range(20)}  # a quarter of the datasets is switched off
_REPS_SQL = "(VALUES " + ", ".join(f"('{k}', {n})" for k, n in _REPS.items() if n > 0) + ") r(dataset, reps)"


@query("p1_dataset_scan", f"""
SELECT clip_id, c.dataset, CAST(reps AS BIGINT) AS dataset_reps FROM v_clips c JOIN {_REPS_SQL} ON r.dataset = c.dataset""", "v_clips")
def dataset_scan(spark, sf_dir):
    return tidy(prepare.scan_datasets(v.clips(spark, sf_dir), _REPS).select("clip_id", "dataset", "dataset_reps"))


@query("p2_drop_labelless", "SELECT DISTINCT clip_id FROM v_clip_labels", "v_clip_labels")
def drop_labelless(spark, sf_dir):
    return prepare.drop_labelless(v.clips(spark, sf_dir)).select("clip_id")


@query("p3_exclude_ids", """
SELECT clip_id FROM v_clips WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""", "v_clips")
def exclude_ids(spark, sf_dir):
    # ids as they appear in a segment file: a leading letter, then two time parts
    good = v.table(spark, sf_dir, "labels").where("quality = 1")
    ids = good.select(lab.source_clip_id(F.concat(F.lit("Y"), F.col("doc_id").cast("string"), F.lit("_0.000_10.000"))).alias("clip_id"))
    return v.clips(spark, sf_dir).join(ids, "clip_id", "left_anti").select("clip_id")


@query("p4_min_length", "SELECT clip_id, round(audio_length, 6) AS audio_length FROM v_orders WHERE audio_length > 100", "v_orders")
def min_length(spark, sf_dir):
    return tidy(prepare.longer_than(v.order_clips(spark, sf_dir), 100.0).select("clip_id", "audio_length"))


@query("p1_raw_clips", f"""
SELECT clip_id, CAST(reps AS BIGINT) AS dataset_reps FROM v_clips c JOIN {_REPS_SQL} ON r.dataset = c.dataset
WHERE quality + toxic > 0 AND audio_length > 1""", "v_clips")
def raw_clips(spark, sf_dir):
    return tidy(prepare.raw_clips(v.clips(spark, sf_dir), _REPS, train=True).select("clip_id", "dataset_reps"))


@query("p7_vocabulary", """
SELECT label, row_number() OVER (ORDER BY label) - 1 AS index FROM (SELECT DISTINCT source || '_' || lang AS label FROM documents)""")
def vocabulary(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select(F.concat_ws("_", "source", "lang").alias("label"))
    return tidy(prepare.vocabulary(d))


_BAL = f"""
cl AS (SELECT l.dataset, l.clip_id, l.label, r.reps FROM v_clip_labels l JOIN {_REPS_SQL} ON r.dataset = l.dataset
       JOIN v_clips c ON c.clip_id = l.clip_id WHERE audio_length > 1),
lc AS (SELECT label, CAST(sum(reps) AS BIGINT) AS n FROM cl GROUP BY 1),
mm AS (SELECT max(n) AS m, ceil(max(n) * 0.7e0) AS least FROM lc),
lr AS (SELECT label, n, CAST(ceil(least * floor(1e0 / (1e0 - (least - 1) / m)) / n) AS BIGINT) AS reps FROM lc, mm),
cr AS (SELECT dataset, clip_id, max(lr.reps) * max(cl.reps) AS reps FROM cl JOIN lr USING (label) GROUP BY 1, 2)"""


def _balanced(spark, sf_dir):
    clips = prepare.raw_clips(v.clips(spark, sf_dir), _REPS, train=True)
    counts = prepare.label_counts(clips)
    reps = prepare.label_repetitions(counts, 0.7)
    return clips, counts, reps


@query("a3_label_counts", f"WITH {_BAL} SELECT label, n FROM lc", "v_clips", "v_clip_labels")
def label_counts(spark, sf_dir):
    return tidy(_balanced(spark, sf_dir)[1])


@query("a4_label_repetitions", f"WITH {_BAL} SELECT label, n, reps FROM lr", "v_clips", "v_clip_labels")
def label_repetitions(spark, sf_dir):
    return tidy(_balanced(spark, sf_dir)[2])


@query("a5_clip_repetitions", f"WITH {_BAL} SELECT dataset, clip_id, reps FROM cr", "v_clips", "v_clip_labels")
def clip_repetitions(spark, sf_dir):
    clips, _, reps = _balanced(spark, sf_dir)
    return tidy(prepare.clip_repetitions(clips, reps))


@query("u1s_tile", f"WITH {_BAL} SELECT clip_id, unnest(range(reps)) AS copy FROM cr", "v_clips", "v_clip_labels")
def tile(spark, sf_dir):
    clips, _, reps = _balanced(spark, sf_dir)
    return tidy(prepare.tile(prepare.clip_repetitions(clips, reps)).select("clip_id", "copy"))


@query("u2s_intersperse", """
SELECT dataset, clip_id, round((row_number() OVER (PARTITION BY dataset ORDER BY doc_id)) / CAST(count(*) OVER (PARTITION BY dataset) AS DOUBLE), 6) AS position
FROM v_clips""", "v_clips")
def intersperse(spark, sf_dir):
    clips = v.clips(spark, sf_dir).select("dataset", "clip_id", "doc_id")
    sizes = clips.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return tidy(prepare.intersperse(prepare.ordered_index(clips, "doc_id"), sizes=sizes).select("dataset", "clip_id", "position"))


@query("u3s_oversampling", f"""WITH {_BAL}, t AS (SELECT dataset || '/' || reps AS g, clip_id, unnest(range(reps)) AS copy FROM cr)
SELECT g AS "group", count(*) AS n, round(min(1e0 / m), 6) AS first, 1e0 AS last, count(DISTINCT clip_id) AS clips
FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM t) GROUP BY 1""", "v_clips", "v_clip_labels")
def oversampling(spark, sf_dir):
    out = prepare.oversample(_balanced(spark, sf_dir)[0], 0.7, seed=3)
    return tidy(out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"),
                                         F.max("position").alias("last"), F.count_distinct("clip_id").alias("clips")))


@query("k6_shuffle_positions", """
SELECT dataset, count(*) AS n, 0 AS first, count(*) - 1 AS last, count(*) AS positions, count(DISTINCT clip_id) AS clips FROM v_clips GROUP BY 1""", "v_clips")
def shuffle_positions(spark, sf_dir):
    """A shuffle per dataset is a permutation: every position once."""
    rows = prepare.shuffled_index(v.clips(spark, sf_dir).select("dataset", "clip_id"), ["clip_id"], seed=7, keys=["dataset"])
    return tidy(rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.min("index").alias("first"), F.max("index").alias("last"),
        F.count_distinct("index").alias("positions"), F.count_distinct("clip_id").alias("clips")))


@query("k6_shuffle")
def shuffle(spark, sf_dir):
    rows = v.clips(spark, sf_dir).select("clip_id")
    return tidy(prepare.shuffled_index(rows, ["clip_id"], seed=7, epoch=2))


@query("j8_mixing_pairs", """
WITH i AS (SELECT clip_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM v_clips)
SELECT a.clip_id, b.clip_id AS mix_clip_id FROM i a LEFT JOIN i b
ON b.index = CASE WHEN a.index - floor(a.index / 1.5e0) * 1.5e0 < 1 THEN CAST(floor(a.index / 1.5e0) AS BIGINT) END""", "v_clips")
def mixing_pairs(spark, sf_dir):
    rows = v.clips(spark, sf_dir).select(F.lit("all").alias("dataset"), "clip_id", "doc_id")
    rows = prepare.ordered_index(rows, "doc_id").select("clip_id", "index")
    return prepare.mixing_pairs(rows, rows, 1.5).select("clip_id", "mix_clip_id")


@query("k7_batches", """
WITH b AS (SELECT CAST(floor(ln(seq_len) / -ln(1 - 0.1e0)) AS BIGINT) AS bucket, seq_len FROM v_clips)
SELECT bucket, count(*) AS n, CAST(ceil(count(*) / 8e0) AS BIGINT) AS batches, min(seq_len) AS shortest, max(seq_len) AS longest FROM b GROUP BY 1""", "v_clips")
def batches(spark, sf_dir):
    out = prepare.batches(v.clips(spark, sf_dir).select("clip_id", "seq_len"), 8)
    return tidy(out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batch").alias("batches"),
                                          F.min("seq_len").alias("shortest"), F.max("seq_len").alias("longest")))


@query("k7_batch_quota", """
WITH b AS (SELECT CAST(floor(ln(seq_len) / -ln(1 - 0.3e0)) AS BIGINT) AS bucket, dataset FROM v_clips),
c AS (SELECT bucket, count(*) AS n, count(*) FILTER (dataset = 'src1') AS a, count(*) FILTER (dataset = 'src2') AS b FROM b GROUP BY 1),
x AS (SELECT *, unnest(range(CAST(ceil(n / 8e0) AS BIGINT))) AS batch FROM c)
SELECT bucket, batch, least(8, n - batch * 8) AS n, CASE WHEN n >= batch * 8 + 8 THEN greatest(0, least(2, a - batch * 2)) ELSE 0 END AS least1,
       CASE WHEN n >= batch * 8 + 8 THEN greatest(0, least(1, b - batch)) ELSE 0 END AS least2 FROM x""", "v_clips")
def batch_quota(spark, sf_dir):
    rows = v.clips(spark, sf_dir).select("clip_id", "dataset", "seq_len")
    out = prepare.batches(rows, 8, max_padding_rate=0.3, min_dataset_examples={"src1": 2, "src2": 1})
    # what the quotas ask of a batch, as far as the batch has it
    rows = rows.withColumn("bucket", prepare.length_bucket("seq_len", 0.3))
    have = rows.groupBy("bucket").agg(F.count_if(F.col("dataset") == "src1").alias("a"), F.count_if(F.col("dataset") == "src2").alias("b"))
    out = out.groupBy("bucket", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dataset") == "src1").alias("n1"),
                                             F.count_if(F.col("dataset") == "src2").alias("n2")).join(have, "bucket")
    def asked(n, have, q):
        return F.when(F.col("n") == 8, F.least(n, F.greatest(F.lit(0), F.least(F.lit(q), have - F.col("batch") * q)))).otherwise(0)
    return tidy(out.select("bucket", "batch", "n", asked(F.col("n1"), F.col("a"), 2).alias("least1"),
                           asked(F.col("n2"), F.col("b"), 1).alias("least2")))


@query("k7_batch_diversity_totals", """
WITH b AS (SELECT CAST(floor(ln(seq_len) / -ln(1 - 0.1e0)) AS BIGINT) AS bucket, clip_id FROM v_clips)
SELECT bucket, count(*) AS n_clips, count(DISTINCT CAST(label AS VARCHAR)) > 0 AS any_label FROM b LEFT JOIN (
  SELECT clip_id, min(label) AS label FROM v_clip_labels GROUP BY 1) USING (clip_id) GROUP BY 1""", "v_clips", "v_clip_labels")
def batch_diversity_totals(spark, sf_dir):
    rows = v.clips(spark, sf_dir).select("clip_id", "seq_len", "events")
    per_batch = prepare.batch_diversity(prepare.batches(rows, 8))
    return tidy(per_batch.groupBy("bucket").agg(F.sum("n_clips").alias("n_clips"), (F.max("n_labels") > 0).alias("any_label")))


@query("k7_batch_diversity")
def batch_diversity(spark, sf_dir):
    rows = v.clips(spark, sf_dir).select("clip_id", "seq_len", "events")
    return tidy(prepare.batch_diversity(prepare.batches(rows, 8)))


@query("u6s_batch_round_trip", "SELECT clip_id, seq_len FROM v_clips", "v_clips")
def batch_round_trip(spark, sf_dir):
    batched = prepare.batches(v.clips(spark, sf_dir).select("clip_id", "seq_len"), 16)
    return tidy(prepare.unbatch(prepare.collate(batched, ["clip_id", "seq_len"])).select("clip_id", "seq_len"))


# ---------------------------------------------------------------- segments

@query("u4s_split", """
WITH c AS (SELECT vec_id, embedding, len(embedding) AS n, 11 + vec_id % 50 AS l FROM embeddings),
m AS (SELECT *, CASE WHEN n <= 12 THEN 1 ELSE CAST(ceil((n - 12) / 10e0) AS BIGINT) + 1 END AS m FROM (SELECT vec_id, embedding[1:l] AS embedding, l AS n FROM c)),
s AS (SELECT *, unnest(range(m)) AS i FROM m)
SELECT CASE WHEN m > 1 THEN vec_id || '_!segment!_' || i || '_' || m ELSE CAST(vec_id AS VARCHAR) END AS clip_id, i * 10 AS segment_start,
       least(12, n - i * 10) AS seq_len, round(list_sum(list_transform(embedding[i * 10 + 1 : i * 10 + 12], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM s""")
def split(spark, sf_dir):
    w = v.waves(spark, sf_dir)
    w = w.select("clip_id", F.slice("wave", F.lit(1), (F.col("vec_id") % 50 + 11).cast("int")).alias("data"))
    out = segments.split_sequences(w, 12, 2)
    return tidy(out.select("clip_id", "segment_start", "seq_len", F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("u5s_merge", """
SELECT CAST(vec_id AS VARCHAR) AS clip_id, i AS frame, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS score FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)""")
def merge(spark, sf_dir):
    w = v.waves(spark, sf_dir).select("clip_id", F.col("wave").alias("data"))
    parts = segments.split_sequences(w, 12, 3)
    rows = parts.select("clip_id", F.posexplode("data").alias("frame", "score"), F.lit("a").alias("label"))
    return tidy(segments.merge_segment_scores(rows, 3).drop("label"))


@query("u7_segmenter", """
SELECT clip_id, CAST(ceil(greatest(seq_len - 50, 0) / 40e0) AS BIGINT) + 1 AS n_segments, least(seq_len, 50) AS first_length FROM v_clips""", "v_clips")
def segmenter(spark, sf_dir):
    clips = v.clips(spark, sf_dir).select("clip_id", F.sequence(F.lit(1), F.col("seq_len").cast("int")).alias("data"))
    parts = segments.split_sequences(clips, 50, 10).select(lab.segment_parts("clip_id").alias("p"), "seq_len")
    rows = parts.select("p.*", "seq_len").groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.max(F.when(F.col("segment") == 0, F.col("seq_len"))).alias("first_length"))
    return tidy(rows)


# ---------------------------------------------------------------- frame grids and targets

@query("f2_frame_times", """
SELECT clip_id, label, frame, round_even(frame * 2e-2, 6) AS onset, round_even((frame + 1) * 2e-2, 6) AS "offset" FROM v_scores""", "v_scores")
def frame_times(spark, sf_dir):
    s = v.scores(spark, sf_dir)
    return s.select("clip_id", "label", "frame", lab.frame_time("frame").alias("onset"), lab.frame_time(F.col("frame") + 1).alias("offset"))


@query("f2_segment_grid", """
WITH g AS (SELECT clip_id, audio_length, 400 * 2e-2 AS step FROM v_clips),
t AS (SELECT clip_id, audio_length, step, unnest(range(CAST(greatest(ceil(audio_length / step), 0) AS BIGINT))) AS i FROM g)
SELECT clip_id, round(i * step, 6) AS t FROM t UNION ALL SELECT clip_id, round(audio_length, 6) FROM g""", "v_clips")
def segment_grid(spark, sf_dir):
    c = v.clips(spark, sf_dir)
    return tidy(c.select("clip_id", F.explode(lab.segment_grid("audio_length", 500, 100, 0.02)).alias("t")))


@query("f2_segment_grid_late", """
WITH g AS (SELECT clip_id, audio_length, 400 * 2e-2 AS step, 502 * 2e-2 AS first FROM v_clips),
t AS (SELECT clip_id, step, first, unnest(range(CAST(greatest(ceil((audio_length - first) / step), 0) AS BIGINT))) AS i FROM g)
SELECT clip_id, round(first + i * step - 1e0, 6) AS t FROM t UNION ALL SELECT clip_id, round(audio_length, 6) FROM g UNION ALL SELECT clip_id, 0e0 FROM g""", "v_clips")
def segment_grid_late(spark, sf_dir):
    c = v.clips(spark, sf_dir)
    return tidy(c.select("clip_id", F.explode(lab.segment_grid("audio_length", 500, 100, 0.02, late=True)).alias("t")))


_FRAMES = """
ef AS (SELECT det_id, clip_id, label, CAST(floor(round(onset * 16e3, 6)) AS BIGINT) AS s0, CAST(ceil(round("offset" * 16e3, 6)) AS BIGINT) AS s1 FROM v_det)"""


@query("f3_event_frames", f"""WITH {_FRAMES}
SELECT det_id, s0 AS start_samples, s1 AS stop_samples, CAST(floor(s0 / 320e0) AS BIGINT) AS start_frames, CAST(ceil(s1 / 320e0) AS BIGINT) AS stop_frames FROM ef""", "v_det")
def event_frames(spark, sf_dir):
    out = targets.events_to_frames(v.detections(spark, sf_dir))
    return tidy(out.select("det_id", "start_samples", "stop_samples", "start_frames", "stop_frames"))


@query("f4_weak_targets", """
SELECT clip_id, k AS label, CASE WHEN (k = 'quality' AND quality = 1) OR (k = 'toxic' AND toxic = 1) THEN 1e0 WHEN NOT labeled THEN 5e-1 ELSE 0e0 END AS target
FROM v_clips, (VALUES ('quality'), ('spam'), ('toxic')) t(k)""", "v_clips")
def weak_targets(spark, sf_dir):
    return tidy(targets.weak_targets(v.clips(spark, sf_dir), ["quality", "spam", "toxic"]))


# lines of an order as labels in frames: start from the line number, length from the quantity
def _line_events(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber").cast("bigint") * 3
    kind = F.when(F.col("l_linestatus") == "F", "strong").when(F.col("l_tax") > 0.04, "boundaries").otherwise("weak")
    return li.select(F.col("l_orderkey").cast("string").alias("clip_id"), F.col("l_returnflag").alias("label"),
                     kind.alias("label_type"), start.alias("start"), (start + F.floor(F.col("l_quantity") / 5)).alias("stop"))


def _line_clips(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("clip_id"), F.lit(24).cast("bigint").alias("seq_len"),
                    (F.col("o_orderstatus") == "P").alias("unlabeled"))


_LINES = """
le AS (SELECT CAST(l_orderkey AS VARCHAR) AS clip_id, l_returnflag AS label,
              CASE WHEN l_linestatus = 'F' THEN 'strong' WHEN l_tax > 0.04e0 THEN 'boundaries' ELSE 'weak' END AS label_type,
              l_linenumber * 3 AS start, l_linenumber * 3 + CAST(floor(l_quantity / 5) AS BIGINT) AS stop FROM lineitem),
lb AS (SELECT clip_id, label, min(start) AS start, max(stop) AS stop FROM le WHERE label_type <> 'weak' GROUP BY 1, 2),
lk AS (SELECT CAST(o_orderkey AS VARCHAR) AS clip_id, o_orderstatus = 'P' AS unlabeled FROM orders),
fr AS (SELECT clip_id, unlabeled, frame, label FROM lk, (SELECT unnest(range(24)) AS frame), (VALUES ('A'), ('N'), ('R')) t(label))"""
_TARGET = """
SELECT f.clip_id, f.frame, f.label, CASE WHEN x.clip_id IS NOT NULL THEN 1e0 WHEN unlabeled OR y.clip_id IS NOT NULL THEN 5e-1 ELSE 0e0 END AS target
FROM fr f LEFT JOIN (SELECT DISTINCT clip_id, label, frame FROM {fine} JOIN (SELECT unnest(range(24)) AS frame) ON frame >= start AND frame < stop {where}) x
  ON x.clip_id = f.clip_id AND x.label = f.label AND x.frame = f.frame
LEFT JOIN (SELECT DISTINCT clip_id, label, frame FROM le JOIN (SELECT unnest(range(24)) AS frame) ON frame >= start AND frame < stop) y
  ON y.clip_id = f.clip_id AND y.label = f.label AND y.frame = f.frame"""


@query("a6_label_boundaries", f"WITH {_LINES} SELECT clip_id, label, start, stop FROM lb")
def label_boundaries(spark, sf_dir):
    return tidy(targets.label_boundaries(_line_events(spark, sf_dir)))


_STRONG_WHERE = "WHERE label_type = 'strong'"
_SUMMARY = "SELECT clip_id, label, target, count(*) AS n, CAST(sum(frame) AS BIGINT) AS frames, CAST(sum(1::BIGINT << frame) AS BIGINT) AS mask FROM ({}) GROUP BY 1, 2, 3"


def _summary(rows):
    """Frames per clip, class and target value: number, sum of positions, and a bit for every frame."""
    bit = F.expr("shiftleft(1L, cast(frame as int))")
    return tidy(rows.groupBy("clip_id", "label", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("frames"), F.sum(bit).alias("mask")))


@query("f5_boundary_targets", f"WITH {_LINES} {_SUMMARY.format(_TARGET.format(fine='lb', where=''))}")
def boundary_targets(spark, sf_dir):
    return _summary(targets.frame_targets(_line_clips(spark, sf_dir), _line_events(spark, sf_dir), ["A", "N", "R"], "boundaries"))


@query("f6_strong_targets", f"WITH {_LINES} {_SUMMARY.format(_TARGET.format(fine='le', where=_STRONG_WHERE))}")
def strong_targets(spark, sf_dir):
    return _summary(targets.frame_targets(_line_clips(spark, sf_dir), _line_events(spark, sf_dir), ["A", "N", "R"], "strong"))

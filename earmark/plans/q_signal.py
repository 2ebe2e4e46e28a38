"""Waveform operators (F7-F11, U8s, U6)."""

import pandas as pd
from pyspark.sql import functions as F

from earmark.functions import signal
from earmark.plans import views as v
from earmark.plans.registry import query, tidy


@query("f7_max_normalise", """
SELECT CAST(vec_id AS VARCHAR) AS clip_id, i, round(CAST(embedding[i + 1] AS DOUBLE) / peak, 6) AS x FROM (
  SELECT *, unnest(range(len(embedding))) AS i, list_max(list_transform(embedding, lambda z: abs(CAST(z AS DOUBLE)))) AS peak FROM embeddings)""")
def max_normalise(spark, sf_dir):
    w = v.waves(spark, sf_dir)
    return tidy(w.select("clip_id", F.posexplode(signal.max_normalise("wave")).alias("i", "x")))


@query("f7_mono_mix", """
SELECT CAST(vec_id AS VARCHAR) AS clip_id, i, round((CAST(embedding[i + 1] AS DOUBLE) + CAST(embedding[64 - i] AS DOUBLE)) / 2, 6) AS x FROM (
  SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)""")
def mono_mix(spark, sf_dir):
    w = v.waves(spark, sf_dir)
    return tidy(w.select("clip_id", F.posexplode(signal.mono(F.array("wave", F.reverse("wave")))).alias("i", "x")))


@query("f8_gain_bounds", """
SELECT CAST(vec_id AS VARCHAR) AS clip_id, true AS bounded, true AS scaled FROM embeddings""")
def gain_bounds(spark, sf_dir):
    w = v.waves(spark, sf_dir).withColumn("gain", signal.random_gain("clip_id", seed=5))
    ratio = F.array_max(signal.scale_wave("wave", "gain")) - F.array_max("wave") * F.col("gain")
    return w.select("clip_id", F.col("gain").between(1 / 3 - 1e-9, 3 + 1e-9).alias("bounded"), (F.abs(ratio) < 1e-9).alias("scaled"))


@query("f8_random_gain")
def random_gain(spark, sf_dir):
    w = v.waves(spark, sf_dir).withColumn("gain", signal.random_gain("clip_id", seed=5))
    return tidy(w.select("clip_id", "gain", F.array_max(signal.scale_wave("wave", "gain")).alias("peak")))


def _pairs(spark, sf_dir):
    w = v.waves(spark, sf_dir).withColumn("wave", F.slice("wave", F.lit(1), (F.col("vec_id") % 20 + 44).cast("int")))
    other = v.waves(spark, sf_dir).select(
        (F.col("vec_id") + 1).alias("vec_id"), *[F.col(c).alias(f"mix_{c}") for c in ("clip_id", "dataset", "wave", "events", "unlabeled")])
    return w.join(other, "vec_id")


@query("f9_superpose")
def superpose(spark, sf_dir):
    return tidy(signal.superpose(_pairs(spark, sf_dir), 0.5, fade_length=6, seed=1).select(
        "clip_id", "dataset", "seq_len", "start", "mix_start", "unlabeled", F.size("events").alias("n_events"),
        F.aggregate("wave", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("f9_superpose_shape", """
WITH w AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS clip_id, 44 + vec_id % 20 AS n FROM embeddings)
SELECT a.clip_id || '+' || b.clip_id AS clip_id, true AS enough_overlap, true AS one_starts_at_zero, 2 AS n_events
FROM w a JOIN w b ON b.vec_id + 1 = a.vec_id""")
def superpose_shape(spark, sf_dir):
    """At least half of the shorter clip overlaps, and the mixture starts with one of the clips."""
    p = _pairs(spark, sf_dir).withColumn("n", F.size("wave"))
    ids = p.select(F.concat_ws("+", "clip_id", "mix_clip_id").alias("clip_id"), "n")
    out = signal.superpose(p, 0.5, seed=1).join(ids, "clip_id")
    shared = F.least(F.col("start") + F.col("n"), F.col("mix_start") + 64) - F.greatest("start", "mix_start")
    return tidy(out.select("clip_id", (shared >= F.ceil(F.least(F.col("n"), F.lit(64)) / 2)).alias("enough_overlap"),
                           (F.least("start", "mix_start") == 0).alias("one_starts_at_zero"), F.size("events").alias("n_events")))


@query("f9_superpose_full_overlap", """
WITH w AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS clip_id, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS dataset, vec_id % 5 = 0 AS u, embedding AS e FROM embeddings)
SELECT a.clip_id || '+' || b.clip_id AS clip_id, CASE WHEN a.dataset = b.dataset THEN a.dataset ELSE 'a+b' END AS dataset, a.u OR b.u AS unlabeled,
       len(a.e) AS seq_len, round(list_sum(list_transform(a.e, lambda x: CAST(x AS DOUBLE))) + list_sum(list_transform(b.e, lambda x: CAST(x AS DOUBLE))), 6) AS total
FROM w a JOIN w b ON b.vec_id + 1 = a.vec_id""")
def superpose_full_overlap(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).join(v.waves(spark, sf_dir).select("vec_id", F.col("wave").alias("full")), "vec_id")
    pairs = pairs.drop("wave").withColumnRenamed("full", "wave")
    out = signal.superpose(pairs, 1.0, max_length=64)
    return tidy(out.select("clip_id", "dataset", "unlabeled", "seq_len", F.aggregate("wave", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("u8s_union_events", """
SELECT a.vec_id, 'c' || e.label AS label, e.label * 2 + s AS start, e.label * 2 + 20 + s AS stop FROM embeddings a
JOIN (SELECT vec_id, label, 3 AS s FROM embeddings UNION ALL SELECT vec_id + 1, label, 10 FROM embeddings) e ON e.vec_id = a.vec_id
WHERE a.vec_id IN (SELECT vec_id + 1 FROM embeddings)""")
def union_events(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumns({"a": F.lit(3), "b": F.lit(10)})
    e = p.select("vec_id", F.explode(signal.union_events("events", "a", "mix_events", "b")).alias("e"))
    return tidy(e.select("vec_id", "e.label", "e.start", "e.stop"))


@query("u6_gain_function", """
SELECT CAST(vec_id AS VARCHAR) AS clip_id, round(CASE WHEN p > 0.3e0 THEN p * 0.5e0 ELSE p END, 6) AS peak FROM (
  SELECT vec_id, list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS p FROM embeddings)""")
def gain_function(spark, sf_dir):
    @F.pandas_udf("double")
    def half_if_loud(peak: pd.Series) -> pd.Series:
        return (peak > 0.3).map({True: 0.5, False: 1.0})

    w = v.waves(spark, sf_dir).withColumn("gain", half_if_loud(F.array_max("wave")))
    return tidy(w.select("clip_id", F.array_max(signal.scale_wave("wave", "gain")).alias("peak")))


# frames of 24 samples every 8, windowed, transformed with size 32: 17 bins
_DFT = """
fr AS (SELECT CAST(vec_id AS VARCHAR) AS clip_id, frame, n, CAST(embedding[frame * 8 - 8 + n + 1] AS DOUBLE) * (0.5e0 - 0.5e0 * cos(2 * pi() * n / 24)) AS x
       FROM embeddings, (SELECT unnest(range(8)) AS frame), (SELECT unnest(range(24)) AS n)
       WHERE frame * 8 - 8 + n BETWEEN 0 AND 63),
pw AS (SELECT clip_id, frame, k, sum(x * cos(2 * pi() * k * n / 32)) ** 2 + sum(x * sin(2 * pi() * k * n / 32)) ** 2 AS p
       FROM fr, (SELECT unnest(range(17)) AS k) GROUP BY 1, 2, 3)"""


@query("f10_power_spectrum", f"""WITH {_DFT} SELECT clip_id, frame, k AS bin, round(p, 6) AS power FROM pw""")
def power_spectrum(spark, sf_dir):
    out = signal.spectrum_frames(v.waves(spark, sf_dir), shift=8, window=24, size=32, number="double")
    return tidy(out.select("clip_id", "frame", F.posexplode("features").alias("bin", "power")))


@query("f11_log_mel", f"""WITH {_DFT},
edge AS (SELECT i, 700 * (10 ** (i * 2595 * log10(1 + 8000 / 700e0) / 9 / 2595) - 1) AS f FROM (SELECT unnest(range(10)) AS i)),
bank AS (SELECT b.i AS band, k, greatest(least((k * 500 - a.f) / (b.f - a.f), (c.f - k * 500) / (c.f - b.f)), 0) AS w
         FROM edge a JOIN edge b ON b.i = a.i + 1 JOIN edge c ON c.i = a.i + 2, (SELECT unnest(range(17)) AS k))
SELECT clip_id, frame, band - 1 AS band, round(ln(greatest(sum(p * w), 1e-10)), 6) AS value FROM pw JOIN bank USING (k) GROUP BY 1, 2, 3""")
def log_mel(spark, sf_dir):
    out = signal.spectrum_frames(v.waves(spark, sf_dir), shift=8, window=24, size=32, n_mels=8, number="double")
    return tidy(out.select("clip_id", "frame", F.posexplode("features").alias("band", "value")))

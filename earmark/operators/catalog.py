"""Clip catalogue: ontology, label reconciliation, durations and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earmark.scale import cut_lineage

DEFAULT_CLIP_LENGTH = 10.0  # fixed value: clip length assumed where none is known


def map_codes(labels: DataFrame, names: DataFrame, code: str = "code", name: str = "label") -> DataFrame:
    """Replace label codes by names; an unknown code raises."""
    known = names.select(F.col("code").alias(code), F.col("name").alias(name), F.lit(True).alias("_known"))
    rows = labels.join(known, code, "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown label code "), F.col(code))).cast("string"))
    return rows.withColumn(name, checked.otherwise(F.col(name))).drop(code, "_known")


def ontology_edges(nodes: DataFrame) -> DataFrame:
    """``(parent, child)`` names from nodes ``(id, name, child_ids)``; unknown child ids raise."""
    children = nodes.select(F.col("name").alias("parent"), F.explode("child_ids").alias("code"))
    return map_codes(children, nodes.select(F.col("id").alias("code"), "name"), name="child").select("parent", "child")


def ontology_closure(edges: DataFrame) -> DataFrame:
    """All ``(ancestor, node)`` pairs, without self pairs.

    Each round climbs one level from the pairs found last; it ends when nothing new appears, also on
    cyclic input. Rounds follow the depth of the graph, not its size.
    """
    edges = edges.select("parent", "child").distinct()
    closure = cut_lineage(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"))
                          .where("ancestor <> node"))
    frontier = closure
    while True:
        up = (frontier.join(edges.withColumnRenamed("child", "ancestor"), "ancestor")
              .select(F.col("parent").alias("ancestor"), "node").where("ancestor <> node").distinct())
        frontier = cut_lineage(up.join(closure, ["ancestor", "node"], "left_anti"))
        if frontier.isEmpty():
            return closure
        closure = closure.unionByName(frontier)


def ontology_lists(nodes: DataFrame, closure: DataFrame, descendants: DataFrame | None = None) -> DataFrame:
    """Per node the sorted ``ancestor_names`` and ``descendant_names`` (empty at roots and leaves).

    For label ontologies, whose lists fit a row. Where leaves are data (millions of members under one
    root), pass the class-level pairs as ``descendants`` and keep members in the long closure.
    """
    def names(df, key, value, out):
        return df.groupBy(F.col(key).alias("name")).agg(F.sort_array(F.collect_set(value)).alias(out))

    none = F.array().cast("array<string>")
    below = closure if descendants is None else descendants
    rows = (nodes.select("name")
            .join(names(closure, "node", "ancestor", "ancestor_names"), "name", "left")
            .join(names(below, "ancestor", "node", "descendant_names"), "name", "left"))
    return rows.withColumns({c: F.coalesce(F.col(c), none) for c in ("ancestor_names", "descendant_names")})


def ontology_members(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """``name, ancestor_names, descendant``: a row per descendant of every node, one with NULL for a leaf.

    Ancestors are as many as the ontology is deep and fit an array; descendants may be data, so they stay rows.
    """
    above = closure.groupBy(F.col("node").alias("name")).agg(F.sort_array(F.collect_set("ancestor")).alias("ancestor_names"))
    below = closure.select(F.col("ancestor").alias("name"), F.col("node").alias("descendant"))
    rows = nodes.select("name").join(above, "name", "left").join(below, "name", "left")
    return rows.withColumn("ancestor_names", F.coalesce("ancestor_names", F.array().cast("array<string>")))


def add_ancestor_events(events: DataFrame, closure: DataFrame, classes: DataFrame) -> DataFrame:
    """Add every ancestor in ``classes`` of each event in ``classes``, with the same times and type."""
    wanted = classes.select("label")
    pairs = (closure.join(wanted.withColumnRenamed("label", "node"), "node", "left_semi")
             .join(wanted.withColumnRenamed("label", "ancestor"), "ancestor", "left_semi"))
    added = (events.join(pairs.withColumnRenamed("node", "label"), "label")
             .drop("label").withColumnRenamed("ancestor", "label"))
    return events.unionByName(added.select(*events.columns)).distinct()


def reconcile_labels(tags: DataFrame, strong: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """Merge weak tags with strong events of the same clip.

    ``tags (clip_id, label)``, ``strong (clip_id, onset, offset, label)``, ``clips (clip_id,
    audio_length)``. In clips with strong labels: tags not seen among the strong events become weak
    events over the clip (``arm`` 0), then strong events of tagged classes (``arm`` 1). Other clips
    keep their tags without times. Order a clip by ``arm, onset, offset, label``.
    """
    timed = strong.select("clip_id").distinct().withColumn("_timed", F.lit(True))
    unseen = tags.join(strong.select("clip_id", "label"), ["clip_id", "label"], "left_anti")
    if clips is not None:
        unseen = unseen.join(clips.select("clip_id", "audio_length"), "clip_id", "left")
    else:
        unseen = unseen.withColumn("audio_length", F.lit(None).cast("double"))
    unseen = unseen.join(timed, "clip_id", "left")
    has = F.col("_timed").isNotNull()
    weak = unseen.select(
        "clip_id", F.when(has, F.lit(0.0)).alias("onset"),
        F.when(has, F.coalesce("audio_length", F.lit(DEFAULT_CLIP_LENGTH))).alias("offset"),
        "label", F.lit("weak").alias("label_type"), F.lit(0).alias("arm"))
    matching = strong.join(tags.select("clip_id", "label").distinct(), ["clip_id", "label"], "left_semi").select(
        "clip_id", "onset", "offset", "label", F.lit("strong").alias("label_type"), F.lit(1).alias("arm"))
    return weak.unionByName(matching)


def strong_dataset(tags: DataFrame, strong: DataFrame) -> DataFrame:
    """All strong events of the clips that also appear in a weak dataset."""
    return strong.join(tags.select("clip_id").distinct(), "clip_id", "left_semi")


def strong_dataset_name(name) -> Column:
    """Strong label set that belongs to a weak dataset."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.contains("eval"), F.lit("eval_strong")).otherwise(F.lit("train_strong"))


def attach_durations(clips: DataFrame, probe: DataFrame) -> DataFrame:
    """Add ``audio_length`` and ``available`` from a probe ``(audio_path, audio_length)``.

    Unreadable or empty files lose their path; the row stays.
    """
    rows = clips.drop("audio_length").join(probe.select("audio_path", "audio_length"), "audio_path", "left")
    ok = F.coalesce(F.col("audio_length") > 0, F.lit(False))
    return rows.withColumns({"available": ok, "audio_length": F.when(ok, F.col("audio_length")),
                             "audio_path": F.when(ok, F.col("audio_path"))})


def missing_and_damaged(clips: DataFrame, listing: DataFrame, probe: DataFrame) -> DataFrame:
    """Clips that cannot be used: ``missing`` without a file, ``damaged`` with an unreadable one."""
    files = listing.select(F.col("audio_path"), F.lit(True).alias("_file")).distinct()
    ok = probe.where("audio_length > 0").select("audio_path")
    bad = clips.join(ok, "audio_path", "left_anti").join(files, "audio_path", "left")
    return bad.select("dataset", "clip_id", "audio_path",
                      F.when(F.col("_file").isNull(), F.lit("missing")).otherwise(F.lit("damaged")).alias("state"))


def exclude_clips(clips: DataFrame, ids: DataFrame) -> DataFrame:
    return clips.join(ids.select("clip_id"), "clip_id", "left_anti")


def select_clips(clips: DataFrame, ids: DataFrame) -> DataFrame:
    return clips.join(ids.select("clip_id"), "clip_id", "left_semi")


def class_sets(events: DataFrame) -> DataFrame:
    """Distinct ``(label_type, label)``."""
    return events.select("label_type", "label").distinct()


def catalogue_statistics(tags: DataFrame, strong: DataFrame, availability: DataFrame) -> DataFrame:
    """Per dataset, and overall (dataset NULL): strong labels, those matching a tag, missing, damaged.

    ``tags (dataset, clip_id, label)``, ``strong (clip_id, onset, offset, label)``,
    ``availability (dataset, clip_id, state)``.
    """
    clip = tags.select("dataset", "clip_id").distinct()
    tagged = tags.select("dataset", "clip_id", "label", F.lit(True).alias("_tagged")).distinct()
    labels = (strong.join(clip, "clip_id").join(tagged, ["dataset", "clip_id", "label"], "left")
              .groupBy("dataset").agg(F.count(F.lit(1)).alias("n_strong"),
                                      F.count("_tagged").alias("n_matching")))
    states = availability.groupBy("dataset").agg(
        F.count_if(F.col("state") == "missing").alias("n_missing"),
        F.count_if(F.col("state") == "damaged").alias("n_damaged"))
    rows = clip.select("dataset").distinct().join(labels, "dataset", "left").join(states, "dataset", "left")
    cols = ("n_strong", "n_matching", "n_missing", "n_damaged")
    rows = rows.na.fill(0, list(cols))
    total = rows.agg(*[F.sum(c).alias(c) for c in cols])
    return rows.unionByName(total, allowMissingColumns=True)

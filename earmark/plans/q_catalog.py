"""Catalogue and label operators."""

from pyspark.sql import functions as F

from earmark.functions import labels as lab
from earmark.operators import catalog
from earmark.plans import views as v
from earmark.plans.registry import query, tidy
from earmark.scale import cut_lineage
from earmark.sources import audio


@query("j1_code_lookup", """
SELECT c_custkey AS clip_id, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def code_lookup(spark, sf_dir):
    names = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    c = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), F.col("c_nationkey").cast("string").alias("code"))
    return catalog.map_codes(c, names).select("clip_id", "label")


@query("j2_reconcile_labels", """
WITH timed AS (SELECT DISTINCT clip_id FROM v_strong),
seen AS (SELECT DISTINCT clip_id, label FROM v_strong)
SELECT t.clip_id, CASE WHEN m.clip_id IS NOT NULL THEN 0e0 END AS onset,
       CASE WHEN m.clip_id IS NOT NULL THEN round(coalesce(o.audio_length, 10e0), 6) END AS "offset", t.label, 'weak' AS label_type, 0 AS arm
FROM v_tags t LEFT JOIN timed m USING (clip_id) LEFT JOIN v_orders o ON o.clip_id = t.clip_id
WHERE (t.clip_id, t.label) NOT IN (SELECT (clip_id, label) FROM seen)
UNION ALL SELECT clip_id, onset, round("offset", 6), label, 'strong', 1 FROM v_strong
WHERE (clip_id, label) IN (SELECT (clip_id, label) FROM v_tags)""", "v_tags", "v_strong", "v_orders")
def reconcile_labels(spark, sf_dir):
    return tidy(catalog.reconcile_labels(v.order_tags(spark, sf_dir), v.order_strong(spark, sf_dir), v.order_clips(spark, sf_dir)))


@query("j2_strong_dataset", """
SELECT clip_id, onset, round("offset", 6) AS "offset", label FROM v_strong WHERE clip_id IN (SELECT clip_id FROM v_tags)""", "v_tags", "v_strong")
def strong_dataset(spark, sf_dir):
    return tidy(catalog.strong_dataset(v.order_tags(spark, sf_dir), v.order_strong(spark, sf_dir)))


@query("j2_strong_dataset_name", """
SELECT name, CASE WHEN name LIKE '%eval%' THEN 'eval_strong' ELSE 'train_strong' END AS strong FROM (
  SELECT DISTINCT source || CASE WHEN lang = 'en' THEN '_eval' ELSE '_train' END AS name FROM documents)""")
def strong_dataset_name(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    names = d.select(F.concat("source", F.when(F.col("lang") == "en", "_eval").otherwise("_train")).alias("name")).distinct()
    return names.withColumn("strong", catalog.strong_dataset_name("name"))


def _nodes(spark, sf_dir):
    """Ontology nodes with child ids: regions list their nations."""
    n = v.table(spark, sf_dir, "nation")
    below = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.sort_array(F.collect_list(F.concat(F.lit("/m/n"), F.col("n_nationkey").cast("string")))).alias("kids"))
    r = v.table(spark, sf_dir, "region").join(below, "r_regionkey", "left")
    kids = F.col("kids")
    top = r.select(F.concat(F.lit("/m/r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), kids.alias("child_ids"))
    low = n.select(F.concat(F.lit("/m/n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
                   F.array().cast("array<string>").alias("child_ids"))
    return top.unionByName(low)


@query("j4_ontology_edges", """
SELECT r_name AS parent, n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey""")
def ontology_edges(spark, sf_dir):
    return catalog.ontology_edges(_nodes(spark, sf_dir))


@query("j5_ontology_closure", """
WITH RECURSIVE c AS (SELECT parent AS ancestor, child AS node FROM v_ontology
  UNION SELECT e.parent, c.node FROM c JOIN v_ontology e ON e.child = c.ancestor)
SELECT ancestor, node FROM c""", "v_ontology")
def ontology_closure(spark, sf_dir):
    return catalog.ontology_closure(v.ontology(spark, sf_dir))


@query("j5_ontology_lists", """
SELECT name, a AS ancestors, node AS descendant FROM (SELECT DISTINCT parent AS name FROM v_ontology UNION SELECT child FROM v_ontology)
LEFT JOIN (SELECT node AS name, string_agg(ancestor, ',' ORDER BY ancestor) AS a FROM v_closure GROUP BY 1) USING (name)
LEFT JOIN (SELECT ancestor AS name, node FROM v_closure) USING (name)""", "v_closure")
def ontology_lists(spark, sf_dir):
    """Ancestors of every node, and each of its descendants as a row."""
    edges = cut_lineage(v.ontology(spark, sf_dir))
    nodes = edges.select(F.col("parent").alias("name")).union(edges.select("child")).distinct()
    rows = catalog.ontology_members(nodes, catalog.ontology_closure(edges))
    names = F.when(F.size("ancestor_names") > 0, F.array_join("ancestor_names", ","))
    return rows.select("name", names.alias("ancestors"), "descendant")


@query("j6_ancestor_events", """
WITH cls AS (SELECT parent AS label FROM v_ontology UNION SELECT child FROM v_ontology WHERE child LIKE 'Customer%')
SELECT clip_id, onset, "offset", label, label_type FROM v_cust_events
UNION SELECT clip_id, onset, "offset", ancestor, label_type FROM v_cust_events JOIN v_closure ON node = label
WHERE ancestor IN (SELECT label FROM cls)""", "v_cust_events", "v_closure")
def ancestor_events(spark, sf_dir):
    edges = cut_lineage(v.ontology(spark, sf_dir))
    classes = edges.select(F.col("parent").alias("label")).union(edges.where(F.col("child").startswith("Customer")).select("child")).distinct()
    return tidy(catalog.add_ancestor_events(v.customer_events(spark, sf_dir), catalog.ontology_closure(edges), classes))


@query("j7_select_clips", "SELECT clip_id, dataset FROM v_orders WHERE clip_id IN (SELECT clip_id FROM v_strong)", "v_orders", "v_strong")
def select_clips(spark, sf_dir):
    return catalog.select_clips(v.order_clips(spark, sf_dir), v.order_strong(spark, sf_dir)).select("clip_id", "dataset")


@query("j7_exclude_clips", "SELECT clip_id, dataset FROM v_orders WHERE clip_id NOT IN (SELECT clip_id FROM v_strong)", "v_orders", "v_strong")
def exclude_clips(spark, sf_dir):
    return catalog.exclude_clips(v.order_clips(spark, sf_dir), v.order_strong(spark, sf_dir)).select("clip_id", "dataset")


# ---------------------------------------------------------------- durations and statistics

def _probe(spark, sf_dir):
    """Orders with lines have a file; files of clips without a length are unreadable."""
    clips = v.order_clips(spark, sf_dir)
    files = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("clip_id"))
    found = clips.join(files, "clip_id", "left_semi")
    return clips, found.select("audio_path"), found.select("audio_path", F.coalesce("audio_length", F.lit(0.0)).alias("audio_length"))


_STATES = """
st AS (SELECT dataset, clip_id, audio_path, CASE WHEN NOT f THEN 'missing' ELSE 'damaged' END AS state FROM (
         SELECT *, CAST(clip_id AS BIGINT) IN (SELECT l_orderkey FROM lineitem) AS f FROM v_orders)
       WHERE NOT f OR coalesce(audio_length, 0) <= 0)"""


@query("j3_attach_durations", """
SELECT clip_id, dataset, CASE WHEN ok THEN audio_path END AS audio_path, CASE WHEN ok THEN round(audio_length, 6) END AS audio_length, ok AS available
FROM (SELECT *, CAST(clip_id AS BIGINT) IN (SELECT l_orderkey FROM lineitem) AND coalesce(audio_length, 0) > 0 AS ok FROM v_orders)""", "v_orders")
def attach_durations(spark, sf_dir):
    clips, _, probe = _probe(spark, sf_dir)
    out = catalog.attach_durations(clips, probe)
    return tidy(out.select("clip_id", "dataset", "audio_path", "audio_length", "available"))


@query("s8_missing_and_damaged", f"WITH {_STATES} SELECT dataset, clip_id, audio_path, state FROM st", "v_orders")
def missing_and_damaged(spark, sf_dir):
    return catalog.missing_and_damaged(*_probe(spark, sf_dir))


@query("a1_class_sets", """
SELECT DISTINCT 'weak' AS label_type, label FROM v_tags UNION SELECT DISTINCT 'strong', label FROM v_strong""", "v_tags", "v_strong")
def class_sets(spark, sf_dir):
    weak = v.order_tags(spark, sf_dir).select(F.lit("weak").alias("label_type"), "label")
    return catalog.class_sets(weak.unionByName(v.order_strong(spark, sf_dir).select(F.lit("strong").alias("label_type"), "label")))


@query("a2_catalogue_statistics", f"""WITH {_STATES},
tg AS (SELECT dataset, t.clip_id, label FROM v_tags t JOIN v_orders o USING (clip_id)),
ds AS (SELECT DISTINCT dataset FROM tg),
sl AS (SELECT c.dataset, count(*) AS n_strong, count(g.label) AS n_matching
       FROM v_strong s JOIN (SELECT DISTINCT dataset, clip_id FROM tg) c USING (clip_id)
       LEFT JOIN tg g ON g.clip_id = s.clip_id AND g.label = s.label AND g.dataset = c.dataset GROUP BY 1),
ss AS (SELECT dataset, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'damaged') AS n_damaged FROM st GROUP BY 1),
x AS (SELECT dataset, coalesce(n_strong, 0) AS n_strong, coalesce(n_matching, 0) AS n_matching, coalesce(n_missing, 0) AS n_missing,
             coalesce(n_damaged, 0) AS n_damaged FROM ds LEFT JOIN sl USING (dataset) LEFT JOIN ss USING (dataset))
SELECT * FROM x UNION ALL SELECT NULL, CAST(sum(n_strong) AS BIGINT), CAST(sum(n_matching) AS BIGINT), CAST(sum(n_missing) AS BIGINT),
       CAST(sum(n_damaged) AS BIGINT) FROM x""", "v_tags", "v_strong", "v_orders")
def catalogue_statistics(spark, sf_dir):
    clips, listing, probe = _probe(spark, sf_dir)
    tags = v.order_tags(spark, sf_dir).join(clips.select("clip_id", "dataset"), "clip_id").select("dataset", "clip_id", "label")
    return tidy(catalog.catalogue_statistics(tags, v.order_strong(spark, sf_dir), catalog.missing_and_damaged(clips, listing, probe)))


@query("s6_dataset_discovery", """
SELECT CASE WHEN purpose = name THEN purpose ELSE purpose || '_' || name END AS dataset, clip_id, path AS audio_path FROM (
  SELECT lang AS purpose, CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS name, 'c_' || doc_id AS clip_id,
         'db/audio/' || lang || '/' || CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END || '/c_' || doc_id || '.wav' AS path FROM documents)""")
def dataset_discovery(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.col("source"))
    path = F.concat(F.lit("db/audio/"), F.col("lang"), F.lit("/"), name, F.lit("/c_"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return audio.discover_datasets(d.select(path.alias("audio_path")))


@query("s7_wav_probe", """
SELECT 'w' || vec_id AS audio_path, CASE WHEN vec_id % 6 = 0 THEN 0e0 ELSE round(len(embedding) / 16000e0, 6) END AS audio_length FROM embeddings""")
def wav_probe(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    # RIFF header, format chunk (mono, 16 kHz, 16 bit), data chunk of 64 samples; every sixth file is cut short
    head = "52494646a400000057415645666d7420100000000100010080 3e0000007d00000200100064617461".replace(" ", "")
    data = F.repeat(F.lit("0000"), F.size("embedding"))
    size = F.lpad(F.hex(F.size("embedding") * 2), 2, "0")
    full = F.concat(F.lit(head), size, F.lit("000000"), data)
    content = F.unhex(F.when(F.col("vec_id") % 6 == 0, F.substring(full, 1, 40)).otherwise(full))
    return tidy(audio.probe_durations(e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("audio_path"), content.alias("content"))))


@query("u5_example_post_processing", """
SELECT clip_id, upper(dataset) AS dataset FROM v_orders""", "v_orders")
def example_post_processing(spark, sf_dir):
    return v.order_clips(spark, sf_dir).transform(lambda df: df.withColumn("dataset", F.upper("dataset"))).select("clip_id", "dataset")


# ---------------------------------------------------------------- labels of a clip

@query("p5_target_classes", """
SELECT c.clip_id, c.labeled, count(l.label) AS n FROM v_clips c LEFT JOIN v_clip_labels l ON l.clip_id = c.clip_id AND l.label IN ('toxic')
GROUP BY 1, 2""", "v_clips", "v_clip_labels")
def target_classes(spark, sf_dir):
    c = v.clips(spark, sf_dir).withColumn("events", lab.keep_classes("events", ["toxic"]))
    return tidy(c.select("clip_id", F.col("events").isNotNull().alias("labeled"),
                         F.coalesce(F.array_size("events"), F.lit(0)).alias("n")))


_STATE = """
s AS (SELECT doc_id, n_chars / 1e2 AS len, doc_id % 3 AS kind,
             CASE WHEN lang = 'en' THEN ['a'] ELSE ['a', 'b'] END AS labels FROM documents)"""


@query("p6_label_state", f"""WITH {_STATE},
ev AS (SELECT doc_id, kind, len, unnest(labels) AS label, unnest(range(len(labels))) AS i FROM s WHERE kind <> 2)
SELECT s.doc_id, kind = 2 AS unlabeled, e.label, CASE WHEN e.i IS NOT NULL THEN CASE WHEN kind = 0 THEN CAST(e.i AS DOUBLE) ELSE 0e0 END END AS onset,
       CASE WHEN e.i IS NOT NULL THEN CASE WHEN kind = 0 THEN e.i + 1.5e0 ELSE round(s.len, 6) END END AS "offset",
       CASE WHEN e.i IS NOT NULL THEN CASE WHEN kind = 0 THEN 'strong' ELSE 'weak' END END AS label_type
FROM s LEFT JOIN (SELECT doc_id, label, i FROM ev) e USING (doc_id)""")
def label_state(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    labels = F.when(F.col("lang") == "en", F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    clips = d.select("doc_id", (F.col("n_chars") / 100.0).alias("audio_length"), F.when(kind != 2, labels).alias("labels"),
                     F.when(kind == 0, F.transform(labels, lambda x, i: i.cast("double"))).alias("starts"),
                     F.when(kind == 0, F.transform(labels, lambda x, i: i + 1.5)).alias("stops"))
    out = lab.label_state(clips)
    return tidy(out.select("doc_id", "unlabeled", F.explode_outer("events").alias("e"))
                .select("doc_id", "unlabeled", "e.label", "e.onset", "e.offset", "e.label_type"))


@query("p8_class_names", """
SELECT DISTINCT name, replace(replace(replace(replace(replace(name, ', ', '__'), ' ', ''), '''', ''), '(', '_'), ')', '_') AS clean
FROM (SELECT c_mktsegment || ', ' || o_orderpriority || ' (it''s)' AS name FROM customer JOIN orders ON o_custkey = c_custkey)""")
def class_names(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").join(v.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = o.select(F.concat("c_mktsegment", F.lit(", "), "o_orderpriority", F.lit(" (it's)")).alias("name")).distinct()
    return names.withColumn("clean", lab.clean_class_name("name"))


@query("k4_sort_events", """
WITH e AS (SELECT vec_id, 'l' || (label * i % 3) AS label, CAST((label * i) % 4 AS DOUBLE) AS onset, (label * i) % 4 + (label + i) % 2 + 1e0 AS "offset"
           FROM embeddings, (SELECT unnest(range(1, 6)) AS i))
SELECT vec_id, label, onset, "offset", row_number() OVER (PARTITION BY vec_id ORDER BY onset, "offset", label) - 1 AS pos FROM e""")
def sort_events(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    events = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(
        ((F.col("label") * i) % 4).cast("double").alias("onset"),
        ((F.col("label") * i) % 4 + (F.col("label") + i) % 2 + 1.0).alias("offset"),
        F.concat(F.lit("l"), (F.col("label") * i % 3).cast("string")).alias("label")))
    rows = e.select("vec_id", F.posexplode(lab.sort_events(events)).alias("pos", "e"))
    return tidy(rows.select("vec_id", "e.label", "e.onset", "e.offset", "pos"))


@query("k5_natural_order", """
SELECT name, string_agg(CASE WHEN part ~ '^[0-9]' THEN lpad(CAST(length(ltrim(part, '0')) AS VARCHAR), 6, '0') || ltrim(part, '0') ELSE part END,
                        '' ORDER BY i) AS key FROM (
  SELECT name, unnest(regexp_extract_all(name, '[0-9]+|[^0-9]+')) AS part, generate_subscripts(regexp_extract_all(name, '[0-9]+|[^0-9]+'), 1) AS i
  FROM (SELECT source || '_' || doc_id * 7919 || '_' || n_chars || '.wav' AS name FROM documents)) GROUP BY 1""")
def natural_order(spark, sf_dir):
    """Names with three numbers and the key they are sorted by."""
    names = v.table(spark, sf_dir, "documents").select(F.concat(
        "source", F.lit("_"), (F.col("doc_id") * 7919).cast("string"), F.lit("_"), F.col("n_chars").cast("string"), F.lit(".wav")).alias("name"))
    return names.withColumn("key", lab.natural_key("name")[0])


@query("f1_id_parsing", """
SELECT doc_id, 'a_b' || doc_id AS cut, 'x_' || doc_id AS stripped, 'y' || doc_id AS source_id, 'z' || doc_id AS seg_clip, doc_id % 7 AS seg, 9 AS n_seg FROM documents""")
def id_parsing(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").withColumn("n", F.col("doc_id").cast("string"))
    part = lab.segment_parts(F.concat(F.lit("z"), "n", F.lit("_!segment!_"), (F.col("doc_id") % 7).cast("string"), F.lit("_9")))
    return tidy(d.select("doc_id", lab.cut_last_part(F.concat(F.lit("a_b"), "n", F.lit("_30000"))).alias("cut"),
                         lab.strip_wav(F.concat(F.lit("x_"), "n", F.lit(".wav"))).alias("stripped"),
                         lab.source_clip_id(F.concat(F.lit("Yy"), "n", F.lit("_10.000_20.000"))).alias("source_id"), part.alias("p"))
                .select("doc_id", "cut", "stripped", "source_id", F.col("p.clip_id").alias("seg_clip"), F.col("p.segment").alias("seg"),
                        F.col("p.n_segments").alias("n_seg")))

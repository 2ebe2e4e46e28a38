"""From raw documents to token ids: five stages, each with one operator of ``earmark.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it returns is written as Parquet and read again as the
next stage's ``docs``. Every stage but the last returns the columns of ``docs``. Rows with a NULL id or text pass all filters;
extra columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from earmark.llm import bpe, decontaminate, near_dups, paragraphs, toxicity as toxic
from earmark.llm.queries import table, tokenizer_file
from earmark.llm.store import settle


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of .5 or more go."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null")
    model = toxic.fit(texts, toxic.training_labels(table(spark, sf_dir, "labels"), "toxic"))
    kept = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(kept))])      # no column can clash with the score
    scored = toxic.score_texts(renamed, model, renamed.columns, renamed.columns[kept.index("text")], evidence=False)
    return scored.where("score < .5").drop("score").toDF(*kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates on five-word shingles the document with the smallest id stays, once.

    Rows that share an id but not the text are documents of their own: the one whose text has the smallest hash goes by the
    id, the others by numbers above all usual ids. Of rows equal in id and text the one stays whose columns are smallest as
    JSON. Rows with a NULL id all stay.
    """
    columns = docs.columns
    content = F.coalesce(F.xxhash64("text"), F.lit(0))
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(content).alias("low"), F.max(content).alias("high"), F.count(F.lit(1)).alias("rows"))
    again = settle(ids.where("rows > 1"))
    if again.isEmpty():
        gone = near_dups.near_duplicates(docs, shingle=5, percent=80).where("doc_id is not null and not kept")
        return docs.join(settle(gone.select("doc_id")), "doc_id", "left_anti").select(*columns)
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])          # no column can clash
    key, text = (f"c{columns.index(c)}" for c in ("doc_id", "text"))
    own = F.coalesce(F.xxhash64(text), F.lit(0))
    other = F.shiftrightunsigned(F.xxhash64(key, own), 2).bitwiseOR(F.lit(1 << 62))
    marked = settle(renamed.join(again.withColumnRenamed("doc_id", "_id"), F.col(key) == F.col("_id"), "left").withColumn(
        "_node", F.when(F.col("low").isNull() | (own == F.col("low")), F.col(key).cast("bigint")).otherwise(other))
        .drop("_id", "low", "high"))
    gone = near_dups.near_duplicates(marked, shingle=5, percent=80, id_col="_node", text_col=text)
    gone = settle(gone.where("_node is not null and not kept").select("_node").distinct())
    kept = marked.join(gone, "_node", "left_anti")
    row = F.struct(*renamed.columns)
    twice = kept.where("rows > 1").groupBy("_node").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.where("rows is null").select(*renamed.columns).unionByName(twice).toDF(*columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go but for their first occurrence; ``n_chars`` follows the text."""
    out = paragraphs.without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that repeats a benchmark item go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of every document that is left, and digest of the decoded text."""
    coded = bpe.round_trip(docs, tokenizer_file(), cached=60_000)     # beside heaps that earlier stages have grown
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("bpe", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

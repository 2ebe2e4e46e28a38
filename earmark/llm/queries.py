"""The operators as queries over the driver tables. ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from earmark.llm import oracles

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary; ``EARMARK_TOKENIZERS`` names another folder that all executors can read."""
    folder = os.environ.get("EARMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1(spark, sf_dir):
    """Tokens of every line of every document."""
    from earmark.llm.token_counts import section_counts
    return section_counts(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op5_token_codes")
def op5(spark, sf_dir):
    """Documents as read back from token code files."""
    from earmark.llm.token_codes import read_codes, write_codes
    manifest = write_codes(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=0)
    return read_codes(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_bpe")
def op9(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    from earmark.llm.bpe import round_trip
    coded = round_trip(table(spark, sf_dir, "documents"), tokenizer_file())
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_minhash_near_dedup")
def op3(spark, sf_dir):
    """Near-duplicate components of documents on four-word shingles."""
    from earmark.llm.near_dups import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op2_paragraph_dedup")
def op2(spark, sf_dir):
    """Repeated paragraphs that go, each with the document that keeps it."""
    from earmark.llm.paragraphs import repeated_paragraphs
    found = repeated_paragraphs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "n_words", F.col("kept_id").alias("kept_doc_id"), "kept_start", "component")


@query("op7_decontamination")
def op7(spark, sf_dir):
    """Benchmark items that documents repeat."""
    from earmark.llm.decontaminate import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    """Toxicity of documents by their nearest labelled examples."""
    from earmark.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality_rules")
def op8(spark, sf_dir):
    """Quality of documents by rules over their statistics."""
    from earmark.llm.quality import quality
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_kmeans_tree_search")
def op6(spark, sf_dir):
    """The 20 nearest vectors of every twentieth one."""
    from earmark.llm.vectors import nearest
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


@query("op10_arc_to_warc", """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages""")
def op10(spark, sf_dir):
    """Pages as read back from WARC files that were converted from ARC files."""
    from earmark.llm.archives import arc_to_warc, read_warc, write_arc
    from earmark.llm.store import settle, spread_join
    arc = write_arc(table(spark, sf_dir, "pages"))
    found = settle(read_warc(arc_to_warc(arc)))
    columns = [F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type"]
    revisits = found.where("refers_to_id is not null")
    first = found.select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to")).join(
        revisits.select("refers_to_id").distinct(), "refers_to_id")
    others = found.where("refers_to_id is null").select(*columns, F.lit(None).cast("bigint").alias("refers_to"))
    return spread_join(revisits, first, "refers_to_id", F.col("record_id")).select(*columns, "refers_to").unionByName(others)


@query("op11_source_mixing", oracles.MIXING)
def op11(spark, sf_dir):
    """How many words of every document a mix of the sources takes."""
    from earmark.llm.mixing import mixture
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_conversation_repair", oracles.REPAIR)
def op12(spark, sf_dir):
    """Faults of every damaged conversation and its cheapest repair."""
    from earmark.llm.conversations import audited, damaged
    rows = table(spark, sf_dir, "conversations")
    return audited(rows, damaged(rows))


@query("op13_spelling_variants", oracles.SPELLING)
def op13(spark, sf_dir):
    """Words with their near words and the form they are a variant of."""
    from earmark.llm.spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"))

"""Mixing sources to target weights by Pareto order sampling.

Every document gets an expected number of copies. Whole copies are certain; the fractions are inclusion probabilities of one
Pareto order sample per source: documents are ranked by random odds divided by inclusion odds, and the first of that order
are taken until the words still missing are filled. The random number of a row is a digest of its id and text, so reruns and
recomputed partitions agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.llm.store import settle
from earmark.scale import join_same, running

#: Fixed value: a word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ROWS = 200_000        # rows of a source that are ordered together


def word_count(text):
    """Number of words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, order, name: str) -> DataFrame:
    """0-based position of every row in ``order``, over all rows; each task numbers its own range of the order."""
    rows = settle(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_part", F.spark_partition_id())
                  .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # a row per range of the order
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, n_docs, target`` from rows of ``source, size``.

    Sources in order of code points, NULL last, weigh ``weights`` in turn and share ``share`` times all words. A target stops
    at ``most`` times the words of its source; what is over is shared again by weight until none is above. Each round needs
    two sums over the sources; the level rises from round to round and stops when no further source is full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int"))
    per = settle(per.withColumn("_weight", weight))
    total, left = per.agg(F.sum("source_size"), F.sum("_weight")).first()
    want, seen = share * (total or 0), (0, left)
    level = want / left if left else 0.0
    while True:
        over = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("_weight")
        now_full, open_ = per.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
                                  F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0))).first()
        if (now_full, open_) == seen or not open_:
            break
        seen, level = (now_full, open_), (want - most * now_full) / open_
    target = F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("_weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _scaled_rates(rows: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Sources with ``_level``: ``least(most, _level * rate)`` copies of every document are expected to fill the target."""
    level = settle(sources.withColumn("_level", F.lit(0.0)).withColumn("_full", F.lit(-1).cast("bigint")))
    while True:
        over = F.col("_level") * F.col("_rate") >= most
        sums = join_same(rows, level.select("source", "_level"), ["source"]).groupBy("source").agg(
            F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)).alias("_now"),
            F.coalesce(F.sum(F.when(~over, F.col("size") * F.col("_rate"))), F.lit(0.0)).alias("_open"))
        after = join_same(level, sums, ["source"])
        moved = (F.col("_now") != F.col("_full")) & (F.col("_open") > 0)
        after = settle(after.withColumn("_moved", moved).withColumn(
            "_level", F.when(moved, (F.col("target") - F.lit(most) * F.col("_now")) / F.col("_open")).otherwise(F.col("_level")))
            .withColumn("_full", F.col("_now")).drop("_now", "_open"))
        if after.where("_moved").isEmpty():
            return after.drop("_moved", "_full")
        level = after.drop("_moved")


def mixture(documents: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, rate: str | None = None,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """How often every document enters the mix: ``id_col, source, size, source_size, target, expected, copies, taken, key``.

    ``expected`` copies are ``target / source_size``, or in proportion to the positive column ``rate`` within a source, at
    most ``most``. ``copies`` is ``expected`` rounded down or up; ``taken`` is ``copies * size``. The last document of a
    source's order enters if at least half of its words fit, so the words of a source miss its target by half a document at
    most. ``key`` is a digest of id and text that names the row.

    NULL and empty texts have size 0 and take nothing; NULL sources are one source, the last; rows with a NULL id take part;
    rows equal in id and text share a random number, are ranked next to each other and may get different copies. Ties rank by
    id and size. Other columns are ignored. An empty table gives no rows. A source whose documents all have size 0 has target 0.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                            F.coalesce(F.col(text_col), F.lit("")), F.lit("" if seed == 0 else f":{seed}")))
    rate_of = F.lit(1.0) if rate is None else F.greatest(F.coalesce(F.col(rate).cast("double"), F.lit(0.0)), F.lit(1e-300))
    rows = settle(documents.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                                   word_count(F.col(text_col)).alias("size"), rate_of.alias("_rate"), digest.alias("key")))
    sources = source_targets(rows, weights, share, most)
    if rate is None:
        level = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        sources = sources.withColumn("_level", level)
    else:
        sources = _scaled_rates(rows, sources, most)
    rows = join_same(rows, sources, ["source"])
    expected = F.least(F.lit(float(most)), F.col("_level") * F.col("_rate"))
    rows = rows.withColumn("expected", expected).withColumn("_whole", F.floor("expected").cast("bigint"))
    rows = settle(rows.withColumn("_part", F.col("expected") - F.col("_whole")).drop("_level", "_rate"))
    # words that whole copies leave to the sample, and the mean inclusion odds that even out the pieces of the order
    missing = rows.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("_whole") * F.col("size"))).alias("_missing"), F.avg("_part").alias("_mean"))
    number = (F.conv(F.substring("key", 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = number / (F.lit(1.0) - number) / (F.col("_part") / (F.lit(1.0) - F.col("_part")))
    drawn = join_same(rows.where("_part > 0").withColumn("_odds", odds), missing, ["source"])
    even = F.col("_odds") * (F.col("_mean") / (F.lit(1.0) - F.col("_mean")))
    # monotone in the odds: each step of this expression is
    place = F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + even)
    drawn = drawn.withColumn("_piece", F.floor(place * F.ceil(F.col("n_docs") / F.lit(ROWS))))
    drawn = running(drawn, ["source"], "_piece", ["_odds", "_id", "size"], {"_upto": ("sum", "size")})
    taken = F.col("_upto") - F.col("size") / F.lit(2) <= F.col("_missing")
    drawn = drawn.withColumn("copies", F.col("_whole") + taken.cast("bigint"))
    out = drawn.select(*rows.columns, "copies").unionByName(rows.where("_part <= 0").withColumn("copies", F.col("_whole")))
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "expected", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"), "key")


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of ``documents``, each as often as ``mixture`` says. Of rows equal in id and text one is repeated
    for all of them."""
    plan = mixture(documents, id_col=id_col, text_col=text_col, **options)
    copies = plan.groupBy(F.col("key").alias("_key")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    seed = options.get("seed", 0)
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                            F.coalesce(F.col(text_col), F.lit("")), F.lit("" if seed == 0 else f":{seed}")))
    rows = documents.withColumn("_key", digest).dropDuplicates(["_key"]).join(copies, "_key")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*documents.columns)

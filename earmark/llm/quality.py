"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are made once per document. Shallow trees on bootstrap samples of a bounded sample of labelled
rows give conjunctive rules, one per tree node. A lasso logistic regression keeps few of them. The kept rules become Spark
column expressions, so scoring is a projection over the statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from earmark.llm.store import settle
from earmark.llm.text import SPACE, Words, distinct_sets, pieces, window_shingles
from earmark.llm.toxicity import held_out, training_labels

#: Labelled rows that the model may look at, by the order of a hash.
EXAMPLES = 8000
TREES, DEPTH, SEED = 24, 3, 17
LASSO = .002

STATISTICS = ["log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "marked_words", "long_words",
              "title_words", "same_next", "distinct_words", "distinct_pairs", "distinct_fives", "top_word", "line_words",
              "repeated_lines", "bars", "ends", "letters_outside_ascii", "byte_entropy"]

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_OUTSIDE = np.arange(256) >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _OUTSIDE | SPACE)
_COMMON = np.zeros(256, bool)   # marks that prose has at the end of words
_COMMON[[ord(c) for c in ".,;:'\"-()!?"]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS per document; all 0 for a text without words."""
    rows = len(offsets) - 1
    words = Words(data, offsets)
    n = words.count.astype(float)
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def per_doc(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def words_with(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.bincount(words.doc, weights=(total[words.end] - total[words.start]) > 0, minlength=rows)

    letters = per_doc(_UPPER[data] | _LOWER[data])
    dark = np.maximum(size - per_doc(SPACE[data]), 1)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(words.doc, weights=length, minlength=rows) / some
    square = np.bincount(words.doc, weights=length * length, minlength=rows) / some
    odd = _SYMBOL & ~_COMMON
    same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])

    def distinct(width):
        hashes, at = window_shingles(words.hash, words.doc, words.count, words.first, width)
        sets, borders = distinct_sets(hashes, words.doc[at], rows)
        return np.diff(borders) / np.maximum(np.bincount(words.doc[at], minlength=rows), 1)

    pair = np.lexsort((words.hash, words.doc))
    cut = np.flatnonzero(np.append(True, (words.hash[pair][1:] != words.hash[pair][:-1])
                                   | (words.doc[pair][1:] != words.doc[pair][:-1]))) if len(pair) else pair
    top = np.zeros(rows)
    np.maximum.at(top, words.doc[pair][cut], np.diff(np.append(cut, len(pair))))

    # lines: runs of words between line breaks
    line = np.concatenate([[0], np.cumsum(data == 10)])[words.start]
    first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1]))) if len(line) else line
    line_doc = words.doc[first]
    lines = np.maximum(np.bincount(line_doc, minlength=rows), 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * np.uint64(0x9E3779B97F4A7C15)
                                                              ^ (words.hash >> np.uint64(29)))])
    line_hash = total[np.append(first[1:], len(line))] - total[first] if len(first) else np.zeros(0, np.uint64)
    _, borders = distinct_sets(line_hash, line_doc, rows)

    doc_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    share = np.bincount(doc_of_byte * 256 + data, minlength=rows * 256).reshape(rows, 256) / size[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    initial = _UPPER[data[words.start]] if len(words.start) else np.zeros(0, bool)
    closing = np.isin(data[words.end - 1], [33, 46, 63]) if len(words.end) else np.zeros(0, bool)

    out = np.stack([
        np.log1p(n), mean, np.sqrt(np.maximum(square - mean * mean, 0)), per_doc(_UPPER[data]) / np.maximum(letters, 1),
        per_doc(_DIGIT[data]) / dark, per_doc(_SYMBOL[data]) / dark, words_with(odd[data]) / some,
        np.bincount(words.doc, weights=length > 20, minlength=rows) / some,
        np.bincount(words.doc, weights=initial, minlength=rows) / some,
        np.bincount(words.doc[1:], weights=same, minlength=rows) / some if len(same) else np.zeros(rows),
        distinct(1), distinct(2), distinct(5), top / some, n / lines, 1 - np.diff(borders) / lines,
        per_doc(data == 124) / dark, np.bincount(words.doc, weights=closing, minlength=rows) / some,
        per_doc(_OUTSIDE[data]) / dark, entropy], axis=1)
    out[words.count == 0] = 0
    return out


def with_statistics(documents: DataFrame, passed: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``passed`` and one column per statistic of whole texts."""
    rows = documents.select(*passed, F.col(text_col).alias("_measured_text"))

    def run(batches):
        for batch, data, offsets in pieces(batches, "_measured_text"):
            values = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(passed))]
                                             + [pa.array(np.ascontiguousarray(v)) for v in values.T],
                                             names=[*passed, *(f"s_{s}" for s in STATISTICS)])

    schema = rows.drop("_measured_text").schema
    for s in STATISTICS:
        schema = schema.add(f"s_{s}", "double")
    return rows.mapInArrow(run, schema)


@dataclass
class Rules:
    """Rules as lists of ``(statistic, is at most, threshold)`` with their weights."""

    rules: list
    weights: list
    level: float

    def score(self) -> Column:
        total = F.lit(self.level)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def condition(rule) -> Column:
    out = F.lit(True)
    for statistic, at_most, threshold in rule:
        c = F.col(f"s_{statistic}")
        out = out & ((c <= threshold) if at_most else (c > threshold))
    return out


def tree_rules(description: str) -> list[tuple]:
    """Conjunctions along the paths to all nodes of the trees in a printed model."""
    rules, path = [], []
    for text in description.splitlines():
        found = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", text)
        if not found:
            if re.match(r"\s*Tree \d+", text):
                path = []
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (STATISTICS[int(found[3])], found[4] == "<=", float(found[5]))))
        rules.append(_simplified([p[1] for p in path]))
    return sorted(set(rules))


def _simplified(path) -> tuple:
    """Of several limits on one side of a statistic the tightest."""
    best: dict = {}
    for statistic, at_most, threshold in path:
        key = statistic, at_most
        best[key] = threshold if key not in best else (min if at_most else max)(best[key], threshold)
    return tuple(sorted((s, a, t) for (s, a), t in best.items()))


def fit(documents: DataFrame, labels: DataFrame) -> Rules:
    """Rules from ``documents`` (``id, text``) and ``labels`` (``id, y``). With one class only or none there are no rules
    and every score is that class's share, .5 without labels."""
    chosen = labels.orderBy(F.xxhash64("id", F.lit(43)), "id").limit(EXAMPLES)
    # at most EXAMPLES rows of two numbers, whatever the size of labels
    rows = documents.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    # one part in a fixed order: the bounded sample gives the same trees however the tables are cut
    examples = settle(with_statistics(rows, ["id", "y"]).repartition(1).sortWithinPartitions("id"))
    n, good = examples.agg(F.count(F.lit(1)), F.sum("y")).first()
    good = int(good or 0)
    if not 0 < good < n:
        share = (good + .5) / (n + 1)
        return Rules([], [], float(np.log(share / (1 - share))))
    names = [f"s_{s}" for s in STATISTICS]
    ready = VectorAssembler(inputCols=names, outputCol="v").transform(examples.withColumn("y", F.col("y").cast("double")))
    forest = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                    minInstancesPerNode=max(1, min(10, n // 50)), featureSubsetStrategy="onethird").fit(ready)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        share = (good + .5) / (n + 1)
        return Rules([], [], float(np.log(share / (1 - share))))
    flags = examples.select(F.col("y").cast("double").alias("y"),
                            *[condition(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="v").transform(flags).select("y", "v")
    model = LogisticRegression(featuresCol="v", labelCol="y", elasticNetParam=1.0, regParam=LASSO, maxIter=100,
                               standardization=False).fit(settle(flags))
    weights = model.coefficients.toArray().tolist()
    kept = [(r, w) for r, w in zip(rules, weights) if w != 0]
    return Rules([r for r, _ in kept], [w for _, w in kept], float(model.intercept))


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", threshold: float = .3) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` (score of ``threshold`` or more) of every row.

    A score depends on the text alone; NULL, empty and blank texts have statistics of 0 and are scored by the same rules.
    A NULL id is not held out; rows that share an id are scored each.
    """
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rules = fit(texts.where("id is not null"), training_labels(labels, label_col, id_col))
    scored = with_statistics(documents, [id_col], text_col).withColumn("score", rules.score())
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

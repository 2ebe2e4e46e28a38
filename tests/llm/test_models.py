"""Classifiers: exact neighbours, rules, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.llm import quality, toxicity
from earmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def accuracy(spark, query, label):
    rows = QUERIES[query](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    found = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    return sum(r.predicted == r[label] for r in held) / len(held)


def test_held_out_toxicity(spark):
    assert accuracy(spark, "op4_toxicity", "toxic") >= .95


def test_held_out_quality(spark):
    assert accuracy(spark, "op8_quality_rules", "quality") >= .97


def test_index_finds_exact_neighbours():
    rng = np.random.default_rng(1)
    examples, n_terms, k = 700, 60, 15
    rows = np.repeat(np.arange(examples), 6)
    terms = np.concatenate([rng.choice(n_terms, 6, replace=False) for _ in range(examples)])
    weights = toxicity.unit_vectors(rows, terms, rng.integers(1, 9, len(rows)), 1 + rng.random(n_terms))
    dense = np.zeros((examples, n_terms))
    dense[rows, terms] = weights
    index = toxicity.BlockMaxIndex(rows, terms, weights, examples, n_terms)
    for _ in range(60):
        own = np.sort(rng.choice(n_terms, rng.integers(1, 8), replace=False))
        weight = rng.random(len(own))
        score = np.round(dense[:, own] @ weight, 12)
        want = [i for i in np.lexsort((np.arange(examples), -score)) if score[i] > 0][:k]
        number, similarity = index.nearest(own, weight, k)
        assert np.allclose(similarity, score[want]) and np.allclose(score[number], score[want])
        clear = [i for i in want if (np.abs(score - score[i]) < 1e-9).sum() == 1]
        assert set(clear) <= set(number.tolist())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"plain words number {i} of the day", 0, 1) for i in range(40)]
    rows += [(100 + i, f"you utter zorgwad number {i} of the day", 1, 1) for i in range(20)]
    rows += [(200 + i, "### @@@ %%% $$$ ^^^ ~~~ ### @@@", 0, 0) for i in range(20)]
    docs = [(d, t, "s") for d, t, _, _ in rows] + [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (None, "zorgwad zorgwad", "s"),
                                                  (903, "zorgwad " * 4000, "s"), (0, rows[0][1], "s")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q, t) for d, _, t, q in rows] + [(None, 1, 1), (5000, 1, 1), (901, None, None), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return documents, labels


def test_toxicity_of_odd_rows(spark, odd):
    documents, labels = odd
    rows = toxicity.toxicity(documents, labels).collect()
    assert len(rows) == documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[None].predicted == 1 and by[None].held_out is False and by[903].predicted == 1
    assert by[105].predicted == 1 and by[7].predicted == 0 and by[900].score == by[901].score == by[902].score < .5
    assert len(by[105].neighbours) == len(by[105].similarities) > 0
    assert toxicity.toxicity(documents.where("false"), labels).count() == 0
    none = toxicity.toxicity(documents, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}


def test_scores_do_not_depend_on_held_out_labels(spark, odd):
    documents, labels = odd
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped = flipped.withColumn("quality", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    for fn in (toxicity.toxicity, quality.quality):
        a, b = (sorted((repr(r.doc_id), r.score) for r in fn(documents, x).collect()) for x in (labels, flipped))
        assert a == b


def test_quality_of_odd_rows(spark, odd):
    documents, labels = odd
    rows = quality.quality(documents, labels).collect()
    assert len(rows) == documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[5].predicted == 1 and by[205].predicted == 0
    assert by[900].score == by[901].score == by[902].score
    assert quality.quality(documents.where("false"), labels).count() == 0
    alone = {r.score for r in quality.quality(documents, labels.where("quality = 1")).collect()}
    assert len(alone) == 1 and alone.pop() > .9


def test_rules_of_a_printed_tree():
    text = """model
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= 0.25)
      Predict: 1.0
     Else (feature 1 > 0.25)
      Predict: 0.0
    Else (feature 0 > 1.5)
     Predict: 0.0"""
    a, b = quality.STATISTICS[:2]
    assert set(quality.tree_rules(text)) == {
        ((a, True, 1.5),), ((a, True, 1.5), (b, True, .25)), tuple(sorted([(a, True, 1.5), (b, False, .25)])), ((a, False, 1.5),)}


def test_statistics_of_known_texts():
    texts = [b"", b"The The The The", b"AB CD!! ef\nAB CD!! ef\n", b"a | b | c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = quality.statistics(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    at = {s: i for i, s in enumerate(quality.STATISTICS)}
    assert not got[0].any()
    assert got[1, at["same_next"]] == .75 and got[1, at["top_word"]] == 1 and got[1, at["distinct_words"]] == .25
    assert got[2, at["upper"]] == pytest.approx(8 / 12) and got[2, at["repeated_lines"]] == .5
    assert got[3, at["bars"]] == pytest.approx(2 / 5)

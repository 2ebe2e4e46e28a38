"""Mixing against brute force and its own promises."""

import math
import random

import pytest

from earmark.llm import mixing
from earmark.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


def water_level(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by raising the level source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    open_ = set(names)
    while open_ and left > 1e-9:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if target[s] + level * w[s] >= most * sizes[s] - 1e-12}
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        if not full:
            for s in open_:
                target[s] += level * w[s]
            left = 0
        open_ -= full
    return target


DOCS = [(i, " ".join("w" * (1 + i % 3) for _ in range((i * 7) % 23)), ["b", "a", None, "ç", "z"][i % 5 if i % 2 else 0], "x") for i in range(300)]
DOCS += [(1000, None, "a", "x"), (1001, "", "a", "x"), (None, "one two", "a", "x"), (7, DOCS[7][1], DOCS[7][2], "x"), (7, "other text here", "b", "x"),
         (2000, "", "void", "x"), (2001, None, "void", "x"), (3000, "long " * 50_000, "ç", "x")]
SCHEMA = "doc_id long, text string, source string, size string"      # ``size`` clashes with a result column


def test_mixture_keeps_its_targets(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(5)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == len(DOCS)
    sizes = {}
    for d in DOCS:
        sizes[d[2]] = sizes.get(d[2], 0) + len((d[1] or "").split())
    want = water_level(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and math.isclose(own[0].target, want[s], abs_tol=1e-6)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1e-6
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        assert math.floor(r.expected) <= r.copies <= math.ceil(r.expected)
    again = mixing.mixture(docs.repartition(2).orderBy("text")).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mixture(docs.where("false")).count() == 0


def test_pareto_order_by_hand(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    every = mixing.mixture(docs).collect()
    for source in {r.source for r in every if 0 < r.expected % 1 < 1 and r.source_size}:
        by_hand([r for r in every if r.source == source])


def by_hand(rows):
    part = rows[0].expected % 1
    missing = rows[0].target - sum(math.floor(r.expected) * r["size"] for r in rows)

    def rank(r):
        u = (int(r.key[:13], 16) + .5) / 2 ** 52
        return (u / (1 - u)) / (part / (1 - part)), (r.doc_id is not None, r.doc_id or 0), r["size"]

    upto = 0
    for r in sorted(rows, key=rank):
        upto += r["size"]
        assert r.copies == math.floor(r.expected) + (upto - r["size"] / 2 <= missing)


def test_unequal_rates(spark):
    rng = random.Random(3)
    data = [(i, "w " * rng.randint(20, 60), "s", rng.choice([.2, 1.0, 5.0, 400.0])) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, rate double")
    hits, n = {}, 6
    for seed in range(n):
        rows = mixing.mixture(docs, share=.6, rate="rate", seed=seed).collect()
        total = sum(r["size"] for r in rows)
        assert math.isclose(sum(r.expected * r["size"] for r in rows), .6 * total, rel_tol=1e-9)
        assert abs(sum(r.taken for r in rows) - .6 * total) <= 30
        for r in rows:
            hits.setdefault(round(r.expected, 9), []).append(r.copies)
    assert len(hits) == 4 and max(hits) == 2.0
    for p, copies in hits.items():
        assert abs(sum(copies) / len(copies) - p) < 4 * math.sqrt(.25 / len(copies)) + .02


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_matches_sql(spark, sf):
    name, sf = "op11_source_mixing", f"/root/testdata/sf{sf}"
    ok, note = compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name])
    assert ok, note

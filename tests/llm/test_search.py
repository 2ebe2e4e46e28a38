"""Vector search and benchmark windows against brute force."""

import random
from collections import Counter

import numpy as np

from earmark.llm import decontaminate, vectors
from earmark.llm.queries import QUERIES


def brute_top(ids, x, i, k):
    score = (x * x[i]).sum(1)
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


def test_recall_on_driver_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in QUERIES["op6_kmeans_tree_search"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        own = sorted(got[ids[i]])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(s - (x[v] * x[i]).sum()) < 1e-12 for _, v, s in own)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        want = {v for v, _ in brute_top(ids, x, i, 20)}
        hits, total = hits + len(want & {v for _, v, _ in own}), total + 20
    assert hits / total >= .9


def test_vectors_that_take_no_part_and_ties(spark):
    rows = [(i, [1.0, float(i % 3), 0.0], 1) for i in range(12)] + [(20 + i, [1.0, 1.0, 0.0], 1) for i in range(9)]
    odd = [(40, None, 1), (41, [0.0, 0.0, 0.0], 1), (42, [1.0, None, 2.0], 1), (43, [float("nan"), 1.0, 1.0], 1),
           (44, [float("inf"), 1.0, 1.0], 1), (45, [1.0, 2.0], 1), (None, [1.0, 1.0, 1.0], 1), (46, [], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, leaf int")
    for k in (5, 50):
        got = {}
        for r in vectors.nearest(table, k=k, recall=1.0).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        assert set(got) == set(ids.tolist())
        for i in range(len(ids)):
            assert [(v, s) for _, v, s in sorted(got[int(ids[i])])] == brute_top(ids, x, i, k)
    assert vectors.nearest(table.where("false")).count() == 0
    assert vectors.nearest(table.where("vec_id = 3")).count() == 0


def test_hot_leaf_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "VISITS", 8)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.tile([[.6, .8, .1, .2]], (150, 1)), rng.normal(size=(150, 4))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(table, table.where("vec_id % 20 = 0"), k=7, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(got[0])] == [v for v, _ in brute_top(np.arange(300), x, 0, 7)] and len(got) == 15


def brute_windows(doc, item):
    def shingles(w):
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    words, wanted = doc.lower().split(), item.lower().split()
    own, target = shingles(words), Counter(shingles(wanted))
    if not own or not target:
        return None
    span, total, best = max(1, min(len(wanted), len(words)) - 4), sum(target.values()), None
    for p in range(len(own) - span + 1):
        common = sum((Counter(own[p:p + span]) & target).values())
        value = common / (span + total - common)
        if value >= .8 and (best is None or value > best[0]):
            best = value, p
    return best


def test_windows_match_brute_force(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((3, 5, 12, 30, 44))))) for i in range(14)]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            own = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "changed"
            text[rng.randint(0, len(text)):0] = own
        elif d % 3 == 1:                                     # copies of long items that stay similar: edits at their ends
            own = rng.choice([t for _, t in items if len(t.split()) >= 30]).split()
            own[rng.choice([0, -1])] = rng.choice(["changed", own[0]])
            text[rng.randint(0, len(text)):0] = own
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (None, items[3][1]), (0, docs[0][1])]
    documents = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, similarity double")
    benchmark = spark.createDataFrame(items + [(50, None), (51, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in
                  decontaminate.contaminated(documents, benchmark).collect()), key=repr)
    want = [(d, i, round(b[0], 9), b[1]) for d, t in docs for i, s in items if t and (b := brute_windows(t, s))]
    assert got == sorted(want, key=repr) and len(want) > 15
    clean = decontaminate.without_benchmark(documents, benchmark)
    assert clean.columns == documents.columns
    hit = {(d, t) for d, t in docs if t and any(brute_windows(t, s) for _, s in items)}
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(
        ((d, t) for d, t in docs if (d, t) not in hit), key=repr)
    assert decontaminate.contaminated(documents, benchmark.where("false")).count() == 0
    assert decontaminate.contaminated(documents.where("false"), benchmark).count() == 0


def test_multi_index_finds_all_prints_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    query = []
    for p in prints[:20].tolist():
        for bits in (0, 5, decontaminate.RADIUS, decontaminate.RADIUS + 1):
            for b in rng.choice(64, bits, replace=False).tolist():
                p ^= 1 << b
            query.append(p)
    query = np.array(query, np.uint64)
    q, item, distance = decontaminate.HammingIndex(prints).near(query)
    all_pairs = np.bitwise_count(query[:, None] ^ prints[None, :])
    assert set(zip(q.tolist(), item.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(all_pairs <= decontaminate.RADIUS))))
    assert (distance == all_pairs[q, item]).all()


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items.limit(6)).collect()}
    monkeypatch.undo()
    assert got == {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items.limit(6)).collect()}

"""Components of near duplicates against brute force, and the parts they are made of."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from earmark.llm import buckets, near_dups
from earmark.llm.graph import connected_components
from earmark.llm.text import SPACE, Words


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) >= n:
        return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
    return {tuple(words)} if words else set()


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, n, percent):
    ids = sorted({d for d, _ in rows if d is not None})
    own = [(d, shingle_set(t, n)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, s) in enumerate(own) for b, t in own[:i]
             if s and t and a != b and 100 * len(s & t) >= percent * len(s | t)]
    return union_find(ids, links)


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10 ** 6)}"
    return " ".join(out)


def small_corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for size, copies, edits in ((120, 40, 3), (60, 12, 1), (30, 6, 0), (200, 25, 6)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            rows.append((at, edited(rng, base, rng.randint(0, edits))))
            at += 1
    rows += [(at + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50)))) for i in range(40)]
    rng.shuffle(rows)
    odd = [None, "", " \t\n", "one", "ONE", "two words", "two  words ", "a b c d", "a b c d e", "Ünïcode ÜNÏCODE x y z"]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, rows[0][1]), rows[1], (7, "quite another text of seven")]


def check(got, rows, n, percent):
    want = brute(rows, n, percent)
    assert len(got) == len(rows)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(t, n)) for _, t in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is False
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r


def test_components_match_brute_force(spark):
    rows = small_corpus()
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, rep string, hub int")
    check(near_dups.near_duplicates(docs, shingle=4).collect(), rows, 4, 80)
    assert near_dups.near_duplicates(docs.where("false")).count() == 0


def test_rounds_and_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK", 6)        # groups of copies need rounds and several blocks
    monkeypatch.setattr(buckets, "MANY", 8)
    monkeypatch.setattr(buckets, "COLUMNS", 64)
    rows = [r for r in small_corpus() if r[0] is None or r[0] < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_dups.near_duplicates(docs, shingle=5).collect(), rows, 5, 80)


def test_query_on_small_tables(spark):
    from earmark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op3_minhash_near_dedup"](spark, sf).collect(), rows, 4, 80)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 301), (301, 300), (5, 5), (None, 4)]
    links += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    rng.shuffle(links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == union_find({x for p in real for x in p}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(2)
    for common in (0, 300, 800, 1000):
        a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 1 << 62, 1000 - common).astype(np.uint64)])
        x, y = (near_dups.pack_bits(near_dups.minima(v, np.array([0])))[0].view(np.int64).tolist() for v in (a, b))
        got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(near_dups.estimate("x", "y")).first()[0]
        assert abs(got - common / (2000 - common)) < .15


def test_block_links_join_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 40)
    sets = [np.unique(np.concatenate([base[:36], rng.integers(0, 1 << 60, 3)])) for _ in range(20)]
    sets += [np.unique(rng.integers(0, 1 << 60, 30)) for _ in range(20)]
    table = pa.table({"rep": np.arange(40), "component": np.arange(40), "block": np.zeros(40, int),
                      "set": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    a, b = buckets.block_links(table, 0, 0, 80)
    want = [(i, j) for j in range(40) for i in range(j)
            if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
    assert union_find(range(40), list(zip(a, b))) == union_find(range(40), want)


@pytest.mark.parametrize("text", ["", "a", "  a  b ", "a\x0bb\x0cc\r\nd", "é\xa0ü x"])
def test_words(text):
    raw = text.encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACE)
    assert [raw[a:b] for a, b in zip(words.start, words.end)] == raw.split()

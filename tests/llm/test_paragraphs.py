"""Substring dedup on planted passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.llm import paragraphs

RNG = random.Random(8)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ner", "sut", "vo") for b in ("ba", "den", "fir", "gol", "hus", "jem", "q", "tra")]


def prose(n):
    return " ".join(RNG.choice(WORDS) + ("." if RNG.random() < .08 else "") for _ in range(n))


PASSAGE, OTHER = prose(80), prose(64)
CLEAN = [prose(90) for _ in range(6)]
DOCS = [
    (1, prose(40) + " " + PASSAGE + " " + prose(30)),
    (2, PASSAGE + "\n" + prose(25)),
    (3, prose(25) + "\n" + prose(5) + " " + PASSAGE + "\n" + prose(20)),
    (4, prose(30) + " " + OTHER.upper()),
    (5, OTHER + " " + prose(30)),
    *[(10 + i, t) for i, t in enumerate(CLEAN)],
    (20, None), (21, ""), (22, "  \n "), (23, "short"), (None, PASSAGE),
    (30, CLEAN[0]), (30, CLEAN[0]),                    # a repeated row, and a copy of document 10
    (31, "The same line here.\n" + prose(40)), (32, "The same line here.\n" + prose(40)),
    (3, prose(35)),                                    # another text under id 3
]


def table(spark):
    return spark.createDataFrame([(d, t, 0, "c") for d, t in DOCS], "doc_id long, text string, run int, component string")


def test_planted_passages_are_found(spark):
    rows = paragraphs.repeated_paragraphs(table(spark)).collect()
    words = {}
    for r in rows:
        words[r.doc_id, r.kept_id] = words.get((r.doc_id, r.kept_id), 0) + r.n_words
        text = [t for d, t in DOCS if d == r.doc_id]
        assert any(t and 0 <= r.start < r.end <= len(t) for t in text)
    assert {d for d, _ in words} == {2, 3, 5, 30}
    assert all(words[pair] >= 40 for pair in ((2, 1), (3, 1), (5, 4), (30, 10)))
    assert set(words) <= {(2, 1), (3, 1), (3, 2), (5, 4), (30, 10)}     # the last words of a line in both 2 and 3


def test_text_without_repeats(spark):
    docs = table(spark)
    out = paragraphs.without_repeats(docs)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    texts = dict(left)
    middle = " ".join(PASSAGE.split()[15:65])
    assert middle in texts[1] and middle not in texts[2] and all(middle not in t for d, t in left if d == 3)
    assert all(len(t.split()) < 16 for d, t in left if d == 30)     # of the copy a short rest at most
    for d, t in DOCS:
        if d in (1, 4, *range(10, 16), 20, 21, 22, 23, 31, 32, None):
            assert (d, t) in left
    assert any(d == 3 and t == DOCS[-1][1] for d, t in left)
    assert paragraphs.without_repeats(docs.where("false")).count() == 0


def test_near_copies_of_a_paragraph(spark):
    line = prose(60)
    changed = line.split()
    changed[-1] = "altered"
    rows = paragraphs.repeated_paragraphs(spark.createDataFrame(
        [(1, line), (2, " ".join(changed) + " and"), (3, prose(60))], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept_id) for r in rows} == {(2, 1)}


def test_passages_in_short_lines(spark):
    docs = []
    for k in (5, 6, 7):
        passage = prose(60).split()
        verse = "\n".join(" ".join(passage[i:i + k]) for i in range(0, 60, k))
        docs += [(10 * k + 1, prose(30) + "\n" + verse + "\n" + prose(30)), (10 * k + 2, verse),
                 (10 * k + 3, prose(20) + "\n\n" + verse + "\n" + prose(25)),
                 (10 * k + 4, "A list\n" + verse.replace("\n", "\n\n") + "\nof lines\n" + prose(20)),
                 (10 * k + 5, "one\ntwo\n\nthree words here")]
    words = {}
    for r in paragraphs.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.kept_id < r.doc_id
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    assert set(words) == {10 * k + i for k in (5, 6, 7) for i in (2, 3, 4)}
    assert all(words[10 * k + 2] == words[10 * k + 3] == 60 and words[10 * k + 4] >= 30 for k in (5, 6, 7))


def test_edited_lines_go_whole(spark):
    docs = []
    for i in range(40):
        n, at = ((24, 23), (30, 29), (50, 25), (60, 30))[i % 4]
        line = prose(n)
        changed = line.split()
        changed[at] = f"edited{i}"
        docs += [(2 * i, line + "\n" + prose(20)), (2 * i + 1, prose(20) + "\n" + " ".join(changed))]
    # an edited line goes, so its own words are kept by a later document that repeats them
    line = prose(80).split()
    docs += [(100, " ".join(line)), (101, " ".join(line[:40] + ["edited"] + line[41:])),
             (102, prose(30) + " " + " ".join(line[20:40] + ["edited"] + line[41:60]) + " " + prose(30))]
    words, spans = {}, []
    for r in paragraphs.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.kept_id < r.doc_id
        words[r.doc_id, r.kept_id] = words.get((r.doc_id, r.kept_id), 0) + r.n_words
        spans += [(r.start, r.end)] if r.doc_id == 102 else []
    whole = [words.get((2 * i + 1, 2 * i)) == (24, 30, 50, 60)[i % 4] for i in range(40)]
    assert sum(whole) >= 38
    at = docs[-1][1].index("edited")
    assert words[101, 100] == 80 and all(not start <= at < end for start, end in spans)


def test_band_tuning():
    bands, rows = paragraphs.tune_bands(.8, .99)
    assert 1 - (1 - .8 ** rows) ** bands >= .99 and bands <= 5
    assert rows >= 8 or 1 - (1 - .8 ** (rows + 1)) ** 5 < .99


def test_removed_spans_keep_lines():
    assert paragraphs.remove_spans("one two\nthree four", [(4, 8)]) == "one \nthree four"
    assert paragraphs.remove_spans("a\nb\nc", [(2, 4)]) == "a\nc"
    assert paragraphs.remove_spans("abc", []) == "abc"


def test_pairs_of_small_buckets(spark):
    """Components are the same whether buckets meet in pairs, through hubs, or partly so, and equal brute force."""
    from earmark.llm.buckets import link_classes

    rng = random.Random(3)
    base = [set(rng.sample(range(400), 20)) for _ in range(12)]
    sets = {}
    for i in range(120):
        own = set(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            own.discard(rng.choice(sorted(own)))
            own.add(rng.randint(0, 400))
        sets[i + 1] = sorted(own)
    rows = [(i, [1000 + (i - 1) % 12, 5000 + (i - 1) % 6], len(s)) for i, s in sets.items()]
    classes = spark.createDataFrame(rows, "rep long, bands array<long>, n int")
    table = spark.createDataFrame(list(sets.items()), "id long, set array<long>")

    def may_link(p, q):
        return F.least(p("n"), q("n")) * 100 >= F.greatest(p("n"), q("n")) * 80

    got = [sorted(tuple(r) for r in link_classes(classes, lambda ids: table.join(ids, "id", "left_semi"), 80, may_link,
                                                 few=few).collect()) for few in (1, 12)]
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(set(sets[a]) & set(sets[b]))
            if a < b and both * 100 >= 80 * (len(set(sets[a]) | set(sets[b]))):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    groups = {}
    for i in sets:
        groups.setdefault(root(i), []).append(i)
    want = sorted((i, r) for r, members in groups.items() if len(members) > 1 for i in members)
    assert got[0] == got[1] == want and len(groups) > 12


@pytest.mark.parametrize("bands, rows", [(10, 4), (3, 7), (1, 2)])
def test_keys_and_minima_share_words(spark, bands, rows):
    """No field of a paragraph loses or lends a bit, and no word of 64 bits is left half empty."""
    fields, rng = paragraphs._fields(bands, rows), np.random.default_rng(3)
    values = {f: rng.integers(0, 1 << 64, 50, np.uint64) for f in fields}
    words = paragraphs._pack(values, fields)
    assert len(words) == -(-(2 * bands * rows + paragraphs.KEY_BITS * bands) // 64)
    table = spark.createDataFrame(list(zip(*(w.view(np.int64).tolist() for w in words))), ", ".join(f"w{i} long" for i in range(len(words))))
    got = table.select(*paragraphs._unpack(fields)).toPandas()
    for f, bits in fields.items():
        band = int(f[1:]) << paragraphs.KEY_BITS if f[0] == "b" else 0
        want = (values[f] & np.uint64((1 << bits) - 1)).view(np.int64) | band
        assert got[f].tolist() == want.tolist()


def test_entries_of_buckets_are_shuffled_once(spark, monkeypatch):
    """Bucket sizes are counted where the entries lie: one exchange by key, read again for the join, also without broadcasts."""
    from earmark.llm import buckets

    tables = []
    monkeypatch.setattr(buckets, "settle", lambda df: tables.append(df) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classes = spark.range(2000).selectExpr("id as rep", "id div 3 as b0", "id * 7 as b1", "id as s0")
        rows = buckets._shared(classes, ["b0", "b1"]).collect()
        assert len(rows) == 2000 and {r["members"] for r in rows} == {2, 3}
        assert set(rows[0].asDict()) == {"key", "rep", "hub", "members"}         # what links are told by does not travel
        for df in tables:
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
            assert sorted("ReusedExchange" in x for x in dealt) == [False, True], plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_between_steps_go(spark):
    """Only what the result is read from is left in the shared folder."""
    import os

    from earmark.scale import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = paragraphs.without_repeats(spark.createDataFrame(DOCS, "doc_id long, text string"))
    n = out.count()
    assert 0 < n < len(DOCS) and len(set(os.listdir(folder)) - before) <= 8

"""Repairs against a search over all edits, whole and cut into small pieces."""

import hashlib
import heapq
import random

import pytest

from earmark.llm import conversations as conv
from earmark.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

STEP = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}


def brute(rows):
    """Cheapest edits of ``(turn, role, text)`` rows, by best-first search; ties by the letters."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        kinds.append(3 if not bare else 2 if (role, text) in seen else 1 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    heap, best = [(0, "", 0, "0", ())], {}
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in "03":
            break
        if (i, state) in best and best[i, state] <= (cost, audit):
            continue
        best[i, state] = (cost, audit)
        role, name = ("a", "assistant") if state == "2" else ("u", "user")
        heapq.heappush(heap, (cost + 2, audit + "I", i, STEP[state, role], out + (f"{name}:",)))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if kinds[i] < 2:
                if (state, own[:1]) in STEP:
                    heapq.heappush(heap, (cost + kinds[i], audit + "K", i + 1, STEP[state, own[:1]], out + (f"{own}:{text}",)))
                heapq.heappush(heap, (cost + 2 + kinds[i], audit + "R", i + 1, STEP[state, role], out + (f"{name}:{text}",)))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, kinds.count(3), kinds.count(2), kinds.count(1), illegal, cost, audit, digest), out


def made(seed, n_convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        c = None if c == 4 else c
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice([None, "", " \n", "Fine.", "Cut off", "Why?", f"Own text {rng.random()}.", "é…", "Yes! "])
            rows.append((c, rng.choice([t, t, t, None, t // 2]), role, text))
            if rng.random() < .2:
                rows += [rows[-1]] * rng.randint(1, 3)
    return rows


def check(spark, rows, partitions):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string").repartition(partitions)
    repair = conv.Repair(df)
    report = {r.conv_id: tuple(r)[1:] for r in repair.report().collect()}
    lines = {}
    for r in sorted(repair.lines().collect(), key=lambda r: r.line):
        assert r.line == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert set(report) == set(groups)
    for c, own in groups.items():
        want, out = brute(own)
        assert report[c] == want, (c, own)
        assert tuple(lines.get(c, [])) == out


def test_repairs_match_search(spark):
    check(spark, made(1, 300, 12), 4)


def test_pieces_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(conv, "PIECE_ROWS", 5)
    rows = made(2, 12, 60)
    cutter = conv.Cutter()
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"conv": [1] * 12 + [2], "turn": list(range(13)), "role": ["user"] * 13, "text": ["t."] * 13})
    found, cut, open_ = cutter.add(batch)
    assert found.num_rows == 12 and cut.tolist() == [0, 5, 10] and open_.all() and cutter.held.num_rows == 1
    # the constant travels to the workers with the functions only where they are pickled by value: cut small by long texts instead
    long = [(c, t, r, None if x is None else x + "!" * 600_000) if i % 2 else (c, t, r, x) for i, (c, t, r, x) in enumerate(rows[:60])]
    check(spark, long, 3)


def test_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"{t}."])) for t in range(9000)]
    check(spark, rows + [(2, 0, "user", "x.")], 3)


def test_block_tables_equal_single_steps():
    t = conv.tables()
    rng = random.Random(0)
    for _ in range(500):
        v, block = rng.randrange(len(t.vectors)), [rng.randrange(9) for _ in range(conv.BLOCK)]
        code, at = 0, v
        for s in block:
            code, at = code * 9 + s, t.step[at, s]
        assert t.block[v, code] == at
    assert (t.step[:, conv.GONE] == range(len(t.vectors))).all()


def test_damage_and_empty_tables(spark):
    import zlib
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in (("assistant", "Hm. Ok? No! and"), (None, None))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, code long")
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            row = (c, t, "user" if code == 4 else role, "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text)
            want += [row] * (2 if code == 3 else 1)
    assert sorted(map(tuple, conv.damaged(df).collect()), key=repr) == sorted(want, key=repr)
    empty = conv.audited(df, conv.damaged(df).where("false")).collect()
    assert {tuple(r) for r in empty} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2, None)}
    assert conv.audited(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_matches_sql(spark, sf):
    name, sf = "op12_conversation_repair", f"/root/testdata/sf{sf}"
    ok, note = compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name])
    assert ok, note

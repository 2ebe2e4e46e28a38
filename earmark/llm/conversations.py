"""Cheapest repair of the role structure of conversations, with Four-Russians block tables.

A repaired conversation reads ``(s?(ua)+)?`` in initials of its roles. Edits turn rows into such a conversation: Keep costs 0,
Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant row 2; a row whose text is cut off costs 1 more
unless it is deleted; blank and repeated rows must go. The cost of reaching each of the four states of the pattern after a row
is a vector; less its minimum, and without entries no cheapest repair can use, few vectors exist. Their transitions are computed
once for every block of ``BLOCK`` symbols, so a conversation is read a block a lookup. Going back, blocks are expanded to rows
and all states on any cheapest repair are kept, so that the trace from the front can take the smallest letter at every tie.

Rows of a conversation are one range of a sorted table, cut into pieces of bounded size. Conversations that lie in one piece
are solved there. Others carry small summaries from piece to piece: where each vector leads, then which states stay on a
cheapest repair, then the state in which a piece is entered. No task holds more than a piece's texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.llm.store import settle
from earmark.scale import join_same

BLOCK = 4
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States are start, after system, after user, after assistant; role classes are s, u, a and others.
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
ENDS = (0, 3)
GONE = 8              # symbol of a row that must go; others are 2 * class + truncated
FAR = 1 << 20
SLACK = 7             # from any state, whatever another allows costs at most 7 more: a larger lead is never made good
SPACES = " \t\n\x0b\f\r"


def _wanted(state: int) -> int:
    """Role class that an inserted or rewritten row takes: assistant after user, else user."""
    return 2 if state == 2 else 1


def _closed(costs) -> list[int]:
    """Costs with insertions allowed."""
    out = list(costs)
    for _ in range(3):
        for q in range(4):
            to = NEXT[q, _wanted(q)]
            out[to] = min(out[to], out[q] + INSERT)
    return out


def _edges(state: int, symbol: int):
    """``(letter, next state, cost)`` of the edits of a row in a state."""
    yield "D", state, DELETE
    if symbol != GONE:
        role, cut = divmod(symbol, 2)
        if (state, role) in NEXT:
            yield "K", NEXT[state, role], KEEP + cut
        yield "R", NEXT[state, _wanted(state)], REROLE + cut


class Tables:
    """Vectors, their transitions for one symbol and for a block, and the steps back and forward through one symbol."""

    def __init__(self):
        start = self._normal(_closed([0, FAR, FAR, FAR]))[0]
        ids, todo, step, rise = {start: 0}, [start], [], []
        for vector in todo:
            step.append([])
            rise.append([])
            for symbol in range(9):
                costs = [FAR] * 4
                for q in range(4):
                    for _, to, cost in _edges(q, symbol):
                        costs[to] = min(costs[to], vector[q] + cost)
                after, up = self._normal(_closed(costs))
                if after not in ids:
                    ids[after] = len(todo)
                    todo.append(after)
                step[-1].append(ids[after])
                rise[-1].append(up)
        self.vectors, self.step, self.rise = todo, np.array(step, np.int16), np.array(rise, np.int64)
        # a block of symbols is a number in base 9; one more symbol at a time
        self.block = np.arange(len(todo), dtype=np.int16)[:, None]
        for _ in range(BLOCK):
            self.block = self.step[self.block].reshape(len(todo), -1)
        self.back = np.zeros((len(todo), 9, 16), np.uint8)
        self.next = np.zeros((len(todo), 9, 16, 4), np.uint8)
        self.letter = np.zeros((len(todo), 9, 16, 4), np.uint8)
        self.inserts = np.zeros((len(todo), 9, 16, 4), np.uint8)
        for v, vector in enumerate(todo):
            for symbol in range(9):
                after = [c + self.rise[v, symbol] for c in todo[self.step[v, symbol]]]
                for live in range(16):
                    self._trace(v, symbol, live, vector, after)
        self.end_live = np.zeros(len(todo), np.uint8)
        self.end_inserts = np.zeros((len(todo), 4), np.uint8)
        for v, vector in enumerate(todo):
            least = min(vector[q] for q in ENDS)
            goals = {q for q in ENDS if vector[q] == least}
            live = self._live(vector, goals)
            self.end_live[v] = sum(1 << q for q in live)
            for q in live:
                n, at = 0, q
                while at not in goals:
                    n, at = n + 1, NEXT[at, _wanted(at)]
                self.end_inserts[v, q] = n

    @staticmethod
    def _normal(costs):
        least = min(costs)
        return tuple(c - least if c - least <= SLACK else FAR for c in costs), least

    @staticmethod
    def _live(vector, good: set) -> set:
        """States from which insertions lead to ``good`` ones without raising the cost."""
        live = set(good)
        for _ in range(3):
            live |= {q for q in range(4) if (to := NEXT[q, _wanted(q)]) in live and vector[q] < FAR and vector[q] + INSERT == vector[to]}
        return live

    def _trace(self, v, symbol, live, vector, after):
        kept = {q: [(letter, to) for letter, to, cost in _edges(q, symbol)
                    if live >> to & 1 and vector[q] < FAR and vector[q] + cost == after[to]] for q in range(4)}
        states = self._live(vector, {q for q in range(4) if kept[q]})
        self.back[v, symbol, live] = sum(1 << q for q in states)
        for q in states:
            at, n = q, 0
            while True:                                          # D, I, K, R: the smallest letter at every step
                row = min(kept[at], default=None)
                ahead = NEXT[at, _wanted(at)]
                insert = ahead in states and vector[at] + INSERT == vector[ahead]
                if row and not (insert and row[0] > "I"):
                    break
                at, n = ahead, n + 1
            self.letter[v, symbol, live, q], self.next[v, symbol, live, q] = ord(row[0]), row[1]
            self.inserts[v, symbol, live, q] = n


@lru_cache
def tables() -> Tables:
    return Tables()


def padded(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of equal length, a multiple of ``BLOCK``. Rows that must go leave every vector as it is, so they fill up."""
    sizes = np.diff(offsets)
    width = -(-int(sizes.max(initial=0)) // BLOCK) * BLOCK
    out = np.full((len(sizes), width), GONE, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(symbols)) - offsets[row]] = symbols
    return out


def borders(lanes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Vector at every block border of every lane, by block lookups."""
    t = tables()
    codes = lanes.reshape(len(lanes), -1, BLOCK) @ (9 ** np.arange(BLOCK - 1, -1, -1))
    out = np.empty((len(lanes), codes.shape[1] + 1), np.int16)
    out[:, 0] = start
    for b in range(codes.shape[1]):
        out[:, b + 1] = t.block[out[:, b], codes[:, b]]
    return out


def backward(lanes: np.ndarray, at: np.ndarray, live: np.ndarray):
    """Vector before every row and states on a cheapest repair after every row; blocks are expanded from the last to the first."""
    t = tables()
    vectors = np.empty(lanes.shape, np.int16)
    after = np.empty(lanes.shape, np.uint8)
    for b in range(at.shape[1] - 2, -1, -1):
        v = at[:, b]
        for i in range(b * BLOCK, (b + 1) * BLOCK):
            vectors[:, i] = v
            v = t.step[v, lanes[:, i]]
        for i in range((b + 1) * BLOCK - 1, b * BLOCK - 1, -1):
            after[:, i] = live
            live = t.back[vectors[:, i], lanes[:, i], live]
    return vectors, after, live


def forward(lanes, vectors, after, state):
    """Letter, insertions before it and state before them for every row, and the last state."""
    t = tables()
    letters, inserts, states = (np.empty(lanes.shape, np.uint8) for _ in range(3))
    for i in range(lanes.shape[1]):
        key = vectors[:, i], lanes[:, i], after[:, i], state
        letters[:, i], inserts[:, i], states[:, i] = t.letter[key], t.inserts[key], state
        state = t.next[key]
    return letters, inserts, states, state


def _by_width(offsets: np.ndarray):
    """Lanes of like length, so that filling up at most doubles them, and not too many symbols at once."""
    sizes = np.diff(offsets)
    classes = np.frexp(np.maximum(-(-sizes // BLOCK), 1) - .5)[1]
    for c in np.unique(classes):
        rows = np.flatnonzero(classes == c)
        some = max(1, (1 << 20) // (BLOCK << int(c)))
        for a in range(0, len(rows), some):
            yield rows[a:a + some]


def _some(symbols, offsets, rows):
    sizes = np.diff(offsets)[rows]
    own = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(offsets[rows] - own[:-1], sizes) + np.arange(own[-1])
    return padded(symbols[take], own)


# ---------------------------------------------------------------- rows to pieces

_COLUMNS = ["conv", "turn", "role", "text", "kind", "copies"]
_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role int, last_role int, low bigint, high bigint, turns bigint"
_SOLVED = "audit string, cost bigint, lines array<struct<role:string,text:string>>"
_ROWS = "symbols array<int>, copies array<bigint>, roles array<string>, texts array<string>"


def faults(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Rows as ``conv, turn, role, text, kind, copies``: equal rows once with their number, ``kind`` 0 sound, 1 truncated,
    2 repeated (role and text stand in an earlier row), 3 blank. NULL roles and texts count as one space."""
    rows = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                                F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("_row", F.sha2(F.to_json(F.struct("conv", "turn", "role", "text")), 256))
    earliest = rows.groupBy(F.sha2(F.to_json(F.struct("conv", "role", "text")), 256).alias("_text")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("late"), "turn", "_row")).alias("_e"))
    earliest = earliest.select(F.col("_e._row").alias("_row"), F.lit(True).alias("_early"))
    once = rows.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("conv", "turn", "role", "text")],
                                    F.count(F.lit(1)).alias("copies"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    kind = (F.when(last == "", 3).when(F.col("_early").isNull(), 2).when(~last.isin(".", "!", "?"), 1).otherwise(0))
    return once.join(earliest, "_row", "left").select("conv", "turn", "role", "text", kind.cast("tinyint").alias("kind"), "copies")


class Cutter:
    """Cuts sorted rows of a partition into pieces of one conversation each, of ``PIECE_ROWS`` rows and about ``PIECE_BYTES``.

    A piece is ``open`` unless it holds a whole conversation for certain: another one begins before and after it here.
    """

    def __init__(self):
        self.held, self.clean, self.last, self.any = None, False, None, False

    def add(self, batch):
        """``(rows, first row of every piece, open)`` of what is complete after ``batch``; None: the partition ends."""
        if batch is None:
            held, self.held = self.held, None
            return None if held is None else (held, np.zeros(1, np.int64), np.ones(1, bool))
        if self.held is not None:
            batch = pa.concat_batches([self.held, batch])
        else:
            self.clean = self.any and batch.column(0)[0].as_py() != self.last
        n, conv = batch.num_rows, batch.column(0)
        self.any, self.last = True, conv[n - 1].as_py()
        key = pc.fill_null(pc.dictionary_encode(conv).indices, -1).to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size) - size
        level = (np.arange(n) - start[run]) // PIECE_ROWS + (upto - upto[start[run]]) // PIECE_BYTES
        cut = np.flatnonzero(new | np.concatenate([[True], level[1:] != level[:-1]]))
        of = run[cut]
        closed = (np.bincount(of)[of] == 1) & (of < run[-1])
        if not self.clean:
            closed &= of > 0
        tail = int(cut[-1])
        one = int((of == run[-1]).sum()) == 1
        self.held = None
        if n - tail < PIECE_ROWS and size[tail:].sum() < PIECE_BYTES:
            self.held, cut, closed = batch.slice(tail), cut[:-1], closed[:-1]
            self.clean = one and (run[-1] > 0 or self.clean)
            batch = batch.slice(0, tail)
        return (batch, cut, ~closed) if len(cut) else None


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _counts(batch, cut):
    """Faults and turns of every piece, and the symbols of its rows."""
    role = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(batch.column(2), 0, 1), pa.array(["s", "u", "a"])), 3)
    role = role.to_numpy(zero_copy_only=False).astype(np.int64)
    kind = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
    copies = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
    known = pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
    turn = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False)
    head = np.zeros(len(role), bool)
    head[cut] = True
    before = np.concatenate([[3], role[:-1]])
    good = ((before == 0) | (before == 2)) & (role == 1) | (before == 1) & (role == 2)
    ends = np.append(cut[1:], len(role)) - 1
    big = np.iinfo(np.int64).max
    fresh = known & (head | ~np.concatenate([[False], known[:-1]]) | (turn != np.concatenate([[0], turn[:-1]])))

    def add(x):
        return pa.array(np.add.reduceat(x.astype(np.int64), cut))

    some = np.logical_or.reduceat(known, cut)
    low = np.minimum.reduceat(np.where(known, turn, big), cut)
    high = np.maximum.reduceat(np.where(known, turn, -big), cut)
    counts = [add(np.where(kind == 3, copies, 0)), add(np.where(kind == 3, 0, copies - 1 + (kind == 2))), add(kind == 1),
              add(copies - 1 + (~head & ~good)), pa.array(role[cut].astype(np.int32)), pa.array(role[ends].astype(np.int32)),
              pa.array(low, mask=~some), pa.array(high, mask=~some), add(fresh)]
    return counts, np.where(kind >= 2, GONE, 2 * role + (kind == 1)), copies


def _solve(symbols, offsets, copies, roles, texts, start, live, state, final):
    """``audit, cost, lines`` of pieces: entered with a vector and a state, left with states on a cheapest repair."""
    t, n = tables(), len(offsets) - 1
    total = len(symbols)
    letters, inserts, states = (np.zeros(total, np.uint8) for _ in range(3))
    ends, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for rows in _by_width(offsets):
        lanes = _some(symbols, offsets, rows)
        at = borders(lanes, start[rows])
        goal = np.where(final[rows], t.end_live[at[:, -1]], live[rows]).astype(np.uint8)
        vectors, after, _ = backward(lanes, at, goal)
        *found, left = forward(lanes, vectors, after, state[rows])
        sizes = np.diff(offsets)[rows]
        real = np.arange(lanes.shape[1]) < sizes[:, None]
        place = np.repeat(offsets[rows], sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        for into, values in zip((letters, inserts, states), found):
            into[place] = values[real]
        last[rows] = left
        ends[rows] = np.where(final[rows], t.end_inserts[at[:, -1], left], 0)
    piece = np.repeat(np.arange(n), np.diff(offsets))
    # letters: insertions, own edit, deletions of further copies; then insertions at the end of a conversation
    more = copies - 1
    each = inserts.astype(np.int64) + 1 + more
    begin = np.cumsum(each) - each + np.concatenate([[0], np.cumsum(ends)])[piece]
    audit = np.full(int(each.sum() + ends.sum()), ord("I"), np.uint8)
    audit[begin + inserts] = letters
    if more.any():
        at = np.repeat(begin + inserts + 1, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        audit[at] = ord("D")
    per = np.bincount(piece, each, n).astype(np.int64) + ends
    price = np.zeros(256, np.int64)
    price[[ord(c) for c in "RDI"]] = REROLE, DELETE, INSERT
    stays = letters != ord("D")
    cost = inserts * INSERT + price[letters] + more * DELETE + (stays & (symbols != GONE) & (symbols % 2 == 1))
    cost = np.bincount(piece, cost, n).astype(np.int64) + ends * INSERT
    # lines: the same order, without deleted rows; inserted roles alternate from the state on
    count = inserts.astype(np.int64) + stays
    base = np.cumsum(count) - count + np.concatenate([[0], np.cumsum(ends)])[piece]
    size = np.bincount(piece, count, n).astype(np.int64) + ends
    user = len(roles)                                        # the pool of roles ends with user, assistant
    role_at, text_at = np.zeros(int(size.sum()), np.int64), np.full(int(size.sum()), len(texts), np.int64)

    def insert(where, state, how_many):
        k = np.arange(how_many.sum()) - np.repeat(np.cumsum(how_many) - how_many, how_many)
        role_at[np.repeat(where, how_many) + k] = user + ((np.repeat(state, how_many) == 2) + k) % 2

    insert(base, states, inserts.astype(np.int64))
    assistant = ((states == 2) + inserts.astype(np.int64)) % 2
    rewritten = np.where(letters == ord("R"), user + assistant, np.arange(total))
    role_at[(base + inserts)[stays]] = rewritten[stays]
    text_at[(base + inserts)[stays]] = np.flatnonzero(stays)
    insert(np.cumsum(size) - ends, last, ends)
    pool = pa.concat_arrays([roles, pa.array(["user", "assistant"], roles.type)])
    struct = pa.StructArray.from_arrays([pool.take(pa.array(role_at)), pa.concat_arrays([texts, pa.array([""], texts.type)])
                                         .take(pa.array(text_at))], names=["role", "text"])
    borders_ = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
    written = pa.StringArray.from_buffers(n, pa.py_buffer(borders_), pa.py_buffer(audit))
    return [written, pa.array(cost), _lists(struct, np.concatenate([[0], np.cumsum(size)]))]


def _pieces(rows: DataFrame) -> DataFrame:
    """Sorted rows to pieces. A whole conversation is solved at once; the rows of other pieces travel on."""
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, part int, piece int, open boolean, {_COUNTS}, {_SOLVED}, {_ROWS}"
    names = [c.strip().split(" ")[0] for c in
             f"conv,part,piece,open,{_COUNTS},audit,cost,lines,symbols,copies,roles,texts".split(",")]

    def emit(batch, cut, unsure, part, piece):
        counts, symbols, copies = _counts(batch, cut)
        roles, texts = batch.column(2), batch.column(3)
        offsets = np.append(cut, batch.num_rows)
        for some in (False, True):
            rows = np.flatnonzero(unsure == some)
            if not len(rows):
                continue
            sizes = np.diff(offsets)[rows]
            own = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(offsets[rows] - own[:-1], sizes) + np.arange(own[-1])
            at, pick = pa.array(rows), pa.array(take)
            m, zero = len(rows), np.zeros(len(rows), np.int64)
            r, t = roles.take(pick), texts.take(pick)
            key = [batch.column(0).take(pa.array(cut[rows])), pa.array(np.full(m, part, np.int32)),
                   pa.array((piece + rows).astype(np.int32)), pa.array(np.full(m, some))]
            if some:
                solved = [pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, _LINES)]
                raw = [_lists(pa.array(symbols[take].astype(np.int32)), own), _lists(pa.array(copies[take]), own),
                       _lists(r, own), _lists(t, own)]
            else:
                solved = _solve(symbols[take], own, copies[take], r, t, zero, zero, zero, np.ones(m, bool))
                raw = [pa.nulls(m, pa.list_(x)) for x in (pa.int32(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays(key + [c.take(at) for c in counts] + solved + raw, names=names)

    def run(batches):
        part, piece, cutter = TaskContext.get().partitionId(), 0, Cutter()
        for batch in _chained(batches):
            found = cutter.add(batch)
            if found is not None:
                yield from emit(*found, part, piece)
                piece += len(found[1])

    return rows.select(*_COLUMNS).mapInArrow(run, schema)


_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _lanes(batch):
    """Symbols of the pieces of a batch and their offsets, from its first column of lists."""
    lists = batch.column(batch.schema.get_field_index("symbols"))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _per_piece(open_: DataFrame, columns, work, out: str) -> DataFrame:
    """``part, piece`` and what ``work`` finds for the symbols of every piece and the given columns."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                symbols, offsets = _lanes(batch)
                given = [batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *work(symbols, offsets, *given)],
                                                 names=["part", "piece", *[c.split(" ")[0] for c in out.split(", ")]])

    return open_.select("part", "piece", "symbols", *columns).mapInArrow(run, f"part int, piece int, {out}")


def _many(symbols, offsets, entries, work):
    """``work(lanes, entry)`` for every piece and each of ``entries``; a list per piece."""
    n = len(offsets) - 1
    out = np.zeros((n, len(entries)), np.int32)
    for rows in _by_width(offsets):
        lanes = _some(symbols, offsets, rows)
        for i, entry in enumerate(entries):
            out[rows, i] = work(lanes, rows, entry)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(entries), pa.int32()), pa.array(out.ravel()))


def _ends_by_vector(symbols, offsets):
    """Vector after a piece for every vector before it."""
    count = len(tables().vectors)
    return [_many(symbols, offsets, range(count), lambda lanes, rows, v: borders(lanes, np.full(len(rows), v, np.int16))[:, -1])]


def _live_by_end(symbols, offsets, start, final):
    """States before a piece that lead to each single state after it; for the last piece, to the end of the conversation."""
    t = tables()

    def work(lanes, rows, q):
        at = borders(lanes, start[rows].astype(np.int16))
        goal = np.where(final[rows], t.end_live[at[:, -1]], 1 << q).astype(np.uint8)
        return backward(lanes, at, goal)[2]

    return [_many(symbols, offsets, range(4), work)]


def _state_by_state(symbols, offsets, start, final, live):
    """State after a piece for every state before it."""
    t = tables()

    def work(lanes, rows, q):
        at = borders(lanes, start[rows].astype(np.int16))
        goal = np.where(final[rows], t.end_live[at[:, -1]], live[rows]).astype(np.uint8)
        vectors, after, _ = backward(lanes, at, goal)
        return forward(lanes, vectors, after, np.full(len(rows), q, np.uint8))[3]

    return [_many(symbols, offsets, range(4), work)]


def _carry(summaries: DataFrame, column: str, first: int, follow, out: str, back: bool = False) -> DataFrame:
    """Carries a value through the pieces of every conversation: a summary row a piece, not the rows."""
    def run(table: pa.Table) -> pa.Table:
        part, piece = (table.column(c).to_numpy() for c in ("part", "piece"))
        order = np.lexsort((piece, part))
        order = order[::-1] if back else order
        lists = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)
        values, at = np.zeros(len(order), np.int32), first
        for i in order:
            values[i] = at
            at = follow(lists[i], at)
        final = np.zeros(len(order), bool)
        final[order[0 if back else -1]] = True
        return pa.table([table.column("part"), table.column("piece"), pa.array(values), pa.array(final)],
                        names=["part", "piece", out, "final"])

    return summaries.groupBy("conv").applyInArrow(run, f"part int, piece int, {out} int, final boolean")


def _union(masks, live):
    return int(np.bitwise_or.reduce([m for q, m in enumerate(masks) if live >> q & 1] or [0]))


def _solve_open(open_: DataFrame) -> DataFrame:
    """Pieces of conversations that lie in several pieces: three carries, then each piece for itself."""
    key = open_.select("conv", "part", "piece")
    light = open_.select("part", "piece", "symbols")

    def known(found):                                            # small rows by a unique key
        return settle(found.join(key, ["part", "piece"]))

    at = settle(_carry(known(_per_piece(light, [], _ends_by_vector, "ends array<int>")), "ends", 0, lambda e, v: int(e[v]), "start"))
    light = light.join(at, ["part", "piece"])
    masks = known(_per_piece(light, ["start", "final"], _live_by_end, "masks array<int>"))
    # the last piece has the same states before it for any entry, so a carry of all states starts there
    live = settle(_carry(masks, "masks", 15, _union, "live", back=True).drop("final"))
    light = light.join(live, ["part", "piece"])
    states = known(_per_piece(light, ["start", "final", "live"], _state_by_state, "states array<int>"))
    state = settle(_carry(states, "states", 0, lambda e, q: int(e[q]), "state").drop("final"))
    given = at.join(live, ["part", "piece"]).join(state, ["part", "piece"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, offsets = _lanes(batch)
            copies, roles, texts = (batch.column(batch.schema.get_field_index(c)).flatten() for c in ("copies", "roles", "texts"))
            start, final, live, state = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                                         for c in ("start", "final", "live", "state"))
            solved = _solve(symbols, offsets, copies.to_numpy(zero_copy_only=False), roles, texts, start, live, state, final)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *solved],
                                             names=["conv", "part", "piece", "audit", "cost", "lines"])

    rows = open_.select("conv", "part", "piece", "symbols", "copies", "roles", "texts").join(given, ["part", "piece"])
    rows = rows.select("conv", "part", "piece", "symbols", "copies", "roles", "texts", "start", "final", "live", "state")
    return rows.mapInArrow(run, f"conv {open_.schema['conv'].dataType.simpleString()}, part int, piece int, {_SOLVED}")


# ---------------------------------------------------------------- results

class Repair:
    """Repaired conversations: ``report()`` a row per conversation, ``lines()`` their rows.

    Columns may have any names; others are ignored. NULL roles and texts count as one space, NULL turns come first, a NULL id is
    a conversation of its own; rows of one turn stand in order of role and text digest, equal rows next to each other. Roles go
    by their first character. Empty texts are blank. No rows give no conversations.
    """

    def __init__(self, conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text"):
        self.name = conv_id
        order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.md5("text").asc()]
        rows = faults(conversations, conv_id, turn, role, text)
        pieces = settle(_pieces(rows.repartitionByRange(*order).sortWithinPartitions(*order)))
        self.whole = pieces.where("not open")
        self.open = pieces.where("open")
        self.parts = settle(_solve_open(self.open))

    def lines(self) -> DataFrame:
        """``conv_id, line, role, text`` of the repaired conversations, lines from 0 on."""
        whole = self.whole.select("conv", F.posexplode("lines").alias("line", "_l"))
        before = W.partitionBy("conv").orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
        sizes = self.parts.select("conv", "part", "piece", F.size("lines").alias("_n"))
        starts = sizes.select("part", "piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        parts = self.parts.join(starts, ["part", "piece"]).select("conv", "_before", F.posexplode("lines").alias("line", "_l"))
        parts = parts.select("conv", (F.col("line") + F.col("_before")).alias("line"), "_l")
        return whole.unionByName(parts).select(F.col("conv").alias(self.name), F.col("line").cast("bigint").alias("line"),
                                               F.col("_l.role").alias("role"), F.col("_l.text").alias("text"))

    def report(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation."""
        digest = F.sha2(F.array_join(F.transform("lines", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"), 256)
        counted = ["blank", "duplicate", "truncated", "illegal"]
        whole = self.whole.select("conv", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
                                  *counted, "cost", "audit", digest.alias("repaired_sha256"))
        w = W.partitionBy("conv").orderBy("part", "piece")
        near = self.open.select("conv", *counted, "low", "high", "turns", (F.lag("high").over(w) == F.col("low")).alias("_same"), "first_role",
                                F.lag("last_role").over(w).alias("_prev"))
        legal = F.expr("(_prev in (0, 2) and first_role = 1) or (_prev = 1 and first_role = 2)")
        sums = near.groupBy("conv").agg(
            F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns") + F.count(F.when(F.col("_same"), 1)), F.lit(0)).alias("gaps"),
            *[F.sum(c).alias(c) for c in counted[:3]],
            (F.sum("illegal") + F.count(F.when(F.col("_prev").isNotNull() & ~legal, 1))).alias("illegal"))
        joined = join_same(_joined(self.parts), sums, ["conv"])
        parts = joined.select("conv", "gaps", *counted, "cost", "audit", "repaired_sha256")
        return whole.unionByName(parts).withColumnRenamed("conv", self.name)


def _chained(batches):
    yield from batches
    yield None


def _joined(parts: DataFrame) -> DataFrame:
    """``conv, cost, audit, repaired_sha256`` from pieces in order: a digest runs through them, their texts are not gathered."""
    def run(batches):
        conv, any_, digest, audit, cost, empty = None, False, None, [], 0, True

        def row():
            return pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([cost], pa.int64()), pa.array(["".join(audit)]),
                                               pa.array([digest.hexdigest()])], names=["conv", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                if not any_ or key != conv:
                    if any_:
                        yield row()
                    conv, any_, digest, audit, cost, empty = key, True, hashlib.sha256(), [], 0, True
                audit.append(batch.column(3)[i].as_py())
                cost += batch.column(4)[i].as_py()
                text = batch.column(5)[i].as_py()
                if text is not None:
                    digest.update((text if empty else "\n" + text).encode())
                    empty = False
        if any_:
            yield row()

    text = F.when(F.size("lines") > 0, F.array_join(
        F.transform("lines", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))
    rows = parts.select("conv", "part", "piece", "audit", "cost", text.alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return rows.mapInArrow(run, f"conv {parts.schema['conv'].dataType.simpleString()}, cost bigint, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Rows damaged by crc32 of ``<conv_id>:<turn>`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 makes it a user's. NULLs count as one space here."""
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown(conv_id), F.lit(":"), shown(turn))) % 20
    rows = conversations.select(F.col(conv_id), F.col(turn), shown(role).alias(role), shown(text).alias(text), code.alias("_code"))
    rows = rows.where("_code <> 0").withColumn("_times", F.when(F.col("_code") == 3, 2).otherwise(1))
    out = rows.select(conv_id, turn, F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col(role)).alias(role),
                      F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.translate(F.col(text), ".!?", ""))
                      .otherwise(F.col(text)).alias(text), F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_n"))
    return out.drop("_n")


def audited(conversations: DataFrame, rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """The report on ``rows`` for every conversation of ``conversations``; those without rows have zeros and the empty digest."""
    report = Repair(rows).report()
    every = conversations.select(conv_id).distinct()
    out = join_same(every, report, [conv_id], "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(conv_id, *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

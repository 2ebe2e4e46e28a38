"""Nearest neighbours by inner product in a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is put into the leaf that the nearest centres lead to. A query walks
the tree best bin first: a priority queue holds the nodes met so far by their promise, and leaves are visited in that order.
How many leaves are visited is calibrated: for a bounded set of queries the exact neighbours are found among all rows, and
visits widen until the leaves seen hold the wanted share of them. A leaf with many rows is cut into blocks, and visits of a
leaf into groups, so that no task gets a whole hot leaf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from earmark.llm.store import settle

SAMPLE = 20_000         # rows that the tree is fitted on
PROBES = 256            # queries with exact neighbours for calibration
RECALL = .97            # share of exact neighbours in the visited leaves
BRANCHES, LEAF, STEPS = 8, 48, 8
LEAVES = 128            # leaves get larger with the sample beyond about so many, so that visits follow the queries
BLOCK = 2048            # rows of a leaf that meet a group of visits
VISITS = 4096           # visits of a leaf in a group, about


@dataclass
class Tree:
    """Nodes in one array: children of node i are ``first[i]`` to ``first[i] + count[i]``; leaves have none."""

    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: np.ndarray = field(default=None)     # rows per node number, of leaves

    @staticmethod
    def fit(x: np.ndarray, seed: int = 7) -> "Tree":
        rng = np.random.default_rng(seed)
        center, radius, first, count = [x.mean(0)], [_radius(x, x.mean(0))], [0], [0]
        work, leaf = [(0, x)], max(LEAF, len(x) // LEAVES)
        while work:
            node, own = work.pop()
            if len(own) <= leaf:
                continue
            start, group = _kmeans(own, BRANCHES, rng)
            if len(start) < 2:
                continue
            first[node], count[node] = len(center), len(start)
            for k in range(len(start)):
                part = own[group == k]
                work.append((len(center), part))
                center.append(start[k])
                radius.append(_radius(part, start[k]))
                first.append(0)
                count.append(0)
        return Tree(np.array(center), np.array(radius), np.array(first), np.array(count))

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if self.count[0] else np.zeros(0, np.int64)
        while len(live):
            for parent in np.unique(node[live]).tolist():
                own = live[node[live] == parent]
                low = self.first[parent]
                c = self.center[low:low + self.count[parent]]
                node[own] = low + np.argmin((c * c).sum(1) - 2 * (x[own] @ c.T), axis=1)
            live = live[self.count[node[live]] > 0]
        return node

    def walk(self, q: np.ndarray):
        """Leaves in the order of their promise: the inner product with the centre, and half of what the radius allows."""
        half = .5 * float(np.sqrt(q @ q))
        heap = [(-np.inf, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            n = int(self.count[node])
            if not n:
                yield node
                continue
            low = int(self.first[node])
            promise = self.center[low:low + n] @ q + half * self.radius[low:low + n]
            for k in range(n):
                heapq.heappush(heap, (-float(promise[k]), low + k))

    def visits(self, q: np.ndarray, least: int, rows: int) -> list[int]:
        """The first ``least`` leaves that are not empty, and more until they hold ``rows`` rows."""
        out, held = [], 0
        for leaf in self.walk(q):
            if self.size[leaf]:
                out.append(leaf)
                held += int(self.size[leaf])
                if len(out) >= least and held >= rows:
                    break
        return out


def _radius(x, c):
    return float(np.sqrt(((x - c) ** 2).sum(1).mean())) if len(x) else 0.0


def _kmeans(x, k, rng):
    """Centres that are not empty, and the centre of every row."""
    center = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(STEPS):
        group = np.argmin((center * center).sum(1) - 2 * (x @ center.T), axis=1)
        used = np.unique(group)
        center = np.stack([x[group == g].mean(0) for g in used.tolist()])
    group = np.argmin((center * center).sum(1) - 2 * (x @ center.T), axis=1)
    used, group = np.unique(group, return_inverse=True)
    return center[used], group


def take_top(some, x, ids, rough, q, k):
    """``(numbers, scores)`` of the ``k`` largest inner products among rows ``some``, ties to the smaller id. ``rough``
    products choose; scores are then summed row by row, so that equal vectors get equal scores."""
    if len(some) > k:
        limit = np.partition(rough[some], len(some) - k)[len(some) - k]
        some = some[rough[some] >= limit - 1e-9 * (1 + abs(limit))]
    score = (x[some] * q).sum(1)
    order = np.lexsort((ids[some], -score))[:k]
    return some[order], score[order]


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` (doubles) of rows with an id and a vector of the table's usual length that is finite and not zero."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & good & F.exists("vec", lambda v: v != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("vec") == (usual["n"] if usual else 0))


def _probe(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaf visits at which the leaves hold ``recall`` of the exact neighbours of at most PROBES queries."""
    table = queries.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(PROBES).toArrow()
    if not len(table):
        return 1
    ids, q = table.column("id").to_numpy(), _matrix(table.column("vec"))
    sent = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        own, x = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * len(own)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                v, names, leaf = _matrix(part.column(1)), part.column(0).to_numpy(), part.column(2).to_numpy()
                rough = v @ x.T
                for i in range(len(own)):
                    number = np.arange(len(names))
                    some, score = take_top(number[names != own[i]], v, names, rough[:, i], x[i], k)
                    a, b, c = (np.concatenate(p) for p in zip(best[i], (names[some], score, leaf[some])))
                    order = np.lexsort((a, -b))[:k]
                    best[i] = a[order], b[order], c[order]
        size = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size)), *(pa.array(np.concatenate([b[j] for b in best]))
                                                                            for j in range(3))],
                                         names=["query", "id", "score", "leaf"])

    found = rows.mapInArrow(run, "query long, id long, score double, leaf long")
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query", "leaf").toArrow()
    query, leaf = found.column("query").to_numpy(), found.column("leaf").to_numpy()
    at = []
    for i, own in enumerate(ids.tolist()):
        wanted = leaf[query == own]
        if len(wanted):
            place = {leaf_no: n for n, leaf_no in enumerate(tree.visits(q[i], len(tree.size), 0), 1)}
            at += [place[w] for w in wanted.tolist()]
    at = np.sort(at)
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) if len(at) else 1


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, recall: float = RECALL,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows found with the largest inner product, ties to the smaller id.

    ``queries``: rows of the same columns, all of ``vectors`` if None. A query's own row, by id, is no candidate. Vectors
    that are NULL, zero, of another length than most, or hold NULL or a value that is not finite take no part, and neither
    do rows without an id. Of query rows that share an id one is searched; of candidates each counts.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = settle(usable(vectors, id_col, vec_col))
    asked = rows if queries is None else usable(queries, id_col, vec_col)
    asked = settle(asked.dropDuplicates(["id"]))
    sample = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE).select("vec").toArrow()
    if not len(sample):
        return spark.createDataFrame([], schema)
    tree = Tree.fit(_matrix(sample.column("vec")))
    plain = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            leaf = plain.value.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["id", "vec", "leaf"])

    placed = settle(rows.mapInArrow(place, "id long, vec array<double>, leaf long"))
    # a number per leaf; the tree has no more leaves than its sample has rows
    tree.size = np.zeros(len(tree.count), np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        tree.size[r["leaf"]] = r["n"]
    least = _probe(placed, asked, tree, k, recall)
    groups = max(1, -(-asked.count() * least // (len(tree.leaves()) * VISITS)))
    sent = spark.sparkContext.broadcast((tree, np.maximum(1, -(-tree.size // BLOCK))))

    def visit(batches):
        own, blocks = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                seen = [own.visits(v, least, k + 1) for v in q]
                row = np.repeat(np.arange(len(seen)), [len(s) for s in seen])
                leaf = np.concatenate(seen).astype(np.int64)
                each = blocks[leaf]
                row, leaf = np.repeat(row, each), np.repeat(leaf, each)
                block = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_arrays([
                    pa.array(leaf), pa.array(block), pa.array(ids[row] % groups), pa.array(ids[row]),
                    part.column(1).take(pa.array(row))], names=["leaf", "block", "part", "query", "q"])

    visits = asked.mapInArrow(visit, "leaf long, block long, part long, query long, q array<double>")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    sizes = F.broadcast(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")))     # a number per leaf
    members = placed.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("id"), blocks).cast("bigint").alias("block"), "id", "vec",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("part"))

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            return empty
        x, ids = _matrix(left.column("vec")), left.column("id").to_numpy()
        q, asking = _matrix(right.column("q")), right.column("query").to_numpy()
        out = []
        for at in range(0, len(asking), 512):
            rough = x @ q[at:at + 512].T
            for i in range(rough.shape[1]):
                some, score = take_top(np.flatnonzero(ids != asking[at + i]), x, ids, rough[:, i], q[at + i], k)
                out.append((np.full(len(some), asking[at + i]), ids[some], score))
        return pa.table({n: pa.array(np.concatenate([o[j] for o in out])) for j, n in enumerate(("query", "id", "score"))})

    empty = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    keys = ["leaf", "block", "part"]
    found = members.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(meet, "query long, id long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")

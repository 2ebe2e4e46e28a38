"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are whole words and their character 4- and 5-grams. The vocabulary holds the terms that set toxic examples apart in a
bounded sample of labelled rows; document frequencies of these terms are counted over all documents. The examples stand in
an inverted index whose postings are cut into blocks with the largest weight of each block. A document looks at blocks in
order of their upper bounds and stops when no further block can hold a nearer example, so the neighbours are exact.
Neighbours vote by similarity, examples count by how many labelled rows they stand for, and a logistic curve fitted on
leave-one-out votes turns the vote into a probability. The neighbours are the evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from earmark.llm.store import settle
from earmark.llm.text import BREAK, LOWER, Words, mix, pieces, _BYTE

GRAMS = (4, 5)
#: Labelled rows of each class that the model may look at, by the order of a hash.
EXAMPLES = 2000
TERMS = 1024          # most terms of the vocabulary
SUPPORT = .01         # share of toxic examples that hold a term, at least
LIFT = 5.0            # times as often among toxic examples as among others
NEIGHBOURS = 15
BLOCK = 64            # examples of a block of the index
TOGETHER = 8          # blocks that are looked at before bounds are compared again
_SALT = np.array([0x51ED270B, 0x7A3C9E15, 0x2F6B4D83], np.uint64)


def document_terms(data: np.ndarray, offsets: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word and every 4- and 5-gram of bytes inside a word; a word starts with its own mark.
    ``seen``: a table over the low bits of hashes; terms that it does not hold are left out early."""
    words = Words(data, offsets, BREAK)

    def kept(hashes):
        return np.flatnonzero(seen[(hashes & np.uint64(len(seen) - 1)).astype(np.int64)]) if seen is not None else slice(None)

    hashes = words.hash ^ _SALT[0]
    some = kept(hashes)
    parts, rows = [hashes[some]], [words.doc[some]]
    # bytes that go on with a word
    inside = np.zeros(len(data) + 1, np.int32)
    inside[words.start] += 1
    inside[words.end] -= 1
    inside = np.cumsum(inside)[:-1] > 0
    onward = inside.copy()
    onward[words.start] = False
    values = _BYTE[LOWER[data]]
    for n, salt in zip(GRAMS, _SALT[1:]):
        size = len(data) - n + 1
        if size <= 0:
            continue
        whole, hashes = inside[:size].copy(), np.zeros(size, np.uint64)
        for k in range(n):
            if k:
                whole &= onward[k:k + size]
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + values[k:k + size]
        hashes = hashes ^ (hashes >> np.uint64(29)) ^ salt
        at = np.flatnonzero(whole)
        hashes = mix(hashes[at])
        some = kept(hashes)
        parts.append(hashes[some])
        rows.append(np.searchsorted(offsets, at[some], "right") - 1)
    return np.concatenate(parts), np.concatenate(rows)


def _distinct(hashes, rows):
    """Distinct terms of each row with their number of occurrences."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))) if len(rows) else rows
    return hashes[first], rows[first], np.diff(np.append(first, len(rows)))


class Vocabulary:
    """Chosen terms, ascending, and a quick filter before the exact look-up."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def counts(self, data, offsets):
        """``(row, term number, occurrences)`` of the vocabulary's terms in each row."""
        hashes, rows = document_terms(data, offsets, self.seen)
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        hit = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        key, n = np.unique(rows[hit] * np.int64(len(self.terms) + 1) + at[hit], return_counts=True)
        return key // (len(self.terms) + 1), key % (len(self.terms) + 1), n


def unit_vectors(rows, terms, counts, idf):
    """TF-IDF weights of length 1 per row: (1 + ln tf) * idf."""
    weight = (1 + np.log(counts)) * idf[terms]
    norm = np.sqrt(np.bincount(rows, weights=weight * weight, minlength=int(rows[-1]) + 1 if len(rows) else 0))
    return weight / norm[rows]


class BlockMaxIndex:
    """Postings of unit vectors per term, in blocks of examples with the largest weight of each."""

    def __init__(self, rows, terms, weights, examples: int, n_terms: int):
        self.examples = examples
        self.blocks = max(1, -(-examples // BLOCK))
        order = np.lexsort((rows, terms))
        self.example, self.weight = rows[order], weights[order]
        cell = terms[order] * self.blocks + self.example // BLOCK
        self.pointer = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.top = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.top, (terms[order], self.example // BLOCK), self.weight)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1):
        """The ``k`` most similar examples of similarity over 0, ties to the smaller number: numbers and similarities."""
        bounds = weights @ self.top[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best = np.zeros(0), np.zeros(0, np.int64)
        for at in range(0, len(order), TOGETHER):
            if len(best[0]) >= k and bounds[order[at]] + 1e-9 < best[0][-1]:
                break
            cells = (terms[:, None] * self.blocks + order[at:at + TOGETHER]).ravel()
            size = self.pointer[cells + 1] - self.pointer[cells]
            until = np.cumsum(size)
            posting = np.repeat(self.pointer[cells] - until + size, size) + np.arange(until[-1])
            part = np.repeat(np.repeat(weights, len(cells) // len(terms)), size) * self.weight[posting]
            scores = np.round(np.bincount(self.example[posting], weights=part, minlength=self.examples), 12)
            if skip >= 0:
                scores[skip] = 0
            number = np.flatnonzero(scores > 0)
            score = np.concatenate([best[0], scores[number]])
            number = np.concatenate([best[1], number])
            if len(score) > 4 * k:      # no need to sort what cannot be among the nearest
                some = score >= np.partition(score, len(score) - k)[len(score) - k]
                score, number = score[some], number[some]
            first = np.lexsort((number, -score))[:k]
            best = score[first], number[first]
        return best[1], best[0]


@dataclass
class Model:
    """What a task needs to score: bounded by EXAMPLES and TERMS."""

    terms: np.ndarray
    idf: np.ndarray
    ids: list                # of the examples
    toxic: np.ndarray
    stands_for: np.ndarray   # labelled rows per example of its class
    rows: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    prior: float = 0.0       # of rows without any term
    slope: float = 0.0
    level: float = 0.0

    def index(self):
        return BlockMaxIndex(self.rows, self.term, self.weight, len(self.ids), len(self.terms))

    def vote(self, example, similarity) -> float:
        """Share of toxic votes, in log odds, drawn to the prior."""
        weight = similarity * self.stands_for[example]
        toxic = float((weight * self.toxic[example]).sum())
        total = float(weight.sum())
        share = (toxic + self.prior * .1 + 1e-3) / (total + .1 + 2e-3)
        return float(np.log(share / (1 - share)))

    def score(self, example, similarity) -> float:
        if not len(example):
            return self.prior
        return float(1 / (1 + np.exp(-(self.slope * self.vote(example, similarity) + self.level))))


def _labelled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """At most EXAMPLES labelled rows of each class with their texts, and the number of labelled rows per class."""
    counts = {int(r["y"]): int(r["n"]) for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id", F.lit(41))
    chosen = None
    for y in (0, 1):
        own = labels.where(F.col("y") == y).orderBy(order, "id").limit(EXAMPLES)
        chosen = own if chosen is None else chosen.unionByName(own)
    # at most 2 * EXAMPLES rows of two numbers, whatever the size of labels
    return settle(documents.join(F.broadcast(chosen), "id").dropDuplicates(["id"])), counts


def _choose_terms(examples: DataFrame, sizes: dict) -> np.ndarray:
    """Terms with enough support and lift among toxic examples, the most telling first, then cut to TERMS and sorted."""
    def run(batches):
        for batch, data, offsets in pieces(batches, limit=256 << 10):
            hashes, rows, _ = _distinct(*document_terms(data, offsets))
            y = np.asarray(batch.column(batch.schema.get_field_index("y")).to_pylist())[rows]
            term, inverse = np.unique(hashes, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(term.view(np.int64)), pa.array(np.bincount(inverse, weights=y == 1, minlength=len(term)).astype(np.int64)),
                pa.array(np.bincount(inverse, weights=y == 0, minlength=len(term)).astype(np.int64))], names=["term", "a", "b"])

    toxic, clean = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    found = examples.select("text", "y").mapInArrow(run, "term long, a long, b long")
    found = found.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = found.where((F.col("a") >= max(2, int(SUPPORT * toxic))) & (F.col("a") / toxic >= LIFT * F.col("b") / clean))
    gain = F.pow(F.col("a") / toxic - F.col("b") / clean, 2) / (F.col("a") + F.col("b"))
    top = found.orderBy((gain * F.col("a")).desc(), "term").limit(TERMS).select("term").toArrow()
    return np.sort(top.column("term").to_numpy().astype(np.int64).view(np.uint64))


def _document_frequencies(documents: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and their number."""
    size = len(terms)

    def run(batches):
        vocabulary, total, n = Vocabulary(terms), np.zeros(size, np.int64), 0
        for batch, data, offsets in pieces(batches):
            total += np.bincount(vocabulary.counts(data, offsets)[1], minlength=size)[:size]
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.append(n, total))], names=["term", "n"])

    rows = documents.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for r in rows:
        out[r["term"] + 1] = r["n"]
    return out[1:], int(out[0])


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """A model from ``documents`` (``id, text``) and ``labels`` (``id, y`` with y 0 or 1); None if a class is missing."""
    examples, counts = _labelled(documents, labels)
    sizes = {int(r["y"]): int(r["n"]) for r in examples.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    terms = _choose_terms(examples, sizes)
    frequency, total = _document_frequencies(documents, terms)
    idf = np.log((total + 1) / (frequency + 1)) + 1

    def run(batches):
        vocabulary = Vocabulary(terms)
        for batch, data, offsets in pieces(batches):
            rows, term, n = vocabulary.counts(data, offsets)
            borders = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            column = lambda v: pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), column(term), column(n)],
                                             names=["id", "y", "term", "n"])

    # numbers of vocabulary terms in at most 2 * EXAMPLES rows; no texts
    kept = examples.select("id", "text", "y").mapInArrow(run, "id long, y int, term array<int>, n array<int>").toArrow()
    kept = kept.sort_by("id")
    y = kept.column("y").to_numpy()
    term, n = (kept.column(c).combine_chunks() for c in ("term", "n"))
    rows = np.repeat(np.arange(len(y)), np.diff(term.offsets.to_numpy()))
    term, n = term.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy()
    scale = np.array([counts[0] / sizes[0], counts[1] / sizes[1]])[y]
    model = Model(terms, idf, kept.column("id").to_pylist(), y.astype(float), scale / scale.mean(), rows, term,
                  unit_vectors(rows, term, n, idf))
    bare = np.bincount(rows, minlength=len(y)) == 0
    model.prior = float(((scale * y)[bare].sum() + counts[1] / (counts[0] + counts[1])) / (scale[bare].sum() + 1))
    _calibrate(model, y, scale)
    return model


def _calibrate(model: Model, y, scale) -> None:
    """Logistic curve over leave-one-out votes, with a small ridge."""
    index, borders = model.index(), np.searchsorted(model.rows, np.arange(len(y) + 1))
    votes, truth, weight = [], [], []
    for i in range(len(y)):
        a, b = borders[i], borders[i + 1]
        if b > a:
            example, similarity = index.nearest(model.term[a:b], model.weight[a:b], NEIGHBOURS, skip=i)
            if len(example):
                votes.append(model.vote(example, similarity))
                truth.append(y[i])
                weight.append(scale[i])
    x, truth, weight = np.array(votes), np.array(truth, float), np.array(weight)
    beta = np.array([1.0, 0.0])
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-(beta[0] * x + beta[1])))
        design = np.stack([x, np.ones_like(x)], axis=1)
        gradient = design.T @ (weight * (truth - p)) - .1 * (beta - [1, 0])
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + .1 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.level = float(max(beta[0], 1e-3)), float(beta[1])


def score_texts(source: DataFrame, model: Model | None, passed: list[str], text_col: str = "text",
                evidence: bool = True) -> DataFrame:
    """Columns ``passed`` of ``source`` with ``score`` and, if asked for, ``neighbours`` (example ids) and
    ``similarities``, nearest first."""
    sent = source.sparkSession.sparkContext.broadcast(model)
    rows = source.select(*passed, F.col(text_col).alias("_scored_text"))

    def run(batches):
        own = sent.value
        vocabulary, index = (Vocabulary(own.terms), own.index()) if own is not None else (None, None)
        for batch, data, offsets in pieces(batches, "_scored_text"):
            n = batch.num_rows
            score = np.full(n, own.prior if own is not None else 0.0)
            ids, near = [[] for _ in range(n)], [[] for _ in range(n)]
            if own is not None and len(own.terms):
                row, term, count = vocabulary.counts(data, offsets)
                weight = unit_vectors(row, term, count, own.idf)
                cut = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
                for a, b in zip(cut.tolist(), np.append(cut[1:], len(row)).tolist()):
                    example, similarity = index.nearest(term[a:b], weight[a:b], NEIGHBOURS)
                    score[row[a]] = own.score(example, similarity)
                    ids[row[a]], near[row[a]] = [own.ids[e] for e in example.tolist()], similarity.tolist()
            columns = [batch.column(i) for i in range(len(passed))] + [pa.array(score)]
            if evidence:
                columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*passed, *names])

    names = ["score", *(["neighbours", "similarities"] if evidence else [])]
    schema = rows.drop("_scored_text").schema.add("score", "double")
    if evidence:
        schema = schema.add("neighbours", T.ArrayType(T.LongType())).add("similarities", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, schema)


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string")) % 5 == 0


def training_labels(labels: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """``id, y`` of rows that a model may learn from: an id, a label of 0 or 1, and not held out."""
    rows = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(name).cast("int").alias("y"))
    return rows.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted``, ``neighbours`` and ``similarities`` of every row.

    A score depends on the text alone. Texts without a term of the vocabulary, NULL and blank ones too, get the share of
    toxic rows among such examples. Without examples of both classes every score is 0. A NULL id is not held out; rows
    that share an id are scored each, one of them may be an example.
    """
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    model = fit(texts.where("id is not null"), training_labels(labels, label_col, id_col))
    scored = score_texts(documents, model, [id_col], text_col)
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= .5).cast("int").alias("predicted"), "neighbours", "similarities")

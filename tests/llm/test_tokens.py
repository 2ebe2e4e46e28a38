"""Token operators against the tokenizers library, text by text."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from earmark.llm import bpe, token_codes, token_counts
from earmark.llm.queries import QUERIES, tokenizer_file

PATH = tokenizer_file()
TEXTS = [None, "", "a", "It's the dogs' 'sun', we'll  see\n\n\n  x", "\xa0\x85 naïve ½² 12", "日本語 text 😀", "a<|endoftext|>b <|endoftext|>",
         "é" * 50 + "\n" + "é", "line one\nline two\n\nlast", " \n \t", "ab" * 9000, "'s't're'x ''s 's", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i if i != 5 else None, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "same id", "clash", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


def test_round_trip_matches_library(spark, documents, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.decoded, r.ids) for r in bpe.round_trip(documents, PATH).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, library.decode(ids, skip_special_tokens=False), ids)
                  for r in documents.collect() for ids in [library.encode(r.text or "", add_special_tokens=False).ids])
    assert got == want
    empty = documents.where("false")
    assert bpe.round_trip(empty, PATH).count() == 0


def test_segment_tree_on_random_texts(library):
    rng = random.Random(5)
    codec = bpe.Codec(PATH)
    parts = ["'", "s", "re", " ", "  ", "\n", "a", "B", "é", "1", "!", "’", "日", "the", "ing", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + ["a" * 3000, " " * 700]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, borders = codec.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert ids[borders[i]:borders[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_splitter_carries_no_merges(library):
    codec = bpe.Codec(PATH)
    assert len(codec.vocabulary.outline) < 2000
    for text in filter(None, TEXTS):
        assert codec.splitter.pre_tokenize_str(text) == library.pre_tokenizer.pre_tokenize_str(text)


def test_cache_forgets_without_changing_ids(library):
    codec = bpe.Codec(PATH)
    codec.encoder.cache.limit = 40
    for k in range(30):
        text = " ".join(f"w{j * k}" for j in range(12)) + " the of"
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = codec.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def brute_sections(library, text):
    text = text or ""
    spans = library.encode(text, add_special_tokens=False).offsets
    lines = text.split("\n")
    sections, at = [], 0
    for k, line in enumerate(lines):
        end = at + len(line) + (k < len(lines) - 1)
        sections.append([at, end, 0, 0])
        at = end
    if len(sections) > 1 and sections[-1][0] == sections[-1][1]:
        sections.pop()
    for a, b in spans:
        over = [min(e, b) - max(s, a) for s, e, _, _ in sections]
        best = over.index(max(over))
        sections[best][2] += 1
        sections[best][3] += sum(o > 0 for o in over) > 1
    return [tuple(s) for s in sections], len(spans)


def test_section_counts_match_offsets(spark, documents, library):
    got = {}
    for r in token_counts.section_counts(documents, PATH).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.n_crossing, r.doc_tokens))
    for r in documents.where("doc_id is null or doc_id != 3").collect():
        want, n = brute_sections(library, r.text)
        assert sorted(got[r.doc_id]) == [(k, *s, n) for k, s in enumerate(want)], r.text
    assert sum(x[3] for x in got[3]) == sum(len(library.encode(t, add_special_tokens=False).ids) for t in (TEXTS[3], "same id"))


def test_boundary_rule():
    border = np.array([0, 3, 6, 9])
    section, crossing = token_counts.attribute(np.array([0, 2, 2, 1]), np.array([3, 4, 6, 8]), border)
    assert section.tolist() == [0, 0, 1, 1] and crossing.tolist() == [1, 2, 3]


def test_codes_round_trip(spark, documents, library, tmp_path, monkeypatch):
    manifest = token_codes.write_codes(documents, PATH, end_id=0)
    rows = token_codes.read_codes(manifest).collect()
    rows.sort(key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in documents.collect()], key=lambda d: (d is not None, d or 0))
    at = 0
    texts = {}
    for r in documents.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        texts.setdefault(r.doc_id, []).append(ids)
    for r in rows:
        assert r.start == at and bytes(r.ids) in texts[r.doc_id] and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert token_codes.read_codes(token_codes.write_codes(documents.where("false"), PATH)).count() == 0


def test_random_access_without_block_decoding():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 300, 4000), rng.integers(0, 1 << 31, 200), [0, 255, 256, 65535, 65536]]).astype(np.uint32)
    raw = token_codes.pack([4, None], np.array([0, 10, len(ids)]), ids)
    read = []

    def read_at(at, size):
        read.append(size)
        return raw[at:at + size]

    code = token_codes.CodeFile(read_at)
    assert code.all_tokens().tolist() == ids.tolist()
    read.clear()
    for i in range(0, len(ids), 7):
        assert code.token(i) == ids[i]
    assert max(read) <= 64
    with pytest.raises(IndexError):
        code.token(len(ids))


def test_queries_on_small_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    at, want = 0, set()
    for d in sorted(ids):
        own = np.array(ids[d] + [0], "<u4").tobytes()
        want.add((d, at, len(own) // 4, zlib.crc32(own)))
        at += len(own) // 4
    assert {tuple(r) for r in QUERIES["op5_token_codes"](spark, sf).collect()} == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(d, len(i), sha(",".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for d, i in ids.items()}
    assert {tuple(r) for r in QUERIES["op9_bpe"](spark, sf).collect()} == want

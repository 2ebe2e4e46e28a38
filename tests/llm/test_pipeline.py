"""The pipeline on planted documents."""

import hashlib
import random

import corpus_pipeline
from earmark.llm.queries import tokenizer_file


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ner", "sut", "vo", "pra") for b in ("ba", "den", "fir", "gol", "hus", "jem", "tra")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, passage = prose(40), prose(80)
    texts = {i: prose(80) for i in range(60)}
    texts |= {100 + i: prose(30) + " zorgwad zorgwad " + prose(20) for i in range(30)}
    near = texts[3].split()
    near[40] = "other"
    texts |= {200: texts[0], 201: " ".join(near), 202: prose(20) + " " + item + " " + prose(20),
              203: prose(30) + " " + passage + " " + prose(20), 204: prose(25) + "\n" + passage + "\n" + prose(22), 205: None, 206: ""}
    rows = [(d, t, "en", "s", len(t or ""), "extra") for d, t in texts.items()] + [(None, prose(50), "en", "s", 1, "x"), (5, texts[5], "en", "s", 1, "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(100 <= d < 130)) for d in texts if d < 200], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == at.dtypes, name
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        at = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in at.select("doc_id").collect()))
    clean = set(range(60)) | {-1, 205, 206}
    assert set(seen[0]) == clean | {200, 201, 202, 203, 204}
    assert seen[1] == sorted(clean | {202, 203, 204})          # copies and the repeated row 5 are gone
    assert seen[2] == seen[1]
    assert seen[3] == sorted(clean | {203, 204}) == seen[4]
    kept = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/2.parquet").collect()}
    middle = " ".join(passage.split()[15:65])
    assert middle in kept[203].text and middle not in kept[204].text and kept[204].n_chars == len(kept[204].text)
    assert all(kept[d].text == texts[d] for d in range(60))
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_file())
    final = {r.doc_id: r for r in at.collect()}
    for d in (1, 204, 205):
        ids = library.encode(kept[d].text or "", add_special_tokens=False).ids
        assert final[d].n_tokens == len(ids)
        assert final[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert final[d].decoded_sha256 == hashlib.sha256((kept[d].text or "").encode()).hexdigest()


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    rng = random.Random(1)
    p, q, r, own = (" ".join(f"w{rng.randrange(80)}" for _ in range(40)) for _ in range(4))
    rows = [(1, p, "a"), (1, q, "b"), (2, r, "c"), (5, p, "d"), (5, r + " x", "e"), (5, own, "g"), (5, own, "f"),
            (9, None, "n"), (9, None, "n"), (None, p, "z"), (None, p, "z"), (10, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rows string")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.dtypes == docs.dtypes
    left = [tuple(x) for x in out.collect()]
    known = [t for d, t, _ in left if d is not None]
    assert sum(t == p for t in known) == 1 and sum(t == q for t in known) == 1 and sum(t == own for t in known) == 1
    assert sum(t in (r, r + " x") for t in known) == 1
    assert (5, own, "f") in left and (9, None, "n") in left and (10, "", "q") in left
    assert left.count((None, p, "z")) == 2 and len(left) == 8

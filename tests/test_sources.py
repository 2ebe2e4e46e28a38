import json
import wave

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from earmark.operators import catalog
from earmark.sources import audio, labels, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture()
def names(spark, tmp_path):
    return labels.read_code_names(spark, write(tmp_path / "names.tsv", "/m/01\tDog\n/t/dd_2\tCat, small\n/g/a1\tRain\n"))


def test_weak_segments(spark, tmp_path, names):
    f = write(tmp_path / "x_segments.csv", '# Segments csv\n# id, start\n--a_b, 30.000, 40.000, "/m/01,/t/dd_2"\nc-1, 0.0, 10.0, "/g/a1"\n')
    got = labels.read_weak_segments(spark, f, names).collect()
    assert sorted((r.clip_id, r.label) for r in got) == [("--a_b", "Cat, small"), ("--a_b", "Dog"), ("c-1", "Rain")]
    bad = write(tmp_path / "bad.csv", 'q, 0, 1, "/m/77"\n')
    with pytest.raises((PySparkException, Py4JError), match="unknown label code"):
        labels.read_weak_segments(spark, bad, names).collect()


def test_strong_labels(spark, tmp_path, names):
    f = write(tmp_path / "s.tsv", "segment_id\tstart\tend\tlabel\na_b_30000\t0.5\t1.25\t/m/01\na_b_30000\t0.1\t2.0\t/g/a1\n")
    got = labels.read_strong_labels(spark, f, names).collect()
    assert sorted((r.clip_id, r.onset, r.offset, r.label) for r in got) == [("a_b", .1, 2.0, "Rain"), ("a_b", .5, 1.25, "Dog")]
    assert [r.clip_id for r in labels.read_strong_clip_ids(spark, f).collect()] == ["a_b"]


def test_class_indices(spark, tmp_path):
    f = write(tmp_path / "c.csv", 'index,mid,display_name\n0,/m/01,"Dog"\n1,/m/02,"Cat, small"\n')
    assert sorted(tuple(r) for r in labels.read_class_indices(spark, f).collect()) == [("/m/01", "Dog"), ("/m/02", "Cat, small")]


def test_ontology(spark, tmp_path):
    nodes = [{"id": "1", "name": "Animal", "child_ids": ["2", "3"], "x": 1}, {"id": "2", "name": "Pet", "child_ids": ["4"]},
             {"id": "3", "name": "Wild", "child_ids": ["4"]}, {"id": "4", "name": "Dog", "child_ids": []}]
    df = labels.read_ontology(spark, write(tmp_path / "o.json", json.dumps(nodes, indent=1)))
    edges = catalog.ontology_edges(df)
    assert sorted(map(tuple, edges.collect())) == [("Animal", "Pet"), ("Animal", "Wild"), ("Pet", "Dog"), ("Wild", "Dog")]
    lists = {r.name: r for r in catalog.ontology_lists(df, catalog.ontology_closure(edges)).collect()}
    assert lists["Dog"].ancestor_names == ["Animal", "Pet", "Wild"] and lists["Dog"].descendant_names == []
    assert lists["Animal"].descendant_names == ["Dog", "Pet", "Wild"] and lists["Animal"].ancestor_names == []


def test_ground_truth(spark, tmp_path):
    ev = write(tmp_path / "e.tsv", "filename\tonset\toffset\tevent_label\na.wav\t0.5\t1.0\tDog\nb.wav\t\t\t\n")
    got = sorted((r.clip_id, r.onset, r.label) for r in labels.read_ground_truth(spark, ev).collect())
    assert got == [("a", .5, "Dog"), ("b", None, None)]
    tags = write(tmp_path / "t.tsv", "filename\tevent_labels\na.wav\tDog,Cat\n")
    assert sorted((r.clip_id, r.pos, r.label) for r in labels.read_ground_truth(spark, tags).collect()) == [("a", 0, "Dog"), ("a", 1, "Cat")]


def test_segment_list(spark, tmp_path):
    f = write(tmp_path / "l.csv", "# c\n\na_1, 0.0, 10.0, \"/m/01,/m/02\"\nb, 30.0, 40.0\n")
    assert sorted(tuple(r) for r in labels.read_segment_list(spark, f).collect()) == [("a_1", 0.0, 10.0), ("b", 30.0, 40.0)]


def wav(path, seconds, rate=8000, channels=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(b"\0" * (2 * channels * int(seconds * rate)))


def test_audio_tree(spark, tmp_path):
    root = tmp_path / "db" / "audio"
    wav(root / "train" / "weak" / "a.wav", 1.5)
    wav(root / "validation" / "validation" / "b.wav", .25, channels=1)
    wav(root / "train" / "weak" / "empty.wav", 0)
    write(root / "train" / "weak" / "broken.wav", "no audio")
    files = audio.list_audio(spark, str(root))
    # a data chunk behind a long other chunk
    raw = (root / "validation" / "validation" / "b.wav").read_bytes()
    (tmp_path / "far.wav").write_bytes(raw[:36] + b"LIST" + (5000).to_bytes(4, "little") + b"x" * 5000 + raw[36:])
    far = audio.list_audio(spark, str(tmp_path / "far.wav"))
    assert [r.audio_length for r in audio.probe_durations(far).collect()] == [.25]
    length = {r.audio_path.rsplit("/", 1)[1]: r.audio_length for r in audio.probe_durations(files).collect()}
    assert length == {"a.wav": 1.5, "b.wav": .25, "empty.wav": 0.0, "broken.wav": 0.0}
    listing = audio.list_audio(spark, str(root))
    wanted = spark.createDataFrame([("train_weak", "a"), ("train_weak", "gone"), ("train_weak", "broken")], "dataset string, clip_id string")
    clips = audio.discover_datasets(listing, wanted)
    assert sorted((r.dataset, r.clip_id, r.audio_path is not None) for r in clips.collect()) == [
        ("train_weak", "a", True), ("train_weak", "broken", True), ("train_weak", "gone", False), ("validation", "b", True)]
    probe = audio.probe_durations(files)
    done = {r.clip_id: r for r in catalog.attach_durations(clips, probe).collect()}
    assert done["a"].available and done["a"].audio_length == 1.5
    assert not done["broken"].available and done["broken"].audio_path is None
    assert not done["gone"].available
    named = clips.fillna("none", ["audio_path"])
    states = {r.clip_id: r.state for r in catalog.missing_and_damaged(named, listing, probe).collect()}
    assert states == {"broken": "damaged", "gone": "missing"}


def test_mixed_window_shifts_raise(spark, tmp_path):
    rows = [("f", "a", 1), ("auc", "a", 2)]
    tables.write_json(spark.createDataFrame(rows, "metric string, label string, window_shift int"), str(tmp_path / "p"))
    assert tables.read_hyper_params(spark, str(tmp_path / "p"), ["f"]).count() == 1
    with pytest.raises((PySparkException, Py4JError), match="several window shifts"):
        tables.read_hyper_params(spark, str(tmp_path / "p")).collect()


def test_dataset_read_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "dataset string, clip_id string")
    tables.write_database(df, str(tmp_path / "db"))
    plan = tables.read_database(spark, str(tmp_path / "db"), "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_wide_scores_and_reports(spark, tmp_path):
    rows = [("x", 0, 0.0, .02, "a", .1), ("x", 0, 0.0, .02, "b", .2)]
    df = spark.createDataFrame(rows, "clip_id string, frame bigint, onset double, offset double, label string, score double")
    tables.write_wide_scores(df, str(tmp_path / "w"), ["b", "a"])
    back = spark.read.csv(str(tmp_path / "w"), sep="\t", header=True)
    assert back.columns == ["onset", "offset", "b", "a", "clip_id"] and back.count() == 1
    tables.write_text_report(df, str(tmp_path / "r"), "label")
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]


def test_wide_files_are_listed_once(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("x", 0, 0.0, 1.0, "a", 0.25), ("y", 0, 0.0, 1.0, "a", 0.5)], "clip_id string, frame long, onset double, offset double, label string, score double")
    tables.write_wide_scores(df, str(tmp_path / "w"), ["a"])
    calls, text = [], type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, *a, **k: calls.append(a) or text(self, *a, **k))
    rows = tables.read_wide_scores(spark, str(tmp_path / "w"))
    assert sorted((r.clip_id, r.score) for r in rows.collect()) == [("x", 0.25), ("y", 0.5)] and len(calls) == 1

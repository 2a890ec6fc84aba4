"""Collections that are embedded once, recipes, replay with a cache, session status."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid import registry
from corvid.operators import collections, mlp, progress
from corvid.operators.embed import HashingEmbedder
from corvid.schema import DETECTORS
from corvid.sinks import files as sinks
from corvid.sources import files


class Counting(HashingEmbedder):
    """Leaves a mark in a folder for each text it embeds."""

    folder = ""

    def embed_media(self, content):
        with open(f"{os.environ['CORVID_TEST_SEEN']}", "a") as f:
            f.write(content.decode() + "\n")
        return super().embed_media(content)


@pytest.fixture()
def seen(spark, tmp_path, monkeypatch):
    path = tmp_path / "seen"
    path.write_text("")

    def make():
        os.environ["CORVID_TEST_SEEN"] = str(path)
        return Counting()

    def take():
        out = sorted(path.read_text().split())
        path.write_text("")
        return out

    return make, take


def test_collection_embeds_only_what_has_changed(spark, tmp_path, seen):
    make, take = seen
    for cat in ("cats", "dogs"):
        (tmp_path / "in" / cat).mkdir(parents=True)
        for i in range(3):
            (tmp_path / "in" / cat / f"{i}.txt").write_text(f"{cat}{i}")
    c = collections.Collection(spark, str(tmp_path / "kept"), "demo")
    at = str(tmp_path / "in")
    state = lambda: tuple(c.state(at, "paragraph", "e1").first())[2:5]
    assert state() == ("needs_embedding", 6, 0) and c.stored() is None
    first = c.load(at, "paragraph", make, "e1").orderBy("clip_id").collect()
    assert [(r.clip_id, r.category, r.filename) for r in first] == [(i + 1, ("cats", "dogs")[i // 3], f"{i % 3}.txt") for i in range(6)]
    assert take() == sorted(f"{c}{i}" for c in ("cats", "dogs") for i in range(3)) and state() == ("ready", 6, 6)
    assert first[0].origin.importer == "demo" and first[0].word_count == 1
    assert [r.md5 for r in c.load(at, "paragraph", make, "e1").orderBy("clip_id").collect()] == [r.md5 for r in first] and take() == [] and c.version() == 1
    (tmp_path / "in" / "cats" / "1.txt").write_text("changed")
    (tmp_path / "in" / "dogs" / "2.txt").unlink()
    (tmp_path / "in" / "dogs" / "9.txt").write_text("new")
    assert state() == ("needs_embedding", 6, 4)
    second = c.load(at, "paragraph", make, "e1").orderBy("clip_id").collect()
    assert take() == ["changed", "new"] and [r.clip_string for r in second] == ["cats0", "changed", "cats2", "dogs0", "dogs1", "new"] and c.version() == 2
    assert len(c.load(at, "paragraph", make, "e2").collect()) == 6 and len(take()) == 6  # another embedder reads all again
    assert [r.clip_string for r in c.load(at, "paragraph", make, "e2", start=1, end=2).orderBy("clip_id").collect()] == ["changed", "dogs1"] and take() == []
    assert c.load(at, "paragraph", make, "e2", categories=["dogs"]).count() == 3
    c.clear()
    assert c.version() == 0
    none = collections.Collection(spark, str(tmp_path / "kept"), "none")
    assert tuple(none.state(str(tmp_path / "absent"), "audio", "e").first()) == ("none", "audio", "needs_files", 0, 0, 0.0)


def test_a_version_that_is_not_whole_does_not_count(spark, tmp_path, seen):
    make, take = seen
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    c = collections.Collection(spark, str(tmp_path / "kept"), "demo")
    (tmp_path / "kept" / "demo" / "v1").mkdir(parents=True)
    (tmp_path / "kept" / "demo" / "v1" / "part-0.parquet").write_bytes(b"torn")
    assert c.version() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        c.load(str(tmp_path / "in"), "paragraph", make, "e")


def test_available_files_and_session(spark, tmp_path):
    (tmp_path / "b.pkl").write_bytes(b"x" * 1_250_000)
    (tmp_path / "a.pkl").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert collections.available(spark, str(tmp_path)) == [{"name": "a.pkl", "size_mb": 0.0}, {"name": "b.pkl", "size_mb": 1.2}]
    clips = spark.createDataFrame([(2, "image"), (1, "audio")], "clip_id long, type string")
    votes = spark.createDataFrame([(1, "unlabel")], "clip_id long, label string")
    assert tuple(collections.session_status(clips, votes).first()) == (True, 2, False, "audio")
    assert tuple(collections.session_status(clips.limit(0), votes.union(spark.createDataFrame([(1, "bad")], votes.schema))).first()) == (False, 0, True, None)
    rows = spark.createDataFrame([(1, None, None, "f"), (2, ("own", {"a": "1"}), "n", "g"), (3, None, " ", None)], "clip_id long, origin struct<importer:string,params:map<string,string>>, origin_name string, filename string")
    got = collections.with_origins(rows, "folder", {"path": "/x"}).orderBy("clip_id").collect()
    assert [(r.origin.importer, r.origin_name) for r in got] == [("folder", "f"), ("own", "n"), ("folder", "")]


def history(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(0, 12)), ("good", "bad", "unlabel")[rng.choice(3, p=[0.45, 0.45, 0.1])]) for i in range(n)]


def test_replay_cache_trains_new_steps_alone(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    clips = spark.createDataFrame([(i, [float(x) for x in rng.normal(i % 2, 0.3, 4)]) for i in range(12)], "clip_id long, embedding array<float>")
    log = lambda n: spark.createDataFrame(history(60)[:n], "seq long, clip_id long, label string")
    cache, asked = progress.ReplayCache(spark, str(tmp_path / "models")), []
    real = progress.replay
    monkeypatch.setattr(progress, "replay", lambda c, h, i, e, only: asked.append(only.count()) or real(c, h, i, e, only))
    rows = lambda df: {r.step: (r.threshold, r.b2, tuple(r.w2)) for r in df.collect()}
    fourty = rows(cache.replay(clips, log(40), epochs=3))
    assert asked == [40] and fourty == rows(real(clips, log(40), 0, 3))
    fifty = rows(cache.replay(clips, log(50), epochs=3))
    assert asked == [40, 10] and {k: fifty[k] for k in fourty} == fourty and fifty == rows(real(clips, log(50), 0, 3))
    assert rows(cache.replay(clips, log(30), epochs=3)) == {k: v for k, v in fifty.items() if k < 30} and len(asked) == 2
    cache.replay(clips, log(30), inclusion=2, epochs=3)
    assert asked[-1] == 30  # another inclusion
    cut = log(30).where("seq <> 3")
    assert rows(cache.replay(clips, cut, epochs=3)) == rows(real(clips, cut, 0, 3)) and asked[-1] == 26  # all from the missing event on
    cache.clear()
    cache.replay(clips, log(5), epochs=3)
    assert asked[-1] == 5


def test_replay_blocks_equal_single_steps(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = {i: [float(x) for x in rng.normal(i % 2, 0.5, 3).astype(np.float32)] for i in range(12)}
    clips = spark.createDataFrame(list(vectors.items()), "clip_id long, embedding array<float>")
    log = history(45, 3)
    monkeypatch.setattr(progress, "BLOCK", 7)
    got = {r.step: r for r in progress.replay(clips, spark.createDataFrame(log, "seq long, clip_id long, label string"), epochs=2).collect()}
    now, want = {}, {}
    for step, (_, c, label) in enumerate(log):
        now.pop(c, None)
        if label != "unlabel":
            now[c] = label
        if len(set(now.values())) == 2:
            want[step] = dict(now)
    assert set(got) == set(want)
    for step, held in want.items():
        x, y = np.array([vectors[c] for c in sorted(held)]), np.array([held[c] == "good" for c in sorted(held)], float)
        assert np.allclose(mlp.train(x, y, 0, epochs=2).w0, got[step].w0)
    states = {(r.step, r.clip_id): r.label for r in progress.label_states(spark.createDataFrame(log, "seq long, clip_id long, label string")).collect()}
    assert all({c: v for (s, c), v in states.items() if s == step} == held for step, held in want.items())


def test_recipes_fail_alone(spark, tmp_path):
    m = mlp.Mlp.initial(4)
    (tmp_path / "d.json").write_text(sinks.detector_json("inside", m, 0.4, "image"))
    for i in range(6):
        (tmp_path / f"{i}.txt").write_text(("good news " if i % 2 else "bad story ") + str(i))
    lines = ["File, Label ", *(f"{tmp_path}/{i}.txt,{'GOOD' if i % 2 else 'bad'}" for i in range(6)), f"{tmp_path}/none.txt,good", ",bad"]
    (tmp_path / "l.csv").write_text("\n".join(lines))
    entries = [
        {"processor_name": "a", "processor_importer": "detector_file", "field_values": {"path": str(tmp_path / "d.json")}},
        {"processor_name": "b", "processor_importer": "detector_file", "field_values": {"path": str(tmp_path / "absent.json")}},
        {"processor_name": "c", "processor_importer": "csv_label_file", "field_values": {"path": str(tmp_path / "l.csv"), "embedder": HashingEmbedder, "epochs": 3}},
        {"processor_name": "d", "processor_importer": "unheard_of", "field_values": {}},
        {"processor_name": "have", "processor_importer": "detector_file", "field_values": {"path": "never read"}},
        {"processor_importer": "detector_file"}, "no recipe",
    ]
    settings = registry.Settings.loads(json.dumps({"favorite_processors": [e if not isinstance(e, dict) else {k: v for k, v in e.items() if k != "field_values"} for e in entries]}))
    assert len(settings.favorite_processors) == 7
    held = registry.Detectors.empty(spark).add(spark.createDataFrame([("have", "audio", *m.as_row().values(), 0.5, None)], DETECTORS))
    got, failed = registry.cook(spark, entries, held)
    rows = {r.name: r for r in got.table.collect()}
    assert set(rows) == {"a", "c", "have"} and rows["a"].threshold == 0.4 and rows["a"].media_type == "image" and rows["c"].media_type == "paragraph" and len(rows["c"].w0[0]) == 64
    assert sorted((r.name or "", r.importer or "") for r in failed.collect()) == [("", ""), ("", "detector_file"), ("b", "detector_file"), ("d", "unheard_of")]
    some, none = registry.cook(spark, entries, held, ["a"])
    assert {r.name for r in some.table.collect()} == {"a", "have"} and none.where("name is not null").count() == 0
    assert registry.Recipe.of(entries[0]).as_entry() == entries[0]


def test_path_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("﻿ Path ,LABEL,md5\n a.wav , Good ,x\nb.wav,bad,\n,good,y\nc.wav,,z\n".encode())
    assert [tuple(r) for r in files.path_labels_csv(spark, str(tmp_path / "l.csv")).orderBy("entry_id").collect()] == [(0, "a.wav", "good"), (1, "b.wav", "bad")]
    (tmp_path / "n.csv").write_text("md5,label\nh,good\n")
    with pytest.raises(ValueError, match="path"):
        files.path_labels_csv(spark, str(tmp_path / "n.csv"))
    with pytest.raises(ValueError, match="md5"):
        files.labels_csv(spark, str(tmp_path / "l.csv").replace("l.csv", "p.csv")) if (tmp_path / "p.csv").write_text("path,label\na,good\n") else None


def test_registries_of_labels_and_processors(spark, tmp_path, monkeypatch):
    assert registry.label_importers.names() == ["csv_labels", "json_labels"] and registry.processor_importers.names() == ["csv_label_file", "detector_file", "label_file"]
    package = tmp_path / "some_plugins"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "broken.py").write_text("raise RuntimeError('no')")
    (package / "fine.py").write_text("from corvid.registry import Source\nclass P(Source):\n    name = 'fine'\n    def read(self, spark, **v):\n        return spark.range(1)\nPLUGIN = P()\n")
    (package / "other.py").write_text("x = 1")
    monkeypatch.syspath_prepend(str(tmp_path))
    for kind in (registry.label_importers, registry.processor_importers):
        own = registry.Registry(kind.kind)
        own.discover("some_plugins")
        assert own.names() == ["fine"] and own.get("fine").read(spark).count() == 1
    with pytest.raises(KeyError, match="fine"):
        own.get("other")

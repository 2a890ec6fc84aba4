import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvid import registry
from corvid.functions import scalars as S
from corvid.operators import extract, mlp, search
from corvid.operators.embed import HashingEmbedder, embed_query
from corvid.schema import DETECTORS
from corvid.sinks import files as sinks
from corvid.sources import files
from corvid.streaming import votes


@pytest.fixture()
def texts(tmp_path):
    for name, body in (("b.txt", "two words"), ("a.txt", "one two three"), ("c.md", "?"), ("d.jpg", "x")):
        (tmp_path / name).write_text(body)
    return tmp_path


def test_folder_scan_embeds_and_skips(spark, texts):
    got = files.folder(spark, str(texts), "paragraph", HashingEmbedder).orderBy("clip_id").collect()
    assert [(r.clip_id, r.filename, r.word_count, r.character_count) for r in got] == [(1, "a.txt", 3, 13), (2, "b.txt", 2, 9)]
    assert got[0].origin.importer == "folder" and len(got[0].embedding) == 64 and bytes(got[0].clip_bytes) == b"one two three"
    thin = files.folder(spark, str(texts), "paragraph", HashingEmbedder, thin=True).orderBy("clip_id").collect()
    assert [r.md5 for r in thin] == [r.md5 for r in got] and thin[0].clip_bytes is None
    known = spark.createDataFrame([("c.md", [1.0, 0.0], "hash")], "filename string, vector array<float>, md5 string")
    assert [(r.filename, r.md5) for r in files.folder(spark, str(texts), "paragraph", None, known).collect()] == [("c.md", "hash")]
    assert {r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(texts), "paragraph").collect()} == {"a.txt", "b.txt", "c.md"}
    with pytest.raises(ValueError):
        files.folder(spark, str(texts), "smell")


def test_archive_and_category_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("dogs/a.txt", "a dog")
        z.writestr("cats/a.txt", "a cat")
        z.writestr("cats/b.txt", "two cats")
    got = files.archive(spark, str(tmp_path / "x.zip"), str(tmp_path / "out"), "paragraph", HashingEmbedder)
    assert got.count() == 3
    named = files.category_folders(spark, str(tmp_path / "out" / "x_zip"), ["cats", "dogs"], "paragraph")
    assert {(r.filename, r.category) for r in named.collect()} == {("a.txt", "dogs"), ("b.txt", "cats")}


def test_label_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"labels": [{"md5": "h", "label": "good", "origin": {"importer": "f", "params": {"p": "1"}}}, 3, "x", {"label": "bad", "file": "a.wav"}]}))
    got = files.labels_json(spark, str(tmp_path / "l.json")).orderBy("entry_id").collect()
    assert [(r.md5, r.label, r.path) for r in got] == [("h", "good", None), (None, "bad", "a.wav")] and got[0].origin.params == {"p": "1"}
    (tmp_path / "bad.json").write_text("[1")
    with pytest.raises(ValueError):
        files.labels_json(spark, str(tmp_path / "bad.json"))
    (tmp_path / "l.csv").write_bytes("﻿ MD5 ,Label,x\n h1 , GOOD ,1\n,bad,2\nh2,bad,3\n".encode())
    assert [(r.md5, r.label) for r in files.labels_csv(spark, str(tmp_path / "l.csv")).orderBy("md5").collect()] == [("h1", "good"), ("h2", "bad")]
    rows = spark.createDataFrame([(1, "a.wav", "good"), (2, "b.mp4", "bad"), (3, "c.mp3", "bad"), (4, "d.zip", "bad"), (5, "e.wav", "meh")], "entry_id long, path string, label string")
    assert [r.entry_id for r in files.trainer_rows(rows).orderBy("entry_id").collect()] == [1, 3]


def test_feed(spark, tmp_path):
    item = '<item><title>{0}</title><enclosure url="http://h/{0}.mp3?x=1" type="audio/mpeg"/></item>'
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(item.format(i) for i in "ab") + "<item><title>none</title></item></channel></rss>")
    got = files.feed_items(spark, str(tmp_path / "f.xml")).collect()
    assert [r.filename[8:] for r in got] == ["_a.mp3", "_b.mp3"] and files.feed_items(spark, str(tmp_path / "f.xml"), 1).count() == 1


def test_detector_round_trip(spark, tmp_path):
    m = mlp.train(np.random.default_rng(0).normal(size=(8, 4)), np.array([1, 0] * 4), epochs=3)
    (tmp_path / "d.json").write_text(sinks.detector_json("mine", m, 0.123456, "image"))
    row = files.detector_json(spark, str(tmp_path / "d.json")).first()
    assert (row.name, row.media_type, row.threshold) == ("mine", "image", 0.1235) and np.allclose(row.w0, m.w0)
    (tmp_path / "e.json").write_text("{}")
    with pytest.raises(ValueError):
        files.detector_json(spark, str(tmp_path / "e.json"))


def test_tones_and_dataset_round_trip(spark, tmp_path):
    t = files.tones(spark)
    rows = t.orderBy("clip_id").collect()
    assert [r.frequency for r in rows[:3]] == [200, 250, 300] and rows[4].duration == 1.0 and bytes(rows[0].clip_bytes)[:4] == b"RIFF"
    sinks.dataset(t, str(tmp_path / "ds"))
    assert files.dataset(spark, str(tmp_path / "ds")).count() == 20
    assert registry.sources.get("combine_datasets").read(spark, paths=[str(tmp_path / "ds")] * 2).count() == 20


def test_results_sinks(spark, tmp_path):
    d = spark.createDataFrame([("d", "audio", *mlp.Mlp.initial(2).as_row().values(), 0.0, None)], DETECTORS)
    clips = spark.createDataFrame([(1, [1.0, 0.0], "a.wav", "c"), (2, [0.0, 1.0], None, None)], "clip_id long, embedding array<float>, filename string, category string")
    clips = clips.withColumns({"origin": F.struct(F.lit("folder").alias("importer"), F.create_map(F.lit("p"), F.lit("/x")).alias("params")), "origin_name": F.col("filename"), "md5": F.lit(None).cast("string")})
    hit = search.hits(search.detector_scores(clips, d))
    rows = search.hit_rows(hit, clips)
    assert {(r.filename, r.category, r.origin) for r in sinks.hits_csv_rows(rows).collect()} == {("a.wav", "c", "folder(/x)"), ("clip_2", "unknown", "folder(/x)")}
    res = search.results_document(hit, d)
    assert "2 hits of 1" in sinks.results_json(res, str(tmp_path / "r"), "audio")
    doc = sinks.document(res, "audio")
    assert "clip 1" in sinks.report_text(doc) and "<li>" in sinks.report_html(doc)
    assert len(sinks.clipboard(rows).first().text.split("\n")) == 2


def test_registry_and_settings(spark):
    with pytest.raises(ValueError):
        registry.sources.get("folder").checked({"path": "x"})
    with pytest.raises(KeyError):
        registry.sinks.get("none")
    row = lambda n: spark.createDataFrame([(n, "audio", *mlp.Mlp.initial(2).as_row().values(), 0.5, None)], DETECTORS)
    d = registry.Detectors.empty(spark).add(row("a")).add(row("b")).add(row("a"))
    assert d.table.count() == 2 and d.missing(["a", "c"]) == ["c"]
    with pytest.raises(ValueError):
        d.rename("a", "b")
    assert {r.name for r in d.rename("a", "z").delete("b").table.collect()} == {"z"}
    s = registry.Settings.loads('{"inclusion": 99, "volume": -1, "odd": 1}')
    assert s.inclusion == 10 and s.volume == 0.0 and registry.Settings.loads("nope") == registry.Settings()


def test_extraction(spark):
    f = spark.createDataFrame([Row(clip_id=1, found=[Row(confidence=0.5, bbox=[1.234, 2.0], label="cat"), Row(confidence=0.91234, bbox=[0.0], label="cat"), Row(confidence=0.99, bbox=[0.0], label="dog")]), Row(clip_id=2, found=[])], f"clip_id long, found array<{extract.EXTRACTION}>")
    got = f.select(extract.of_class(F.col("found"), "cat", 0.5).alias("x")).first().x
    assert [(e.confidence, e.bbox) for e in got] == [(0.9123, [0.0]), (0.5, [1.23, 2.0])]
    kinds = spark.createDataFrame([("c", "image", "cat", 0.6), ("d", "audio", "dog", 0.1)], "name string, media_type string, target_class string, threshold double")
    assert [(r.extractor, r.confidence) for r in extract.extract(f, kinds, "image").collect()] == [("c", 0.9123)]


def test_scalars(spark):
    df = spark.createDataFrame([("a/B.JPG", 1, "  x  y "), ("c", 5, ""), ("d.txt", 20, None)], "p string, n long, t string")
    got = df.select(S.mime_type(F.col("p")), S.media_type(F.col("p")), S.sample_frames(F.col("n")), S.word_count(F.col("t")), S.stem(F.col("p")), S.clamp(F.col("n"), 2, 6)).collect()
    assert [r[0] for r in got] == ["image/jpeg", "application/octet-stream", "text/plain"] and [r[1] for r in got] == ["image", None, "paragraph"]
    assert [r[2] for r in got] == [[0], [0, 1, 2, 3, 4], [0, 2, 5, 8, 10, 13, 16, 19]] and got[0][3] == 2 and got[0][4] == "B"
    assert np.allclose(embed_query(HashingEmbedder(), "a dog", enrich=True) @ embed_query(HashingEmbedder(), "a dog", enrich=True), 1)
    with pytest.raises(ValueError):
        embed_query(HashingEmbedder(), "  ")


def test_vote_stream(spark, tmp_path):
    rows = [(1, 1, "good"), (2, 2, "bad"), (1, 3, "good"), (1, 4, "bad"), (2, 5, "good")]
    df = spark.createDataFrame(rows, "clip_id long, seq long, vote string")
    for i, part in enumerate([df.where("seq <= 2"), df.where("seq > 2")]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = votes.toggled_stream(stream).writeStream.format("memory").queryName("toggled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("toggled").collect())) == [(1, 1, "good"), (1, 3, "unlabel"), (1, 4, "bad"), (2, 2, "bad"), (2, 5, "good")]


def test_storage_refuses_a_local_folder_on_a_cluster():
    from corvid import storage

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://far:7077"}.get(key, default)

    class Far:
        conf = Conf()

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Far())


def test_storage_removes_its_tables(spark):
    from corvid import storage

    kept = storage.durable(spark.range(3), "kept")
    assert kept.count() == 3 and storage.clear(spark) >= 1 and storage.clear(spark) == 0
    first, second, third = (storage.durable(spark.range(n), "some") for n in (1, 2, 3))
    named = storage.bucketed(spark.range(4), "some", "id")
    assert storage.held(spark) == 4 and storage.clear(spark, 1, but_last=True) == 2 and first.count() == 1 and named.count() == 4
    assert storage.clear(spark, 1) == 1 and storage.held(spark) == 1 and second.columns == third.columns
    assert storage.clear(spark) == 1
    with pytest.raises(Exception, match="(?i)not.exist|file"):
        kept.selectExpr("sum(id) + 1").collect()

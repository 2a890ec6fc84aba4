"""Rankings with clips, stripes, media by id, progress, live status, vectors of sounds and pixels."""

import io
import math
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import progress, views
from corvid.operators.embed import PlanesEmbedder, SoundEmbedder, embedded
from corvid.registry import StatusTracker
from corvid.sources import files
from corvid.streaming import votes


@pytest.mark.parametrize(("n_rows", "n"), [(0, 5), (3, 5), (10, 5), (23, 5), (101, 7), (7, 1)])
def test_stripes_are_ntiles(spark, n_rows, n):
    rows = spark.createDataFrame([(i, i + 1) for i in range(n_rows)], "clip_id long, rank long")
    got = {r.rank: (r.stripe, r.position) for r in views.stripes(rows, n).collect()}
    long, small = n_rows % n, n_rows // n
    sizes = [small + (i < long) for i in range(n)]
    want = [i + 1 for i, size in enumerate(sizes) for _ in range(size)]
    assert [got[k + 1][0] for k in range(n_rows)] == want
    assert all(math.isclose(p, (k - 1) / n_rows) for k, (_, p) in got.items())


def test_ranked_clips_keep_the_order_and_drop_what_is_not_loaded(spark):
    ranking = spark.createDataFrame([(5, 0.1), (3, 0.9), (4, 0.9), (9, 0.5)], "clip_id long, score double")
    clips = spark.createDataFrame([(3, "a", 1.0), (4, "b", 1.0), (5, "c", 1.0), (6, "d", 1.0)], "clip_id long, filename string, score double")
    got = views.ranked_clips(ranking, clips).orderBy("rank").collect()
    assert [(r.rank, r.clip_id, r.filename, r.score) for r in got] == [(1, 3, "a", 0.9), (2, 4, "b", 0.9), (3, 5, "c", 0.1)]
    marks = views.stripe_marks(views.stripes(views.ranked_clips(ranking, clips), 2), spark.createDataFrame([(3, "good"), (5, "bad")], "clip_id long, label string"))
    assert sorted(map(tuple, marks.collect())) == [(1, 2, 1, 0), (2, 1, 0, 1)]


def test_media_by_id_reads_one_bucket(spark):
    rows = spark.range(200).select(F.col("id").alias("clip_id"), F.lit("image").alias("type"), F.concat(F.col("id").cast("string"), F.lit(".png")).alias("filename"), F.col("id").cast("string").cast("binary").alias("clip_bytes"), F.lit(None).cast("string").alias("clip_string"))
    media = views.Media(rows)
    found = media.find(77)
    assert [(bytes(r.clip_bytes), r.mime) for r in found.collect()] == [(b"77", "image/png")] and media.find(-1).collect() == []
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    total = media.table._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert found.rdd.getNumPartitions() == 1 and len(media.table.inputFiles()) == 4 and total is not None
    assert 0 < scan.apply("numOutputRows").value() < 100  # rows of one bucket of four


def test_eta_words(spark):
    cases = [(0, "Less than 5"), (29.9, "Less than 30"), (59, "Less than a minute"), (89, "About a minute"), (150, "About 3 minutes"), (3599, "About 60 minutes"), (3600, "About 1 hour remaining"), (5400, "About 1 hour 30 minutes"), (7300, "About 2 hours")]
    rows = spark.createDataFrame([(float(s),) for s, _ in cases], "s double").select(views.eta_text(F.col("s")).alias("t")).collect()
    assert all(r.t.startswith(want) for r, (_, want) in zip(rows, cases, strict=True))
    got = views.with_eta(spark.createDataFrame([(0, 10, 1.0), (5, 10, 2.0), (20, 10, 1.0), (3, 0, 1.0)], "current long, total long, elapsed double")).collect()
    assert [(r.percent, r.seconds_left) for r in got] == [(0.0, None), (50.0, 2.0), (100.0, 0.0), (None, None)] and got[0].eta is None and got[1].rate == 2.5


def test_tracker_moves_during_a_scan(spark):
    tracker, seen = StatusTracker(), []
    slow = F.udf(lambda x: time.sleep(0.15) or x, "long")
    real = tracker.update
    tracker.update = lambda *a, **k: (seen.append(a), real(*a, **k))
    with views.watched(spark, tracker, "embedding", "all of it", every=0.05):
        spark.range(0, 24, 1, 12).select(slow("id")).write.format("noop").mode("overwrite").save()
    done = [a[2] for a in seen if len(a) > 3 and a[3] == 12]
    assert done == sorted(done) and len(set(done)) > 2 and tracker.get()["status"] == "idle" and tracker.get()["error"] is None
    with pytest.raises(ZeroDivisionError), views.watched(spark, tracker, "loading"):
        1 / 0  # noqa: B018
    assert tracker.get()["error"] == "division by zero"


def test_live_status_equals_the_batch_and_survives_a_restart(spark, tmp_path):
    rng = np.random.default_rng(5)
    now, rows = {}, []
    for step in range(60):
        clip, label = int(rng.integers(0, 40)), ("good", "bad", "unlabel")[rng.choice(3, p=[0.45, 0.45, 0.1])]
        rows.append(("s", step, now.get(clip, "unlabel"), label, None if rng.random() < 0.2 else float(0.5 + (30 - step) * 0.01 * (step < 30) + rng.random() * 0.05)))
        now[clip] = label
    schema = "session string, step long, was string, label string, cost double"
    cuts = [0, 7, 25, 26, 48, 60]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    told = []

    def keep(df, i):
        told.extend(tuple(r) for r in df.collect())

    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        if k in (1, 4):  # two runs from one checkpoint
            q = votes.live_status(stream()).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
            q.processAllAvailable()
            q.stop()
    assert [t[1] for t in told] == cuts[1:]
    for (_, n, good, bad, status, slope), end in zip(told, cuts[1:], strict=True):
        rng_rows = rows[:end]
        good_want = sum(r[3] == "good" for r in rng_rows) - sum(r[2] == "good" for r in rng_rows)
        bad_want = sum(r[3] == "bad" for r in rng_rows) - sum(r[2] == "bad" for r in rng_rows)
        assert (good, bad) == (good_want, bad_want)
        costs = spark.createDataFrame([(r[1], r[4]) for r in rng_rows], "step long, cost double")
        want = progress.status(costs, good, bad, n).first()
        assert (status, round(slope, 4)) == (want.status, round(want.slope, 4))


def tone(hz, seconds=0.5, rate=22050, width=2, channels=1):
    x = np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate) * 0.6
    data = {1: lambda: (x * 127 + 128).astype(np.uint8), 2: lambda: (x * 32767).astype("<i2"), 4: lambda: (x * (2**31 - 1)).astype("<i4")}[width]()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(np.repeat(data, channels).tobytes())
    return out.getvalue()


def test_spectrum_equals_plain_sums():
    e = SoundEmbedder(window=64, hop=32)
    x = np.random.default_rng(0).normal(size=150)
    got = e.spectrum(x)
    assert got.shape == (3, 33)
    for i, frame in enumerate(got):
        for k in (0, 5, 32):
            terms = [x[32 * i + t] * np.hanning(64)[t] * np.exp(-2j * np.pi * k * t / 64) for t in range(64)]
            assert math.isclose(frame[k], abs(sum(terms)) ** 2, rel_tol=1e-9, abs_tol=1e-12)
    assert e.spectrum(x[:10]).shape == (1, 33)


def test_sounds_have_neighbours_by_pitch(spark):
    clips = embedded(files.tones(spark).drop("embedding"), SoundEmbedder, "clip_bytes").orderBy("clip_id").collect()
    v = np.array([r.embedding for r in clips])
    assert v.shape == (20, 64) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)
    near = np.argsort(-(v @ v.T), axis=1)[:, 1]
    assert np.mean(np.abs(near - np.arange(20)) <= 3) > 0.8
    e = SoundEmbedder()
    same = [e.embed_media(tone(440, width=w, channels=c)) for w, c in ((1, 1), (2, 1), (4, 1), (2, 2))]
    assert all(np.dot(same[1], x) > 0.97 for x in same) and np.dot(same[1], e.embed_media(tone(3000))) < 0.9
    assert [e.embed_media(b) for b in (b"", b"RIFFno", tone(0))] == [None] * 3 and e.embed_text("x") is None


def test_planes_tell_directions_and_colours():
    e = PlanesEmbedder()
    ramp = np.tile(np.arange(32, dtype=np.uint8) * 8, (32, 1))
    image = lambda g, c=(1, 1, 1): np.stack([(g * k).astype(np.uint8) for k in c], axis=2).tobytes()
    across, again, down, red = (e.embed_media(image(*x)) for x in ((ramp,), (ramp // 2,), (ramp.T,), (ramp, (1, 0, 0))))
    assert len(across) == e.dim and across @ again > across @ down and across @ red < 0.999
    assert e.embed_media(b"short") is None


def test_untested_sinks_and_orders(spark, tmp_path):
    from corvid.operators import labels

    rows = spark.createDataFrame([(1, "good", 0.9, 3, "b"), (2, "bad", 0.2, None, "a"), (3, "good", None, 5, "c")], "clip_id long, label string, score double, click long, filename string")
    order = lambda by: [r.clip_id for r in labels.sort_labels(rows, by).collect()]
    assert [order(b) for b in ("time", "name", "confidence_desc", "confidence_asc", "id")] == [[3, 1, 2], [2, 1, 3], [1, 2, 3], [3, 2, 1], [1, 2, 3]]
    clips = spark.createDataFrame([(1, "h1", None, "n1", "f1", "c"), (2, None, None, " ", "f2", None)], "clip_id long, md5 string, origin struct<importer:string,params:map<string,string>>, origin_name string, filename string, category string")
    votes_ = spark.createDataFrame([(1, "good", 2), (2, "bad", 1), (7, "good", 3)], "clip_id long, label string, seq long")
    got = labels.labelset(votes_, clips).orderBy("label").collect()
    assert [(r.label, r.ord, r.md5, r.origin_name, r.filename) for r in got] == [("bad", 1, None, None, "f2"), ("good", 1, "h1", "n1", "f1")]
    hit = spark.createDataFrame([(1, None, None, None, "own"), (2, None, "given", "x", None)], "clip_id long, origin struct<importer:string,params:map<string,string>>, origin_name string, filename string, md5 string")
    assert [(r.label, r.origin_name, r.md5) for r in labels.labelset_from_hits(hit, clips).orderBy("clip_id").collect()] == [("good", "n1", "own"), ("good", "given", None)]
    meta = tmp_path / "m.csv"
    meta.write_text("filename,fold,target,category,esc10,src_file,take\na.wav,1,3,dog,True,77,A\nb.wav,2,4,cat,False,78,B\n")
    assert [(r.filename, r.fold, r.esc10) for r in files.metadata_csv(spark, str(meta)).orderBy("filename").collect()] == [("a.wav", 1, True), ("b.wav", 2, False)]
    planes = np.arange(3072, dtype=np.uint16).astype(np.uint8).tobytes()
    batch = spark.createDataFrame([(1, 2, bytearray(planes))], "image_id long, label int, data binary")
    pixels = np.frombuffer(bytes(files.image_batch(batch).first().pixels), np.uint8).reshape(32, 32, 3)
    assert (pixels[:, :, 1].ravel() == np.frombuffer(planes, np.uint8)[1024:2048]).all()

"""From labels to detectors, evaluation reports, progress reports, extractors, and sums over ranges."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid import registry
from corvid.operators import evaluate, extract, metrics, mlp, progress, search, thresholds, training
from corvid.operators.embed import HashingEmbedder, embed_query
from corvid.operators.ranges import ranked, running
from corvid.sinks import files as sinks


def groups(spark, n=20, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k * n + i, [float(v) for v in rng.normal(0, 0.3, dim) + 2 * np.eye(dim)[k]], f"c{k}") for k in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "clip_id long, embedding array<float>, category string")


def test_running_sums_of_hot_and_null_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [None, "hot", "hot", "hot", "x"][i % 5], int(rng.integers(0, 9)), int(rng.integers(0, 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v long, o long")
    got = {r["id"]: (r["s"], r["rn"]) for r in running(df, [F.desc("o"), F.col("id")], {"s": F.col("v"), "rn": F.lit(1).cast("long")}, ("k",)).collect()}
    want = {}
    for key in {r[1] for r in rows}:
        total = 0
        for place, r in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (-r[3], r[0])), 1):
            total += r[2]
            want[r[0]] = (total, place)
    assert got == want
    assert [r["rn"] for r in ranked(df, [F.col("id")], "rn").orderBy("id").collect()] == list(range(1, 301))
    assert ranked(df.limit(0), [F.col("id")], "rn", ("k",)).count() == 0


def label_rows(spark, rows):
    kind = "entry_id long, label string, md5 string, origin struct<importer:string,params:map<string,string>>, origin_name string"
    return spark.createDataFrame(rows, kind)


def loaded(spark):
    none = F.lit(None)
    return groups(spark).withColumns({"md5": F.concat(F.lit("m"), F.col("clip_id").cast("string")), "origin": none.cast("struct<importer:string,params:map<string,string>>"), "origin_name": none.cast("string")})


def test_detector_from_labels_equals_its_numpy_twin(spark):
    clips = loaded(spark)
    asked = [(i, "GOOD" if i < 12 else "bad", f"m{i * 2}", None, None) for i in range(24)]
    asked += [(90, "maybe", "m1", None, None), (91, "good", "gone", None, None), (92, None, "m3", None, None)]
    got = training.from_labels(label_rows(spark, asked), clips, epochs=20)
    vectors = {r["clip_id"]: r["embedding"] for r in clips.collect()}
    x, y = np.array([vectors[i * 2] for i in range(24)], float), np.array([i < 12 for i in range(24)], float)
    assert (got.loaded, got.skipped) == (24, 3)
    assert got.threshold == pytest.approx(thresholds.cross_calibrated_np(x, y, epochs=20))
    assert np.allclose(got.model.score(x), mlp.train(x, y, epochs=20).score(x))
    assert search.detector_scores(clips, got.row(spark, "d", "audio")).count() == 60


@pytest.mark.parametrize("labels", [[], ["good"], ["good", "good"]])
def test_too_few_labels_are_refused(spark, labels):
    rows = [(i, label, f"m{i}", None, None) for i, label in enumerate(labels)]
    with pytest.raises(ValueError, match="needed"):
        training.from_labels(label_rows(spark, rows), loaded(spark))


def test_label_file_sort_and_detector_read_files(spark, tmp_path):
    words = {"good": "river water stream", "bad": "engine motor wheel"}
    rows = []
    for i in range(8):
        label = "good" if i % 2 else "bad"
        p = tmp_path / f"a file {i}.txt"
        p.write_text(f"{words[label]} {i}")
        rows.append((i, label, str(p)))
    (tmp_path / "empty.txt").write_text("")
    rows += [(20, "good", str(tmp_path / "gone.txt")), (21, "maybe", rows[0][2]), (22, "bad", None), (23, "good", str(tmp_path / "empty.txt")), (24, "good", rows[1][2])]
    labels = spark.createDataFrame(rows, "entry_id long, label string, path string")
    vectors = [(i, [float(v) for v in HashingEmbedder().embed_text(t)]) for i, t in enumerate(["river water", "motor wheel", "stream of water", "an engine"])]
    clips = spark.createDataFrame(vectors, "clip_id long, embedding array<float>")
    ranking, threshold, found = training.label_file_sort(clips, labels, HashingEmbedder, safe=True, epochs=60)
    assert (found.loaded, found.skipped) == (9, 4)
    assert {r["clip_id"] for r in ranking.limit(2).collect()} == {0, 2} and 0 <= threshold <= 1
    assert training.from_label_file(labels, HashingEmbedder, epochs=5).loaded == 9


def test_text_search(spark):
    texts = ["red apple", "green pear", "blue sky", ""]
    rows = [(i, [float(x) for x in v]) for i, t in enumerate(texts) if (v := HashingEmbedder().embed_text(t)) is not None]
    clips = spark.createDataFrame(rows, "clip_id long, embedding array<float>")
    ranking, threshold = training.text_search(clips, HashingEmbedder(), "apple red")
    assert ranking.first()["clip_id"] == 0
    assert threshold == pytest.approx(search.search_threshold(clips, embed_query(HashingEmbedder(), "apple red")))
    with pytest.raises(ValueError):
        training.text_search(clips, HashingEmbedder(), "  ")
    with pytest.raises(ValueError, match="no clips"):
        training.text_search(clips.limit(0), HashingEmbedder(), "apple")


def learned_by_hand(rows, target, fraction=0.5, seed=42, epochs=20, safe=False):
    """n_train, n_test, tp, fp, fn, tn of one target, over lists."""
    train, test = [], []
    for c in sorted({r[2] for r in rows}):
        own = sorted((hashlib.sha256(f"{seed}:{c}:{r[0]}".encode()).hexdigest(), *r) for r in rows if r[2] == c)
        n = max(1, int(len(own) * fraction))
        train, test = train + [o[1:] for o in own[:n]], test + [o[1:] for o in own[n:]]
    train.sort()
    x, y = np.array([r[1] for r in train], float), np.array([r[2] == target for r in train], float)
    m, cut = mlp.train(x, y, epochs=epochs), thresholds.cross_calibrated_np(x, y, epochs=epochs)
    if safe:
        cut = thresholds.blended(cut, thresholds.mixture_threshold_np(*np.unique(m.score(np.array([r[1] for r in rows], float)).round(4), return_counts=True)), len(y))
    pairs = [(m.score(np.array([r[1]], float))[0].round(4) >= cut, r[2] == target) for r in test]
    return len(train), len(test), *(pairs.count(p) for p in ((True, True), (True, False), (False, True), (False, False)))


@pytest.mark.parametrize("safe", [False, True])
def test_eval_learned_sort_equals_its_twin(spark, safe):
    odd = [(900, [1.0] * 8, "single"), (901, [1.0] * 8, None), (902, None, "c0")]
    clips = groups(spark).unionByName(spark.createDataFrame(odd, "clip_id long, embedding array<float>, category string"))
    rows = [tuple(r) for r in clips.collect() if r["category"] is not None and r["embedding"] is not None]
    got = {r["category"]: tuple(r)[1:] for r in evaluate.eval_learned_sort(clips, epochs=20, safe=safe).collect()}
    assert got == {c: learned_by_hand(rows, c, safe=safe) for c in ("c0", "c1", "c2")}


def test_eval_learned_sort_is_the_same_by_shuffle(spark, monkeypatch):
    clips = groups(spark)
    shared = sorted(map(tuple, evaluate.eval_learned_sort(clips, epochs=10).collect()))
    monkeypatch.setattr(evaluate, "SHARED", 0)
    assert sorted(map(tuple, evaluate.eval_learned_sort(clips, epochs=10).collect())) == shared


def test_eval_learned_sort_bounds_training_only(spark):
    clips = groups(spark)
    small = evaluate.eval_learned_sort(clips, epochs=5, max_train=4, categories=["c1"]).collect()
    assert [(r["category"], r["n_train"], r["n_test"]) for r in small] == [("c1", 12, 30)]
    assert evaluate.eval_learned_sort(clips.limit(0)).count() == 0


def test_run_eval_reports(spark, caplog):
    clips = groups(spark)
    queries = clips.where("clip_id in (0, 20, 40)").select(F.concat(F.lit("like "), "category").alias("query"), F.col("embedding").alias("vector"), "category")
    got = evaluate.run_eval({"toy": (clips, queries)}, ["toy", "gone"], epochs=20)
    assert list(got) == ["toy"] and "gone" in caplog.text
    per = metrics.text_sort_eval(clips, queries).collect()
    assert got["toy"]["text_sort"]["mAP"] == pytest.approx(np.mean([r["average_precision"] for r in per]), abs=1e-4)
    assert [q["num_relevant"] for q in got["toy"]["text_sort"]["per_query"]] == [20, 20, 20]
    f1 = [2 * tp / (2 * tp + fp + fn) for c in ("c0", "c1", "c2") for _, _, tp, fp, fn, _ in [learned_by_hand([tuple(r) for r in clips.collect()], c)]]
    assert got["toy"]["learned_sort"]["mean_f1"] == pytest.approx(np.mean(f1), abs=1e-4)
    assert json.loads(sinks.eval_json(got)) == list(got.values())
    assert "learned_sort" not in evaluate.run_eval({"toy": (clips, queries)}, mode="text")["toy"]
    with pytest.raises(ValueError):
        evaluate.run_eval({}, mode="none")


def test_missing_scores_are_zero(spark):
    scores, ids = spark.createDataFrame([(1, 0.5), (9, 0.9)], "clip_id long, score double"), spark.createDataFrame([(1,), (2,)], "clip_id long")
    assert sorted(map(tuple, evaluate.with_missing(scores, ids).collect())) == [(1, 0.5), (2, 0.0)]


def test_progress_report_equals_a_replay_by_hand(spark):
    clips = groups(spark, n=6)
    log = [(0, "good"), (7, "bad"), (1, "good"), (13, "bad"), (0, "unlabel"), (2, "good"), (7, "unlabel")]
    history = spark.createDataFrame([(s, c, label) for s, (c, label) in enumerate(log)], "seq long, clip_id long, label string")
    got = {r["step"]: r for r in progress.report(clips, history, epochs=20).collect()}
    x = {r["clip_id"]: np.array(r["embedding"], float) for r in clips.collect()}
    held, last, want = {}, None, {}
    for step, (c, label) in enumerate(log):
        held.pop(c, None)
        if label != "unlabel":
            held[c] = label
        if len(set(held.values())) < 2:
            continue
        ids = sorted(held)
        y = np.array([held[i] == "good" for i in ids], float)
        m = mlp.train(np.array([x[i] for i in ids]), y, epochs=20)
        cut = thresholds.optimal_threshold_np(m.score(np.array([x[i] for i in ids])), y)
        preds = {i: bool(m.score(v[None])[0] >= cut) for i, v in x.items() if i not in held}
        both = [] if last is None else [i for i in preds if i in last]
        want[step] = (sum(preds[i] != last[i] for i in both), len(both))
        last = preds
        model, at, good, bad = progress.model_at(clips, history, step, epochs=20)
        assert at == pytest.approx(cut) and (good, bad) == ([i for i in ids if held[i] == "good"], [i for i in ids if held[i] == "bad"])
    assert {s: (r["flips"], r["common"]) for s, r in got.items()} == want
    assert {(r["total_labels"], r["total_clips"]) for r in got.values()} == {(3, 18)}
    assert all(r["cost"] is not None for r in got.values())
    assert progress.model_at(clips, history, 99) == (None, None, [], []) and progress.model_at(clips, history, 0)[0] is None


class LongWords(registry.Extractor):
    name, media_type = "long_words", "paragraph"

    def __init__(self, config):
        self.least = int(config["least"])

    def extract(self, clip):
        return [{"confidence": 0.5, "bbox": [0, 1], "label": w} for w in clip["clip_string"].split() if len(w) >= self.least]


def test_extractors_are_checked_and_run(spark, monkeypatch):
    monkeypatch.setitem(registry.extractor_makers, "long_words", LongWords)
    table = registry.Extractors.empty(spark).add("a", "long_words", "paragraph", {"least": 4}).add("b", "long_words", "paragraph", {"least": 9}).add("a", "long_words", "paragraph", {"least": 5})
    for kind, config in (("none", {}), ("long_words", {}), ("long_words", {"least": "x"})):
        with pytest.raises(ValueError):
            table.add("c", kind, "paragraph", config)
    table = table.rename("b", "c")
    assert sorted(r["name"] for r in table.table.collect()) == ["a", "c"] and table.of_type("audio") == {}
    ready = table.of_type("paragraph")
    assert [e().extract({"clip_string": "tiny giants wander"}) for e in ready.values()][1] == []
    assert [f["label"] for f in ready["a"]().extract({"clip_string": "tiny giants wander"})] == ["giants", "wander"]
    assert table.delete("a").table.count() == 1


def test_run_builds_extractors_in_tasks(spark):
    def make():
        class Own:
            def load_model(self):
                self.ready = True

            def extract(self, clip):
                return [{"confidence": 1.0, "label": clip["clip_string"]}] if self.ready and clip["clip_string"] else []

        return Own()

    clips = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "clip_id long, clip_string string")
    got = extract.run(clips, {"own": make}, ("clip_string",)).collect()
    assert [(r["extractor"], r["clip_id"], r["label"], r["bbox"]) for r in got] == [("own", 1, "x", [])]


def test_csv_labels_keep_file_order_and_fall_back_to_latin_1(spark, tmp_path):
    from corvid.sources.files import labels_csv

    (tmp_path / "a.csv").write_bytes("\ufeff MD5 ,Label,note\n".encode() + b"".join(f"h{i},GOOD,n{i}\n".encode() for i in range(50)) + b",good,x\nh7,bad,last\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        got = labels_csv(spark, str(tmp_path / "a.csv")).orderBy("entry_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["entry_id"], r["md5"], r["label"]) for r in got] == [(i, f"h{i}", "good") for i in range(50)] + [(50, "h7", "bad")]
    (tmp_path / "b.csv").write_bytes("md5,label,note\nx,good,caf\u00e9\n".encode("latin-1"))
    assert labels_csv(spark, str(tmp_path / "b.csv")).first()["note"] == "caf\u00e9"
    (tmp_path / "c.csv").write_bytes("md5,label,note\nx,good,caf\u00e9\n".encode())
    assert labels_csv(spark, str(tmp_path / "c.csv")).first()["note"] == "caf\u00e9"
    (tmp_path / "d.csv").write_text("md5,other\nx,y\n")
    with pytest.raises(ValueError):
        labels_csv(spark, str(tmp_path / "d.csv"))


def test_atom_feeds_are_read_in_order(spark, tmp_path):
    from corvid.sources.files import feed_items

    entry = '<entry><title>t{0}</title><link rel="alternate" href="http://x/page{0}"/><link rel="enclosure" href="http://x/e{0}.mp3?k=1"/></entry>'
    body = "".join(entry.format(i) for i in range(5)) + '<entry><title>no file</title><link href="http://x/only"/></entry>'
    (tmp_path / "feed.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>')
    got = [(r["title"], r["url"], r["filename"][8:]) for r in feed_items(spark, str(tmp_path / "feed.xml")).collect()]
    assert got == [(f"t{i}", f"http://x/e{i}.mp3?k=1", f"_e{i}.mp3") for i in range(5)]
    assert [r["title"] for r in feed_items(spark, str(tmp_path / "feed.xml"), 2).collect()] == ["t0", "t1"]


def test_simulated_votes_of_large_sets_stay_off_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 4) + (i % 3)], ["None", "b", None][i % 3]) for i in range(36)] + [(36, None, "b")]
    df = spark.createDataFrame(rows, "clip_id long, embedding array<float>, category string").repartition(3)
    asked = {"epochs": 4, "max_steps": 12, "every": 2}
    small = sorted(map(tuple, evaluate.simulate_voting(df, [0, 1], **asked).collect()))
    x, names = np.array([r[1] for r in rows[:36]], np.float32).astype(float), np.array([r[2] for r in rows[:36]], object)
    assert {r[2] for r in small} == {"None", "b"} and {r[3] for r in small} <= {2, 4, 6, 8, 10, 12}
    for seed, _, target, t, cost, fpr, fnr in small:
        y = np.array([n == target for n in names], float)
        order = evaluate._rng(seed, target).permutation(36)
        seen, test = order[:t], order[18:]
        p = mlp.train(x[seen], y[seen], epochs=4).score(x[test]) >= thresholds.cross_calibrated_np(x[seen], y[seen], 0, seed, epochs=4)
        assert (fpr, fnr) == (round(p[y[test] == 0].mean(), 6), round((~p)[y[test] == 1].mean(), 6)) and cost == pytest.approx(fpr + fnr, abs=2e-6)
    monkeypatch.setattr(evaluate, "SHARED", 0)
    with monkeypatch.context() as m:
        m.setattr(type(df), "toPandas", lambda self: pytest.fail("the set came to the driver"))
        large = evaluate.simulate_voting(df, [0, 1], **asked)
    assert sorted(map(tuple, large.collect())) == small
    assert evaluate.simulate_voting(df.limit(1), [0]).count() == 0


def test_tasks_of_simulated_votes_are_short_however_many_steps_there_are(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 3), float(i % 5)], "ab"[i % 2]) for i in range(36)], "clip_id long, embedding array<float>, category string")
    few = evaluate.simulate_voting(df, [0, 1], epochs=3)
    assert few.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    votes = 4 * sum(range(2, 19))  # of two seeds, two categories and the steps from 2 to 18
    assert evaluate.simulate_voting(df, [0, 1], epochs=10**6).rdd.getNumPartitions() == -(-votes * 10**6 // 20_000_000)  # planned, not trained
    monkeypatch.setattr(evaluate, "WORK", 1)
    many = evaluate.simulate_voting(df, [0, 1], epochs=3)
    assert many.rdd.getNumPartitions() == 4 * 17 and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_training_in_place_follows_the_recipe():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 5)), (np.arange(30) % 3 == 0).astype(float)
    for inclusion in (-2, 0, 3):
        first = mlp.Mlp.initial(5)
        p = [first.w0, first.b0, first.w2, np.array(first.b2)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        weight = np.where(y == 1, *mlp.class_weights(y, inclusion)) / 30
        for step in range(1, 41):
            z = x @ p[0].T + p[1]
            g = (1 / (1 + np.exp(-(np.maximum(z, 0) @ p[2] + p[3]))) - y) * weight
            back = np.outer(g, p[2]) * (z > 0)
            for i, d in enumerate((back.T @ x, back.sum(0), np.maximum(z, 0).T @ g, g.sum())):
                d = d + mlp.DECAY * p[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - mlp.RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        got = mlp.train(x, y, inclusion, epochs=40)
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip((got.w0, got.b0, got.w2, got.b2), p, strict=True))

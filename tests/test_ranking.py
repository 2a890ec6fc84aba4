import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvid.functions.vectors import cosine, mlp_score, vector_literal
from corvid.operators import metrics, mlp, progress, search, thresholds
from corvid.schema import DETECTORS


def two_classes(spark, spread=0.2, n=20, dim=16):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1, spread, (n, dim)), rng.normal(-1, spread, (n, dim))])
    rows = [(i, [float(v) for v in r], "alpha" if i < n else "beta") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "clip_id long, embedding array<float>, category string")


@pytest.mark.parametrize(
    ("ranked", "relevant", "want"),
    [([1, 2, 3, 4, 5], {1, 2, 3}, 1.0), ([10, 20, 30, 1, 40], {1}, 0.25), ([1, 10, 2, 20, 3, 30], {1, 2, 3}, (1 + 2 / 3 + 3 / 5) / 3), ([1, 2], set(), 0.0)],
)
def test_average_precision(spark, ranked, relevant, want):
    df = spark.createDataFrame([("q", i + 1, int(x in relevant)) for i, x in enumerate(ranked)], "query string, rk long, rel int")
    assert metrics.ranking_metrics(df).first().average_precision == pytest.approx(want)


def test_precision_and_recall_at_k(spark):
    df = spark.createDataFrame([("q", i, int(i <= 10)) for i in range(1, 101)], "query string, rk long, rel int")
    r = metrics.ranking_metrics(df).first()
    assert (r.p_at_5, r.p_at_10, r.p_at_20, r.r_at_5, r.r_at_10, r.r_at_20) == (1, 1, 0.5, 0.5, 1, 1)


def test_cosine_of_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in df.select(cosine(F.col("v"), vector_literal([3, 4]))).collect()] == [0.0, pytest.approx(1.0)]


def brute_threshold(s, y, wf, wn):
    by = np.argsort(-s, kind="stable")
    p, n, best, cut = y.sum(), (1 - y).sum(), np.inf, 0.5
    for k in range(1, len(s) + 1):
        tp = y[by[:k]].sum()
        c = wf * (k - tp) / n + wn * (p - tp) / p
        if c < best - 1e-15:
            best, cut = c, s[by[k - 1]]
    return cut


@pytest.mark.parametrize("inclusion", [-2, 0, 3])
def test_optimal_threshold(spark, inclusion):
    rng = np.random.default_rng(inclusion + 5)
    s, y = rng.integers(0, 12, 60) / 12, rng.integers(0, 2, 60)
    df = spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(s, y))], "item_id long, score double, is_good boolean")
    want = brute_threshold(s, y, 2.0 ** max(0, -inclusion), 2.0 ** max(0, inclusion))
    assert thresholds.optimal_threshold(df, inclusion).first().threshold == pytest.approx(want)
    assert thresholds.optimal_threshold_np(s, y, inclusion) == pytest.approx(want)
    assert thresholds.optimal_threshold(df.where("is_good")).first().threshold == 0.5
    assert thresholds.optimal_threshold(df.limit(0)).first().threshold == 0.5


def test_mixture_and_blend(spark):
    v = np.array([0.1, 0.2, 0.3, 0.7, 0.8, 0.9])
    t = thresholds.mixture_threshold_np(v, np.ones(6))
    assert t == pytest.approx(0.5, abs=0.02)
    assert thresholds.mixture_threshold_np(np.array([0.4]), np.array([9.0])) == pytest.approx(0.4)
    assert thresholds.mixture_threshold_np(np.array([0.4]), np.array([1.0])) == 0.5
    assert thresholds.blended(float("inf"), 0.3, 4) == 0.3 and thresholds.blended(0.8, 0.3, 20) == 0.8 and thresholds.blended(0.8, 0.3, 13) == pytest.approx(0.55)
    df = spark.createDataFrame([(float(x),) for x in v], "score double")
    assert thresholds.mixture_threshold(df) == pytest.approx(t)


def test_cross_calibration_limits():
    x, y = np.eye(4), np.array([1, 0, 1, 0])
    assert thresholds.cross_calibrated_np(x[:3], y[:3]) == 0.5
    assert thresholds.cross_calibrated_np(x, y, fraction=0.99) == float("inf")
    assert thresholds.cross_calibrated_np(x, y, epochs=5) == thresholds.cross_calibrated_np(x, y, epochs=5)


def test_learned_sort_parts_classes(spark):
    clips = two_classes(spark)
    votes = clips.where("clip_id % 4 = 0").select("clip_id", F.when(F.col("category") == "alpha", "good").otherwise("bad").alias("label"))
    ranked, t, model = search.learned_sort(clips, votes, safe=True)
    rows = ranked.join(clips, "clip_id").orderBy(F.desc("raw_score"), "clip_id").collect()
    assert [r.category for r in rows] == ["alpha"] * 20 + ["beta"] * 20 and 0 < t < 1
    with pytest.raises(ValueError):
        search.learned_sort(clips, votes.where("label = 'good'"))
    hof = clips.select("clip_id", mlp_score(F.col("embedding"), *[F.lit(v) for v in (model.w0.tolist(), model.b0.tolist(), model.w2.tolist(), model.b2)]).alias("s"))
    arrow = {r.clip_id: r.raw_score for r in mlp.scored(clips, model).collect()}
    assert all(abs(r.s - arrow[r.clip_id]) < 1e-9 for r in hof.collect())
    assert np.allclose(mlp.Mlp.from_state(model.state()).w0, model.w0)


def test_hits_count_zero_detectors(spark):
    clips = two_classes(spark, n=5)
    m = mlp.Mlp.initial(16)
    d = spark.createDataFrame([("never", "audio", *m.as_row().values(), 2.0, None), ("all", "audio", *m.as_row().values(), 0.0, None)], DETECTORS)
    s = search.detector_scores(clips, d)
    assert {r.detector: r.total_hits for r in search.hit_counts(s, d).collect()} == {"never": 0, "all": 10}
    h = search.hits(s).orderBy("rank").collect()
    assert [r.score for r in h] == sorted((r.score for r in h), reverse=True)
    doc = {r.detector: r for r in search.results_document(search.hits(s), d).collect()}
    assert doc["never"].hits == [] and doc["all"].total_hits == 10


def test_next_clip(spark):
    rng = np.random.default_rng(3)
    s = rng.random(40).round(2)
    ranked = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "clip_id long, score double")
    done = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "clip_id long")
    order = sorted(range(40), key=lambda i: (-s[i], i))
    at = int((s >= 0.5).sum())
    open_ = [i for i in order if i % 3]
    assert search.next_clip_top(ranked, done).first().clip_id == open_[0]
    want = min(open_, key=lambda i: (abs(order.index(i) - at), abs(s[i] - 0.5), order.index(i)))
    assert search.next_clip_hard(ranked, done, 0.5).first().clip_id == want


def test_confusion_with_empty_classes(spark):
    df = spark.createDataFrame([(True, True), (False, True)], "pred boolean, truth boolean")
    assert metrics.binary_metrics(df).first().asDict() == {"tp": 1, "fp": 0, "fn": 1, "tn": 0, "accuracy": 0.5, "precision": 1.0, "recall": 0.5, "f1": pytest.approx(2 / 3)}
    assert metrics.error_cost(df, -1).first().asDict() == {"cost": 0.5, "fpr": 0.0, "fnr": 0.5}


def test_replay_and_flips(spark):
    clips = two_classes(spark, n=6)
    h = spark.createDataFrame([(1, 0, "good"), (2, 6, "bad"), (3, 1, "good"), (4, 0, "unlabel"), (5, 7, "bad")], "seq long, clip_id long, label string")
    models = progress.replay(clips, h, epochs=60)
    assert sorted(r.step for r in models.collect()) == [1, 2, 3, 4]
    states = {(r.step, r.clip_id): r.label for r in progress.label_states(h).collect()}
    assert states[2, 0] == "good" and (3, 0) not in states and (4, 0) not in states
    now = clips.select("clip_id", F.when(F.col("category") == "alpha", "good").otherwise("bad").alias("label"))
    cost = {r.step: r.cost for r in progress.cost_over_time(clips, models, now).collect()}
    assert cost[4] <= 0.5
    preds = spark.createDataFrame([Row(step=0, clip_id=1, pred=True), Row(step=0, clip_id=2, pred=True), Row(step=2, clip_id=1, pred=False), Row(step=3, clip_id=1, pred=False), Row(step=3, clip_id=2, pred=False)])
    assert {r.step: (r.flips, r.common) for r in progress.flips(preds).collect()} == {0: (0, 0), 2: (1, 1), 3: (0, 1)}

"""Labelling progress: replay of the vote log, error cost and flips over time, status and advice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.operators import metrics, mlp, ranges, thresholds
from corvid.storage import durable


def steps(history: DataFrame) -> DataFrame:
    """seq, clip_id, label, step (from 0) and mark, which tells a log's beginning up to the event from any other's.

    Places and marks come from sorted ranges: no task reads the whole log."""
    placed = ranges.ranked(history.select("seq", "clip_id", "label"), [F.col("seq")], "step").withColumn("step", F.col("step") - 1)
    event = F.xxhash64("step", "clip_id", "label").cast("decimal(38,0)")
    return ranges.running(placed, [F.col("step")], {"mark": event}).select("seq", "clip_id", "label", "step", "mark")


def label_spans(placed: DataFrame) -> DataFrame:
    """clip_id, label, first, end: the steps from which and before which (null: none) a label stands, of ``steps``."""
    until = F.lead("step").over(Window.partitionBy("clip_id").orderBy("step"))
    return placed.withColumn("end", until).where("label <> 'unlabel'").select("clip_id", "label", F.col("step").alias("first"), "end")


def label_states(history: DataFrame) -> DataFrame:
    """step, clip_id, label: the labels that stand after each event of the log (steps from 0)."""
    placed = steps(history)
    last = placed.agg(F.max("step").alias("last"))
    spans = label_spans(placed).crossJoin(F.broadcast(last))
    return spans.select(F.explode(F.sequence(F.col("first"), F.coalesce(F.col("end") - 1, F.col("last")))).alias("step"), "clip_id", "label")


#: Steps that one task trains, from the labels that stand in any of them.
BLOCK = 32
MODELS = "step long, threshold double, w0 array<array<double>>, b0 array<double>, w2 array<double>, b2 double"


def replay(clips: DataFrame, history: DataFrame, inclusion: int = 0, epochs: int = mlp.EPOCHS, only: DataFrame | None = None) -> DataFrame:
    """step, threshold and weights of the model each step of the log would have trained; steps without both labels are left out.

    ``only`` (step) names the steps to train.  Steps are independent: a task gets the labels of ``BLOCK`` steps once, with
    the span each stands for, and trains those steps one after the other."""
    placed = steps(history)
    asked = placed.select("step") if only is None else placed.select("step").join(only.select("step"), "step", "left_semi")
    blocks = asked.groupBy(F.floor(F.col("step") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("step")).alias("steps"))
    last = placed.agg(F.floor(F.max("step") / BLOCK).alias("last"))
    spans = label_spans(placed).crossJoin(F.broadcast(last))
    spans = spans.select("clip_id", "label", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.coalesce(F.floor((F.col("end") - 1) / BLOCK), F.col("last")))).alias("block"))
    rows = spans.join(blocks, "block").join(clips.select("clip_id", "embedding"), "clip_id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("clip_id", ignore_index=True)
        x, good = np.stack(pdf["embedding"].to_numpy()).astype(float), (pdf["label"] == "good").to_numpy()
        first, end = pdf["first"].to_numpy(), pdf["end"].fillna(np.inf).to_numpy()
        made = []
        for step in pdf["steps"].iloc[0]:
            stands = (first <= step) & (step < end)
            y = good[stands].astype(float)
            if len(y) < 2 or y.all() or not y.any():
                continue
            m = mlp.train(x[stands], y, inclusion, epochs=epochs)
            made.append({"step": int(step), "threshold": thresholds.optimal_threshold_np(m.score(x[stands]), y, inclusion), **m.as_row()})
        return pd.DataFrame(made, columns=["step", "threshold", "w0", "b0", "w2", "b2"])

    return rows.groupBy("block").applyInPandas(fit, MODELS)


class ReplayCache:
    """Models of replayed steps, kept below ``path``: a log that has grown trains its new steps alone.

    A step is known by its mark (of the log up to it), the inclusion and the epochs; a log that was cleared or began in
    another way has other marks, so old models are not found.  Each call appends the steps it trained as one write, those
    without both labels too (threshold null), and a lost driver leaves whole writes only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _stored(self, inclusion: int, epochs: int) -> DataFrame:
        schema = f"mark decimal(38,0), {MODELS}, inclusion int, epochs int"
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
        rows = self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)
        return rows.where((F.col("inclusion") == inclusion) & (F.col("epochs") == epochs)).drop("inclusion", "epochs")

    def replay(self, clips: DataFrame, history: DataFrame, inclusion: int = 0, epochs: int = mlp.EPOCHS) -> DataFrame:
        """What ``replay`` gives, training only steps that no earlier call has trained."""
        marks = durable(steps(history).select("step", "mark"), "replay-marks")
        unseen = durable(marks.join(self._stored(inclusion, epochs), ["step", "mark"], "left_anti"), "replay-unseen")
        if not unseen.isEmpty():
            found = unseen.join(replay(clips, history, inclusion, epochs, unseen), "step", "left")
            found.withColumns({"inclusion": F.lit(inclusion), "epochs": F.lit(epochs)}).write.mode("append").parquet(self.path)
        return self._stored(inclusion, epochs).join(marks, ["step", "mark"], "left_semi").where("threshold is not null").drop("mark").dropDuplicates(["step"])

    def clear(self) -> None:
        """Forget every model, as when votes or clips are cleared."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def predictions(clips: DataFrame, models: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """step, clip_id, score, pred of every model of a replay over the clips (``only``: step, clip_id to keep out)."""
    named = models.select(F.col("step").cast("string").alias("name"), "threshold", "w0", "b0", "w2", "b2")
    from corvid.operators.search import detector_scores

    scored = detector_scores(clips, named).select(F.col("detector").cast("long").alias("step"), "clip_id", F.col("raw").alias("score"), (F.col("raw") >= F.col("threshold")).alias("pred"))
    return scored if only is None else scored.join(only, ["step", "clip_id"], "left_anti")


def flips(preds: DataFrame) -> DataFrame:
    """step, flips, common: changed predictions between consecutive predicted steps, over clips predicted in both."""
    order = preds.select("step").distinct().withColumn("n", F.row_number().over(Window.orderBy("step")))
    by_clip = Window.partitionBy("clip_id").orderBy("n")
    changed = preds.join(F.broadcast(order), "step").select("step", "n", "pred", F.lag("pred").over(by_clip).alias("p0"), F.lag("n").over(by_clip).alias("n0"))
    both = F.col("n0") == F.col("n") - 1
    return changed.groupBy("step").agg(F.count_if(both & (F.col("pred") != F.col("p0"))).alias("flips"), F.count_if(both).alias("common"))


def cost_over_time(clips: DataFrame, models: DataFrame, labels: DataFrame, inclusion: int = 0) -> DataFrame:
    """step, cost, fpr, fnr of every model on the labels that stand now."""
    current = clips.join(labels.select("clip_id", "label"), "clip_id")
    preds = predictions(current, models).join(labels.select("clip_id", (F.col("label") == "good").alias("truth")), "clip_id")
    return metrics.error_cost(preds, inclusion, ("step",))


def stability(clips: DataFrame, models: DataFrame, history: DataFrame) -> DataFrame:
    """step, flips, common of a replay: predictions of the clips that carry no label at the step."""
    return flips(predictions(clips, models, label_states(history).select("step", "clip_id")))


def model_at(clips: DataFrame, history: DataFrame, step: int, inclusion: int = 0, epochs: int = mlp.EPOCHS) -> tuple[mlp.Mlp | None, float | None, list[int], list[int]]:
    """Network, threshold, good and bad ids after event ``step`` (from 0) of the log; no network outside the log or without both labels.

    Only the labels that stand at that step train, a set of human size."""
    if step < 0 or step >= history.count():
        return None, None, [], []
    past = history.orderBy("seq").limit(step + 1)
    votes = past.groupBy("clip_id").agg(F.max_by("label", "seq").alias("label")).where("label <> 'unlabel'")
    rows = votes.join(clips.select("clip_id", "embedding"), "clip_id").orderBy("clip_id").collect()
    good, bad = ([r["clip_id"] for r in rows if r["label"] == side] for side in ("good", "bad"))
    if not good or not bad:
        return None, None, good, bad
    x, y = np.array([r["embedding"] for r in rows], float), np.array([r["label"] == "good" for r in rows], float)
    m = mlp.train(x, y, inclusion, epochs=epochs)
    return m, thresholds.optimal_threshold_np(m.score(x), y, inclusion), good, bad


def report(clips: DataFrame, history: DataFrame, inclusion: int = 0, epochs: int = mlp.EPOCHS) -> DataFrame:
    """step, cost, fpr, fnr, flips, common, total_labels, total_clips of the whole log: error cost on the labels that stand
    now and changed predictions, a row for each step that has a model.  Models are trained once and written."""
    from corvid.operators.labels import current

    models = durable(replay(clips, history, inclusion, epochs), "replay")
    now = current(history)
    costs, moved = cost_over_time(clips, models, now, inclusion), stability(clips, models, history)
    totals = now.agg(F.count(F.lit(1)).alias("total_labels")).crossJoin(clips.agg(F.count(F.lit(1)).alias("total_clips")))
    return models.select("step").join(costs, "step", "left").join(moved, "step", "left").crossJoin(totals)


def status(costs: DataFrame, n_good: int, n_bad: int, n_steps: int) -> DataFrame:
    """status (red, yellow, green) and slope: whether error still falls over the last ten steps."""
    recent = costs.where(F.col("cost").isNotNull() & (F.col("step") >= n_steps - 10))
    base = recent.agg(F.count(F.lit(1)).alias("valid"), F.expr("regr_slope(cost, CAST(step AS DOUBLE))").alias("k"), F.avg("cost").alias("mean"))
    slope = F.round(F.when(F.coalesce("mean", F.lit(0.0)) > 0, F.coalesce("k", F.lit(0.0)) / F.col("mean")).otherwise(0.0), 4)
    red = n_good + n_bad < 20 or n_good < 5 or n_bad < 5
    return base.withColumn("slope", slope).select(
        F.when(F.lit(red), "red").when(F.lit(n_steps < 3) | (F.col("valid") < 3) | (F.col("slope") < -0.015), "yellow").otherwise("green").alias("status"), "slope"
    )


#: Steps whose error tells whether it still falls.
RECENT = 10


def status_of(costs: list[tuple[int, float]], n_good: int, n_bad: int, n_steps: int) -> tuple[str, float]:
    """``status`` from the (step, cost) pairs of the last ``RECENT`` steps, for callers that keep them: the same advice."""
    x, y = np.array([s for s, _ in costs], float), np.array([c for _, c in costs], float)
    slope = 0.0
    if len(x) > 1 and y.mean() > 0:
        slope = float(np.round(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum() / y.mean(), 4))
    if n_good + n_bad < 20 or n_good < 5 or n_bad < 5:
        return "red", slope
    return ("yellow" if n_steps < 3 or len(x) < 3 or slope < -0.015 else "green"), slope


def recommendation(series: DataFrame) -> DataFrame:
    """advice from a series (step, cost, flips): keep, stop, consider or stable, by its last 30 %."""
    n = series.agg(F.count(F.lit(1)).alias("n"))
    placed = series.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("step")))).crossJoin(F.broadcast(n))
    last = placed.where(F.col("rn") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.3)))
    agg = last.agg(F.max("n").alias("n"), (F.max("cost") - F.min("cost")).alias("span"), F.avg("cost").alias("mean"), F.avg("flips").alias("flips"))
    spread = F.when(F.col("mean") > 0, F.col("span") / F.col("mean")).otherwise(0.0)
    return agg.select(
        F.when(F.coalesce("n", F.lit(0)) < 5, "keep").when((spread < 0.1) & (F.col("flips") < 5), "stop").when(spread < 0.15, "consider").when(F.col("flips") < 3, "stable").otherwise("keep").alias("advice")
    )

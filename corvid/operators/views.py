"""What a session shows: rankings with their clips, stripes, media by id, progress with its remaining time, chart frames."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import scalars as S
from corvid.operators import metrics, ranges
from corvid.registry import StatusTracker
from corvid.storage import bucketed, buckets


def ranked_clips(ranking: DataFrame, clips: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """``ranking`` (clip_id and more) joined to ``clips``, with ``rank`` from 1 in its order; entries without a clip are left out first.

    Places come from sorted ranges, so the order is kept by a column and no task sorts all rows."""
    order = order or [F.desc("score"), F.col("clip_id")]
    more = [c for c in clips.columns if c == "clip_id" or c not in ranking.columns]
    return ranges.ranked(ranking.join(clips.select(*more), "clip_id"), order, "rank")


def stripes(ranked: DataFrame, n: int = 100) -> DataFrame:
    """``ranked`` (rank from 1 without gaps) with ``position`` (share of the list before it) and ``stripe``, of ``n`` stripes from 1.

    The first stripes are one longer where the list can't be divided, as by ntile."""
    total = ranked.agg(F.max("rank").alias("__n"))
    at = ranked.crossJoin(F.broadcast(total))
    small = F.floor(F.col("__n") / n)
    long = F.col("__n") % n
    in_long = F.col("rank") <= long * (small + 1)
    stripe = F.when(in_long, F.floor((F.col("rank") - 1) / (small + 1)) + 1).otherwise(long + F.floor((F.col("rank") - 1 - long * (small + 1)) / F.greatest(small, F.lit(1))) + 1)
    return at.withColumns({"position": (F.col("rank") - 1) / F.col("__n"), "stripe": stripe.cast("int")}).drop("__n")


def stripe_marks(striped: DataFrame, votes: DataFrame) -> DataFrame:
    """stripe, n, good, bad: how many clips of each stripe carry which label (votes: clip_id, label)."""
    labelled = striped.select("clip_id", "stripe").join(votes.select("clip_id", "label"), "clip_id", "left")
    return labelled.groupBy("stripe").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "good").alias("good"), F.count_if(F.col("label") == "bad").alias("bad"))


class Media:
    """Media by id: clips in buckets of their id, so that one lookup reads one bucket's files.  MIME types stand beside the bytes."""

    def __init__(self, clips: DataFrame):
        rows = clips.select("clip_id", "type", "filename", S.mime_type(F.col("filename")).alias("mime"), "clip_bytes", "clip_string")
        # dealt as the buckets are, so that each bucket is one file
        self.table = bucketed(rows.repartition(buckets(clips.sparkSession), "clip_id"), "media", "clip_id")

    def find(self, clip_id: int) -> DataFrame:
        return self.table.where(F.col("clip_id") == clip_id)


def eta_text(seconds: Column) -> Column:
    """The remaining time in words, from seconds."""
    minutes = lambda s: F.floor(s / 60 + 0.5).cast("int").cast("string")
    hours, rest = F.floor(seconds / 3600).cast("int"), seconds % 3600
    hour = F.when(F.floor(rest / 60 + 0.5) > 0, F.concat(F.lit("About 1 hour "), minutes(rest), F.lit(" minutes remaining"))).otherwise("About 1 hour remaining")
    return (
        F.when(seconds < 5, "Less than 5 seconds remaining").when(seconds < 30, "Less than 30 seconds remaining").when(seconds < 60, "Less than a minute remaining")
        .when(seconds < 90, "About a minute remaining").when(seconds < 3600, F.concat(F.lit("About "), minutes(seconds), F.lit(" minutes remaining")))
        .when(hours == 1, hour).otherwise(F.concat(F.lit("About "), hours.cast("string"), F.lit(" hours remaining")))
    )


def with_eta(progress: DataFrame) -> DataFrame:
    """``progress`` (current, total, elapsed seconds) with percent, rate, seconds_left and eta; null where nothing is known yet."""
    known = (F.col("current") > 0) & (F.col("total") > 0) & (F.col("elapsed") > 0)
    left = F.when(known, F.greatest(F.lit(0.0), (F.col("total") - F.col("current")) * F.col("elapsed") / F.col("current")))
    done = F.when(F.col("total") > 0, F.least(F.lit(100.0), F.round(100.0 * F.col("current") / F.col("total"), 1)))
    return progress.withColumns({"percent": done, "rate": F.when(known, F.col("current") / F.col("elapsed")), "seconds_left": left}).withColumn("eta", eta_text(F.col("seconds_left")))


@contextmanager
def watched(spark: SparkSession, tracker: StatusTracker, status: str, message: str = "", every: float = 0.1) -> Iterator[StatusTracker]:
    """Runs the jobs of its block as one group and tells ``tracker`` how many of their tasks are done, until they end or fail."""
    context, group, over = spark.sparkContext, f"corvid-{uuid.uuid4().hex}", threading.Event()

    def look() -> None:
        jobs = context.statusTracker()
        while not over.wait(every):
            stages = {s for j in jobs.getJobIdsForGroup(group) if (job := jobs.getJobInfo(j)) for s in job.stageIds}
            found = [i for s in stages if (i := jobs.getStageInfo(s))]
            if found:
                tracker.update(status, message, sum(i.numCompletedTasks for i in found), sum(i.numTasks for i in found))

    tracker.update(status, message)
    context.setJobGroup(group, message or status)
    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield tracker
    except Exception as error:
        tracker.update("idle", error=str(error).split("\n")[0])
        raise
    else:
        tracker.update("idle", message)
    finally:
        over.set()
        thread.join()
        context.setLocalProperty("spark.jobGroup.id", None)


# frames behind the charts of an evaluation: per_query has dataset, query, average_precision, p_at_k, r_at_k; learned has dataset, category, accuracy, precision, recall, f1


def map_by_dataset(per_query: DataFrame) -> DataFrame:
    """dataset, mean_ap, in falling order of place: ``ord`` from 1."""
    return ranges.ranked(metrics.mean_average_precision(per_query, ("dataset",)), [F.desc("mean_ap"), F.col("dataset")], "ord")


def ap_by_query(per_query: DataFrame) -> DataFrame:
    """dataset, query, average_precision, with ``ord`` within the dataset, best first."""
    return ranges.ranked(per_query.select("dataset", "query", "average_precision"), [F.desc("average_precision"), F.col("query")], "ord", ("dataset",))


def at_k(per_query: DataFrame, kind: str = "p", k_values: tuple[int, ...] = metrics.K_VALUES) -> DataFrame:
    """dataset, k, mean: mean precision (``p``) or recall (``r``) at each k over a dataset's queries."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"{kind}_at_{k}").alias("v")) for k in k_values])).alias("x")
    return per_query.select("dataset", each).groupBy("dataset", F.col("x.k").alias("k")).agg(F.avg("x.v").alias("mean"))


def f1_by_category(learned: DataFrame) -> DataFrame:
    """dataset, category, f1, with ``ord`` within the dataset, best first."""
    return ranges.ranked(learned.select("dataset", "category", "f1"), [F.desc("f1"), F.col("category")], "ord", ("dataset",))


def metrics_breakdown(learned: DataFrame) -> DataFrame:
    """dataset, metric, mean of accuracy, precision, recall and f1 over a dataset's categories."""
    names = ("accuracy", "precision", "recall", "f1")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("x")
    return learned.select("dataset", each).groupBy("dataset", F.col("x.metric").alias("metric")).agg(F.avg("x.v").alias("mean"))


def rates_over_steps(iterations: DataFrame) -> DataFrame:
    """dataset, category, t, fpr_mean, fnr_mean and their spreads over seeds."""
    spread = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return iterations.groupBy("dataset", "category", "t").agg(F.avg("fpr").alias("fpr_mean"), spread("fpr").alias("fpr_std"), F.avg("fnr").alias("fnr_mean"), spread("fnr").alias("fnr_std"))


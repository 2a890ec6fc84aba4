"""Ranking and classification metrics as windows and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.scalars import inclusion_weights
from corvid.functions.vectors import cosine
from corvid.operators.ranges import running

K_VALUES = (5, 10, 20)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def ranking_metrics(ranked: DataFrame, keys: tuple[str, ...] = ("query",), k_values: tuple[int, ...] = K_VALUES, relevant: DataFrame | None = None) -> DataFrame:
    """average_precision, p_at_k and r_at_k of ranked lists (keys, rk from 1, rel 0/1).

    The divisor is the number of relevant items: that of ``relevant`` (keys, n_relevant) if given, else those ranked.  Hits so
    far come from sorted ranges, unless ``ranked`` has them as ``hits``: no list is one task's work."""
    rel = F.col("rel").cast("double")
    steps = ranked if "hits" in ranked.columns else running(ranked, [F.col("rk")], {"hits": rel}, keys)
    at_k = [F.sum(F.when(F.col("rk") <= k, rel).otherwise(0.0)).alias(f"__{k}") for k in k_values]
    sums = steps.groupBy(*keys).agg(F.sum(F.when(rel == 1, F.col("hits") / F.col("rk")).otherwise(0.0)).alias("__ap"), F.sum(rel).alias("__n"), *at_k)
    if relevant is not None:
        sums = sums.drop("__n").join(relevant.select(*keys, F.col("n_relevant").cast("double").alias("__n")), list(keys), "left").fillna(0.0, ["__n"])
    return sums.select(
        *keys, ratio(F.col("__ap"), F.col("__n")).alias("average_precision"),
        *[(F.col(f"__{k}") / F.lit(float(k))).alias(f"p_at_{k}") for k in k_values], *[ratio(F.col(f"__{k}"), F.col("__n")).alias(f"r_at_{k}") for k in k_values],
    )


def text_sort_eval(clips: DataFrame, queries: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """Ranking metrics of every query (query, vector, category) over all clips, in one plan.

    The query catalogue is a short list kept by hand and is broadcast; ranking is by unrounded similarity."""
    q = queries.select("query", F.col("vector").alias("__v"), F.col("category").alias("target"))
    scored = clips.select("clip_id", "category", "embedding").crossJoin(F.broadcast(q)).select(
        "query", "clip_id", (F.col("category") == F.col("target")).cast("int").alias("rel"), cosine(F.col("embedding"), F.col("__v")).alias("sim")
    )
    placed = running(scored, [F.desc("sim"), F.col("clip_id")], {"rk": F.lit(1).cast("long"), "hits": F.col("rel").cast("double")}, ("query",))
    return ranking_metrics(placed, ("query",), k_values)


def mean_average_precision(per_query: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return per_query.groupBy(*keys).agg(F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("mean_ap"))


def confusion(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn of rows (pred, truth: booleans)."""
    p, t = F.col("pred"), F.col("truth")
    return rows.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))


def binary_metrics(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, precision, recall and f1, 0 where a divisor is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion(rows, keys).select(
        *keys, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def error_cost(rows: DataFrame, inclusion: int = 0, keys: tuple[str, ...] = (), places: int = 4) -> DataFrame:
    """fpr, fnr and their inclusion-weighted sum."""
    wf, wn = inclusion_weights(inclusion)
    fpr, fnr = ratio(F.col("fp"), F.col("fp") + F.col("tn")), ratio(F.col("fn"), F.col("fn") + F.col("tp"))
    return confusion(rows, keys).select(*keys, F.round(wf * fpr + wn * fnr, places).alias("cost"), F.round(fpr, places).alias("fpr"), F.round(fnr, places).alias("fnr"))


def mean_and_spread(frame: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Mean and sample standard deviation by key, 0 for a single row."""
    return frame.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))

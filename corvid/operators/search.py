"""Ranking items: similarity search, detectors over whole collections, hits and their counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.vectors import cosine, vector_literal
from corvid.operators import mlp, thresholds
from corvid.operators.ranges import ranked


def similarity(clips: DataFrame, query, column: str = "embedding") -> DataFrame:
    """``clips`` with ``raw``, the cosine with the query vector, and ``similarity``, rounded to four places."""
    q = query if isinstance(query, Column) else vector_literal(query)
    return clips.withColumn("raw", cosine(F.col(column), q)).withColumn("similarity", F.round("raw", 4))


def text_sort(clips: DataFrame, query, limit: int | None = None) -> DataFrame:
    """clip_id, similarity by falling rounded similarity, ties by id; ``limit`` keeps the first rows only (a top-k plan)."""
    out = similarity(clips, query).select("clip_id", "similarity").orderBy(F.desc("similarity"), "clip_id")
    return out if limit is None else out.limit(limit)


def search_threshold(clips: DataFrame, query) -> float:
    """The mixture threshold of a search's similarities."""
    return thresholds.mixture_threshold(similarity(clips, query), "similarity")


def example_sort(clips: DataFrame, example: DataFrame, limit: int | None = None) -> DataFrame:
    """text_sort with the embedding of the one row of ``example`` as query."""
    one = example.select(F.col("embedding").alias("__q")).limit(1)
    out = clips.crossJoin(F.broadcast(one)).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("__q")), 4))
    out = out.select("clip_id", "similarity").orderBy(F.desc("similarity"), "clip_id")
    return out if limit is None else out.limit(limit)


def detector_scores(clips: DataFrame, detectors: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """clip_id, detector, raw, threshold (and ``columns``) for every clip and detector of the clips' media type.

    The registry is read once on the driver and broadcast; each Arrow batch is stacked once and run through all
    networks, so the embeddings are read once whatever the number of detectors."""
    models = [(r["name"], float(r["threshold"]), mlp.Mlp.from_row(r)) for r in detectors.orderBy("name").collect()]
    shared = clips.sparkSession.sparkContext.broadcast(models)
    slim = clips.select("clip_id", "embedding", *columns)
    extra = "".join(f", `{c}` {slim.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(float)
            for name, threshold, model in shared.value:
                yield pdf[["clip_id", *columns]].assign(detector=name, raw=model.score(x), threshold=threshold)

    return slim.mapInPandas(run, f"clip_id long{extra}, detector string, raw double, threshold double")


def hits(scores: DataFrame) -> DataFrame:
    """Rows at or above their detector's threshold (raw against raw), with ``score`` rounded to four places and ``rank``.

    Ranks come from sorted ranges, so the hits of one detector are many tasks' work."""
    found = scores.where(F.col("raw") >= F.col("threshold")).withColumn("score", F.round("raw", 4))
    return ranked(found, [F.desc("score"), F.col("clip_id")], "rank", ("detector",)).withColumn("rank", F.col("rank").cast("int"))


def hit_counts(scores: DataFrame, detectors: DataFrame) -> DataFrame:
    """detector, total_hits of every detector, those without a hit included; one row per detector is all that is shuffled back."""
    counts = scores.where(F.col("raw") >= F.col("threshold")).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    return detectors.select(F.col("name").alias("detector")).join(counts, "detector", "left").select("detector", F.coalesce("n", F.lit(0)).cast("long").alias("total_hits"))


def hit_rows(hit: DataFrame, clips: DataFrame) -> DataFrame:
    """Hits with the default file name and category of an export."""
    named = clips.select("clip_id", "filename", "category", "origin", "origin_name", "md5")
    return hit.join(named, "clip_id").select(
        "detector", "threshold", "rank", "clip_id", F.coalesce("filename", F.concat(F.lit("clip_"), F.col("clip_id").cast("string"))).alias("filename"),
        F.coalesce("category", F.lit("unknown")).alias("category"), "score", "origin", "origin_name", "md5",
    )


def results_document(hit: DataFrame, detectors: DataFrame) -> DataFrame:
    """detector, threshold, total_hits and hits (array in rank order) per detector, for nested sinks; nest only result-sized frames."""
    nested = hit.groupBy("detector").agg(F.array_sort(F.collect_list(F.struct("rank", "clip_id", "score"))).alias("hits"))
    none = F.array().cast("array<struct<rank:int,clip_id:bigint,score:double>>")
    return detectors.select(F.col("name").alias("detector"), "threshold").join(nested, "detector", "left").select(
        "detector", "threshold", F.size(F.coalesce("hits", none)).alias("total_hits"), F.coalesce("hits", none).alias("hits")
    )


def training_rows(clips: DataFrame, votes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the votes (clip_id, label) whose clip is loaded: human-scale, collected in id order."""
    rows = votes.join(clips.select("clip_id", "embedding"), "clip_id").where(F.col("label").isin("good", "bad")).orderBy(F.desc("label"), "clip_id").collect()
    return np.array([r["embedding"] for r in rows], float), np.array([r["label"] == "good" for r in rows], float)


def learned_sort(
    clips: DataFrame, votes: DataFrame, inclusion: int = 0, safe: bool = False, count: int = 2, fraction: float = 0.5, seed: int = 42, epochs: int = mlp.EPOCHS
) -> tuple[DataFrame, float, mlp.Mlp]:
    """Clips by falling raw score of a network trained on the votes, with its threshold and the network.

    Raises ValueError unless both classes are there.  ``safe`` blends the cross-calibrated threshold with the
    mixture threshold of all scores."""
    x, y = training_rows(clips, votes)
    if not (y == 1).any() or not (y == 0).any():
        raise ValueError("votes of both kinds are needed")
    threshold = thresholds.cross_calibrated_np(x, y, inclusion, seed, count, fraction, epochs)
    model = mlp.train(x, y, inclusion, epochs=epochs)
    ranked = mlp.scored(clips.select("clip_id", "embedding"), model).select("clip_id", "raw_score", F.round("raw_score", 4).alias("score"))
    if safe:
        threshold = thresholds.blended(threshold, thresholds.mixture_threshold(ranked, "raw_score"), len(y))
    return ranked.orderBy(F.desc("raw_score"), "clip_id"), threshold, model


def next_clip_hard(ranked: DataFrame, labelled: DataFrame, threshold: float) -> DataFrame:
    """The unlabelled clip whose place is nearest to the threshold's place; ties by score distance, then place.

    It is the last open clip at or above the threshold or the first one below it: two top-1 plans, and one count
    of the rows before each, so the collection is never sorted as a whole."""
    open_ = ranked.join(labelled.select("clip_id"), "clip_id", "left_anti").select("clip_id", "score")
    above = open_.where(F.col("score") >= threshold).orderBy("score", F.desc("clip_id")).limit(1)
    below = open_.where(F.col("score") < threshold).orderBy(F.desc("score"), "clip_id").limit(1)
    two = above.unionByName(below).select(F.col("clip_id").alias("id"), F.col("score").alias("s"))
    before = (F.col("score") > F.col("s")) | (F.col("score") == F.col("s")) & (F.col("clip_id") < F.col("id"))
    placed = ranked.select("clip_id", "score").crossJoin(F.broadcast(two)).groupBy("id", "s").agg(
        F.count_if(before).alias("idx"), F.count_if(F.col("score") >= threshold).alias("t")
    )
    best = placed.orderBy(F.abs(F.col("idx") - F.col("t")), F.abs(F.col("s") - threshold), "idx").limit(1)
    return best.select(F.col("id").alias("clip_id"), F.col("s").alias("score"), F.col("idx").cast("long").alias("idx"))


def next_clip_top(ranked: DataFrame, labelled: DataFrame) -> DataFrame:
    """The best-ranked unlabelled clip."""
    return ranked.join(labelled.select("clip_id"), "clip_id", "left_anti").orderBy(F.desc("score"), "clip_id").limit(1).select("clip_id", "score")

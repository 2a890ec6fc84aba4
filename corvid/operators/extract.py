"""Extractors: table functions that give several findings a clip."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTRACTION = "struct<confidence:double,bbox:array<double>,label:string>"


def by_confidence(found: Column) -> Column:
    """Findings by falling confidence, ties by label, then box."""
    keyed = F.transform(found, lambda e: F.struct((-e["confidence"]).alias("k"), e["label"].alias("l"), e["bbox"].alias("b"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def of_class(found: Column, label: str, least: float) -> Column:
    """Findings of one class at or above a confidence, rounded (confidence to four, boxes to two places) and sorted."""
    kept = F.filter(found, lambda e: (e["label"] == label) & (e["confidence"] >= least))
    neat = F.transform(kept, lambda e: F.struct(F.round(e["confidence"], 4).alias("confidence"), F.transform(e["bbox"], lambda x: F.round(x, 2)).alias("bbox"), e["label"].alias("label")))
    return by_confidence(neat)


def detected(clips: DataFrame, make: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """clip_id, found: all detections of a model in the clip's bytes; clips without bytes have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield pd.DataFrame({"clip_id": pdf["clip_id"], "found": [model(bytes(b)) if b is not None else [] for b in pdf["clip_bytes"]]})

    return clips.select("clip_id", "clip_bytes").mapInPandas(run, f"clip_id long, found array<{EXTRACTION}>")


def extract(found: DataFrame, extractors: DataFrame, media_type: str) -> DataFrame:
    """extractor, clip_id, confidence, bbox, label of all extractors (name, media_type, target_class, threshold) of a media type.

    The extractor registry is a short hand-made list and is broadcast."""
    chosen = extractors.where(F.col("media_type") == media_type).select(F.col("name").alias("extractor"), "target_class", "threshold")
    each = found.select("clip_id", F.explode("found").alias("e")).join(F.broadcast(chosen), F.col("e.label") == F.col("target_class"))
    return each.where(F.col("e.confidence") >= F.col("threshold")).select(
        "extractor", "clip_id", F.round("e.confidence", 4).alias("confidence"), F.transform("e.bbox", lambda x: F.round(x, 2)).alias("bbox"), F.col("e.label").alias("label")
    )


def run(clips: DataFrame, makers: dict[str, Callable[[], "object"]], columns: tuple[str, ...] = ("clip_bytes",)) -> DataFrame:
    """extractor, clip_id, confidence, bbox, label of every extractor over every clip: each is built and loaded once a task
    and its ``extract`` is given the clip's ``columns`` and id; clips without a finding give no row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {name: make() for name, make in makers.items()}
        for e in ready.values():
            e.load_model()
        for pdf in batches:
            rows = [
                (name, clip["clip_id"], float(f["confidence"]), [float(b) for b in f.get("bbox") or []], str(f["label"]))
                for clip in pdf.to_dict("records") for name, e in ready.items() for f in e.extract(clip)
            ]
            yield pd.DataFrame(rows, columns=["extractor", "clip_id", "confidence", "bbox", "label"])

    return clips.select("clip_id", *columns).mapInPandas(work, "extractor string, clip_id long, confidence double, bbox array<double>, label string")

"""From labels to detectors: labels of loaded clips or of files, a trained network, and what is ranked with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import labels as L
from corvid.operators import mlp, search, thresholds
from corvid.operators.embed import Embedder, embed_query, embedded
from corvid.schema import DETECTORS
from corvid.storage import ship

#: Labelled rows one network is trained on at most; more raise ValueError, none are dropped.
MOST = 100_000


@dataclass
class Trained:
    """A network, its threshold, and how many entries trained it or could not."""

    model: mlp.Mlp
    threshold: float
    loaded: int
    skipped: int

    def row(self, spark: SparkSession, name: str, media_type: str) -> DataFrame:
        """The detector as a row of the detector table."""
        own = self.model.as_row()
        return spark.createDataFrame([(name, media_type, own["w0"], own["b0"], own["w2"], own["b2"], self.threshold, None)], DETECTORS)


def matched(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """entry_id, clip_id, label of entries with a valid label (any case) and a match that has a vector: the first match trains."""
    first = L.first_match(L.resolve(entries, clips))
    rows = entries.select("entry_id", F.lower("label").alias("label")).where(L.valid(F.col("label"))).join(first, "entry_id")
    return rows.join(clips.where("embedding is not null").select("clip_id"), "clip_id", "left_semi").select("entry_id", "clip_id", "label")


def fit(rows: DataFrame, n_entries: int, inclusion: int = 0, count: int = 2, fraction: float = 0.5, seed: int = 42, epochs: int = mlp.EPOCHS) -> Trained:
    """A network trained on ``rows`` (entry_id, label, embedding) in entry order, with its cross-calibrated threshold.

    ValueError below two rows, where a class is missing, and above ``MOST`` rows: a label file is made by hand."""
    held = rows.select("entry_id", "label", "embedding").orderBy("entry_id").limit(MOST + 1).collect()
    skipped = n_entries - len(held)
    if len(held) > MOST:
        raise ValueError(f"more than {MOST} labelled rows")
    if len(held) < 2:
        raise ValueError(f"at least two labelled rows are needed: {len(held)} loaded, {skipped} skipped")
    x, y = np.array([r["embedding"] for r in held], float), np.array([r["label"] == "good" for r in held], float)
    if y.all() or not y.any():
        raise ValueError("labels of both kinds are needed")
    return Trained(mlp.train(x, y, inclusion, epochs=epochs), thresholds.cross_calibrated_np(x, y, inclusion, seed, count, fraction, epochs), len(held), skipped)


def from_labels(entries: DataFrame, clips: DataFrame, **how) -> Trained:
    """A detector from imported labels (entry_id, label, md5, origin, origin_name) of loaded clips; votes are not touched."""
    rows = matched(entries, clips).join(clips.select("clip_id", "embedding"), "clip_id")
    return fit(rows, entries.count(), **how)


def read_labelled(labels: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """entry_id, label, embedding of the files that valid entries (entry_id, path, label) name; missing or unreadable ones are left out.

    The driver holds the paths of the label file, at most ``MOST``; files are read and embedded in tasks."""
    spark = labels.sparkSession
    ship(spark)
    named = labels.where(L.valid(F.col("label")) & F.col("path").isNotNull()).select("entry_id", "label", "path")
    rows = named.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} labelled files")
    jvm, conf, full = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    for path in {r["path"] for r in rows}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if fs.isFile(at):
            full[path] = fs.makeQualified(at).toString()
    if not full:
        return spark.createDataFrame([], "entry_id long, label string, embedding array<float>")
    asked = spark.createDataFrame([(r["entry_id"], r["label"], full[r["path"]]) for r in rows if r["path"] in full], "entry_id long, label string, path string")
    content = spark.read.format("binaryFile").load(sorted(set(full.values()))).select("path", "content")
    vectors = embedded(content, make, "content").where("embedding is not null").select("path", "embedding")
    return asked.join(vectors, "path").select("entry_id", "label", "embedding")


def from_label_file(labels: DataFrame, make: Callable[[], Embedder], same_type: bool = True, **how) -> Trained:
    """A detector from a label file that names files; with ``same_type`` only files of the first entry's media type train."""
    from corvid.sources.files import trainer_rows

    return fit(read_labelled(trainer_rows(labels) if same_type else labels, make), labels.count(), **how)


def label_file_sort(clips: DataFrame, labels: DataFrame, make: Callable[[], Embedder], safe: bool = False, **how) -> tuple[DataFrame, float, Trained]:
    """Clips by falling raw score of a network trained on the files of a label file, with its threshold and the training.

    ``safe`` blends the threshold with the mixture threshold of all scores."""
    trained = from_label_file(labels, make, same_type=False, **how)
    ranking = mlp.scored(clips.select("clip_id", "embedding"), trained.model).select("clip_id", "raw_score", F.round("raw_score", 4).alias("score"))
    threshold = trained.threshold
    if safe:
        threshold = thresholds.blended(threshold, thresholds.mixture_threshold(ranking, "raw_score"), trained.loaded)
    return ranking.orderBy(F.desc("raw_score"), "clip_id"), threshold, trained


def text_search(clips: DataFrame, embedder: Embedder, text: str, media_type: str = "paragraph", enrich: bool = False, limit: int | None = None) -> tuple[DataFrame, float]:
    """The ranking of a text query (clip_id, similarity) and its mixture threshold; ValueError for an empty text or no clips."""
    vector = embed_query(embedder, text, media_type, enrich)
    if clips.isEmpty():
        raise ValueError("no clips")
    return search.text_sort(clips, vector, limit), search.search_threshold(clips, vector)

"""Collections of files that are embedded once: versions with a manifest, what has changed since, and their state.

A version holds the clips of a collection with the fingerprint (path, length, time of change, embedder) each was read
by.  Loading compares fingerprints with a listing, which reads no content, and embeds only files that are new or
changed; a version counts once it is written whole, so a lost driver leaves the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import scalars as S
from corvid.operators.datasets import category_slice, renumber
from corvid.operators.embed import Embedder, embedded
from corvid.schema import CLIPS, EXTENSIONS, ORIGIN
from corvid.sources import scans
from corvid.storage import durable, ship

#: States of a collection.
READY, NEEDS_EMBEDDING, NEEDS_FILES = "ready", "needs_embedding", "needs_files"
PRINT = ("media_path", "file_size", "modified", "embedder")


def listing(spark: SparkSession, path: str, media_type: str) -> DataFrame:
    """media_path, file_size, modified, filename, category (the folder's name) of the files below a folder; no content is read.

    A folder that isn't there lists nothing."""
    glob = "*.{" + ",".join(sorted({x for e in EXTENSIONS[media_type] for x in (e, e.upper())})) + "}"
    if not _is_there(spark, path):
        return spark.createDataFrame([], "media_path string, file_size long, modified timestamp, filename string, category string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select(
        F.col("path").alias("media_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"),
        S.basename(F.col("path")).alias("filename"), F.element_at(F.split("path", "/"), -2).alias("category"),
    )


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _is_there(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def available(spark: SparkSession, path: str) -> list[dict]:
    """name and size_mb (one decimal) of the saved datasets in a folder, by name."""
    return [{"name": p.rstrip("/").rpartition("/")[2], "size_mb": round(n / 1e6, 1)} for p, n in scans._files(path, False, "*.pkl")] if _is_there(spark, path) else []


class Collection:
    """One collection, kept below ``root`` (storage that the cluster shares) under its name."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.at = spark, name, f"{root.rstrip('/')}/{name}"
        ship(spark)

    def version(self) -> int:
        """The latest version that is whole; 0 for none."""
        fs, at = _fs(self.spark, self.at)
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max([int(n[1:]) for n in names if n[1:].isdigit() and _is_there(self.spark, f"{self.at}/{n}/_SUCCESS")], default=0)

    def stored(self) -> DataFrame | None:
        """The clips of the latest version, with the fingerprints they were read by."""
        v = self.version()
        return self.spark.read.parquet(f"{self.at}/v{v}") if v else None

    def clear(self) -> None:
        fs, at = _fs(self.spark, self.at)
        fs.delete(at, True)

    def changed(self, files: DataFrame, embedder: str) -> DataFrame:
        """Rows of a listing that no stored clip was read by."""
        held, asked = self.stored(), files.withColumn("embedder", F.lit(embedder))
        return asked if held is None else asked.join(held.select(*PRINT), list(PRINT), "left_anti")

    def load(
        self, path: str, media_type: str, make: Callable[[], Embedder], embedder: str, start: int | None = None, end: int | None = None, categories: list[str] | None = None,
    ) -> DataFrame:
        """Clips of the files below ``path``, of places ``start`` to ``end`` (exclusive) of each category by file name.

        Only files whose fingerprint is new are read and embedded; those that can't be are tried again next time.  Where
        nothing has changed the stored version is returned as it is.  Ids follow (category, file name, path)."""
        files = listing(self.spark, path, media_type)
        if end is not None:
            files = category_slice(files.withColumn("clip_id", F.col("media_path")), start or 0, end, categories).drop("clip_id", "place")
        elif categories is not None:
            files = files.where(F.col("category").isin(categories))
        new, held = self.changed(files, embedder), self.stored()
        kept = None if held is None else held.join(files.withColumn("embedder", F.lit(embedder)).select(*PRINT), list(PRINT), "left_semi").select(*held.columns)
        if held is None or not new.isEmpty() or kept.count() != held.count():
            fresh = durable(self._read(new, media_type, make, path), "embedded")  # numbering reads rows twice
            rows = fresh if kept is None else kept.drop("clip_id", "ord").unionByName(fresh)
            numbered = renumber(rows, "category", "filename", "media_path")
            numbered.withColumn("ord", F.col("clip_id")).write.parquet(f"{self.at}/v{self.version() + 1}")
            held = self.stored()
        return held.select(*[f.name for f in CLIPS.fields])

    def _read(self, files: DataFrame, media_type: str, make: Callable[[], Embedder], path: str) -> DataFrame:
        read = scans.with_content(files, "media_path", "clip_bytes").where("clip_bytes is not null")
        rows = embedded(read.withColumn("md5", F.md5("clip_bytes")), make, "clip_bytes").where("embedding is not null")
        origin = F.struct(F.lit("demo").alias("importer"), F.create_map(F.lit("name"), F.lit(self.name), F.lit("path"), F.lit(path)).cast("map<string,string>").alias("params")).cast(ORIGIN)
        rows = rows.withColumns({"type": F.lit(media_type), "duration": F.lit(0.0), "origin": origin, "origin_name": F.col("filename")})
        if media_type == "paragraph":
            text = F.decode("clip_bytes", "UTF-8")
            rows = rows.withColumns({"clip_string": text, "word_count": S.word_count(text).cast("int"), "character_count": F.char_length(text).cast("int")})
        names = [f for f in CLIPS.fields if f.name not in ("clip_id", "ord")]
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in names], "modified", "embedder")

    def state(self, path: str, media_type: str, embedder: str) -> DataFrame:
        """One row: name, media_type, state, n_files, n_embedded and size_mb of the files (one decimal).

        ``ready`` where every file is embedded as it is now, ``needs_embedding`` where one is not, ``needs_files`` without files."""
        files = listing(self.spark, path, media_type)
        todo = self.changed(files, embedder).agg(F.count(F.lit(1)).alias("todo"))
        seen = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
        state = F.when(F.col("n_files") == 0, NEEDS_FILES).when(F.col("todo") > 0, NEEDS_EMBEDDING).otherwise(READY)
        return seen.crossJoin(todo).select(
            F.lit(self.name).alias("name"), F.lit(media_type).alias("media_type"), state.alias("state"), "n_files", (F.col("n_files") - F.col("todo")).alias("n_embedded"),
            F.round(F.col("bytes") / 1e6, 1).alias("size_mb"),
        )


def session_status(clips: DataFrame, votes: DataFrame) -> DataFrame:
    """One row: loaded, num_clips, has_votes, media_type (of the first clip) of a session's clips and votes (label good or bad)."""
    counted = clips.agg(F.count(F.lit(1)).alias("num_clips"), F.min_by("type", "clip_id").alias("media_type"))
    voted = votes.agg((F.count_if(F.col("label").isin("good", "bad")) > 0).alias("has_votes"))
    return counted.crossJoin(voted).select((F.col("num_clips") > 0).alias("loaded"), "num_clips", "has_votes", "media_type")


def with_origins(clips: DataFrame, importer: str, params: dict[str, str]) -> DataFrame:
    """``clips`` whose missing origin is this one, and whose missing origin_name is the file name (or empty); others stay."""
    pairs = [F.lit(x) for kv in params.items() for x in kv]
    made = F.struct(F.lit(importer).alias("importer"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("params")).cast(ORIGIN)
    return clips.withColumns({"origin": F.coalesce("origin", made), "origin_name": F.coalesce(S.text_of("origin_name"), F.coalesce("filename", F.lit("")))})

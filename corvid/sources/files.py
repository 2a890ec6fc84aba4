"""Reading items: folders of media, archives, feeds, metadata tables, labels and detectors."""

from __future__ import annotations

import json
import math
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable
from functools import partial
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import scalars as S
from corvid.operators.datasets import renumber, with_precomputed
from corvid.operators.embed import Embedder, embedded
from corvid.schema import CLIPS, DETECTORS, EXTENSIONS, ORIGIN
from corvid.sources import scans
from corvid.storage import ship


def _shaped(df: DataFrame) -> DataFrame:
    """All columns of CLIPS, in order; those that are missing are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CLIPS.fields])


def folder(
    spark: SparkSession, path: str, media_type: str, embedder: Callable[[], Embedder] | None = None, vectors: DataFrame | None = None, origin: tuple[str, dict] | None = None,
    thin: bool = False, category: str = "custom", recursive: bool = False,
) -> DataFrame:
    """Clips of a folder, by path: files of the media type's extensions, embedded; those that can't be are skipped.

    Files of length 0 hold nothing and are not listed.  ``thin`` keeps no bytes: hashes are made from small pieces of a file, and an
    embedder is handed one file at a time.  ``vectors`` (filename, vector, md5) replace embedding and hash by base name."""
    if media_type not in EXTENSIONS:
        raise ValueError(f"unknown media type {media_type}")
    ship(spark)
    origin = origin or ("folder", {"path": path, "media_type": media_type})
    if thin:
        files = scans.scan(spark, scans.FileHashes, path, glob=_globs(media_type), recursive=recursive).select(F.col("path").alias("media_path"), F.col("length").alias("file_size"), "md5")
        return _clips(files, media_type, embedder, vectors, origin, category, "media_path")
    glob = "*.{" + ",".join(sorted({x for e in EXTENSIONS[media_type] for x in (e, e.upper())})) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select(F.col("path").alias("media_path"), F.col("length").alias("file_size"), F.md5("content").alias("md5"), F.col("content").alias("clip_bytes"))
    return _clips(files, media_type, embedder, vectors, origin, category, "clip_bytes")


def _globs(media_type: str) -> str:
    return ",".join(f"*.{e}" for e in EXTENSIONS[media_type])


def _clips(rows: DataFrame, media_type: str, embedder, vectors: DataFrame | None, origin: tuple[str, dict], category: str, content: str) -> DataFrame:
    """Clips from media_path, file_size, md5 and the column ``content``: bytes, or the path of what is not to be kept."""
    rows = rows.withColumn("filename", S.basename(F.col("media_path")))
    if embedder is not None:
        rows = embedded(rows, embedder if content == "clip_bytes" else partial(ByPath, embedder), content)
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    if vectors is not None:
        rows = with_precomputed(rows, vectors)
    if embedder is not None or vectors is not None:
        rows = rows.where("embedding is not null")
    importer, params = origin
    source = F.struct(F.lit(importer).alias("importer"), F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).cast("map<string,string>").alias("params")).cast(ORIGIN)
    rows = rows.withColumns({"type": F.lit(media_type), "category": F.lit(category), "origin": source, "origin_name": F.col("filename"), "duration": F.lit(0.0)})
    if media_type == "paragraph" and content == "clip_bytes":
        text = F.decode("clip_bytes", "UTF-8")
        rows = rows.withColumns({"clip_string": text, "word_count": S.word_count(text).cast("int"), "character_count": F.char_length(text)})
    out = renumber(rows, "media_path")
    return _shaped(out.withColumn("ord", F.col("clip_id")))


class ByPath:
    """An embedder of files that it opens itself, one at a time."""

    def __init__(self, make: Callable[[], Embedder]):
        self.own = make()
        self.dim = self.own.dim

    def embed_text(self, path: str) -> np.ndarray | None:
        system, inner = scans.opened(path)
        with system.open_input_stream(inner, compression=None) as f:
            return self.own.embed_media(f.read())

    def embed_media(self, content: bytes) -> np.ndarray | None:
        return self.own.embed_media(content)


def listing(spark: SparkSession, path: str, media_type: str) -> DataFrame:
    """path, length of the media files of a folder; no content is read."""
    glob = "*.{" + ",".join(EXTENSIONS[media_type]) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")


def category_folders(spark: SparkSession, path: str, categories: list[str], media_type: str) -> DataFrame:
    """filename, category, media_path of files in named subfolders; of equal base names the last path stays."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS[media_type]) + "}").load(f"{path.rstrip('/')}/*/*").select("path")
    parts = F.split("path", "/")
    named = files.select(F.col("path").alias("media_path"), S.basename(F.col("path")).alias("filename"), F.element_at(parts, -2).alias("category"))
    return named.where(F.col("category").isin(categories)).groupBy("filename").agg(F.max_by("category", "media_path").alias("category"), F.max("media_path").alias("media_path"))


def archive(spark: SparkSession, path: str, to: str, media_type: str, embedder: Callable[[], Embedder] | None = None, **kw) -> DataFrame:
    """Clips of a local zip or tar archive, unpacked into a new folder under ``to`` (shared storage) and read with subfolders.

    Member names that lead outside the folder are refused."""
    target = Path(to) / re.sub(r"\W+", "_", Path(path).name)
    target.mkdir(parents=True, exist_ok=False)
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            if any(not (target / n).resolve().is_relative_to(target.resolve()) for n in z.namelist()):
                raise ValueError("the archive leads outside its folder")
            z.extractall(target)
    elif tarfile.is_tarfile(path):
        with tarfile.open(path) as t:
            t.extractall(target, filter="data")
    else:
        raise ValueError("neither zip nor tar")
    return folder(spark, str(target), media_type, embedder, origin=("http_archive", {"url": path, "media_type": media_type}), recursive=True, **kw)


def archive_scan(spark: SparkSession, path: str, media_type: str, embedder: Callable[[], Embedder] | None = None, vectors: DataFrame | None = None, thin: bool = False, category: str = "custom") -> DataFrame:
    """Clips of the zip and tar archives at ``path`` (one, or a folder of them), read by tasks where they lie; nothing is unpacked.

    A zip or plain tar is many tasks' work, a packed tar one's.  ``media_path`` is archive!member.  Members of length 0
    are left out; a name that leads outside the archive raises an error."""
    if media_type not in EXTENSIONS:
        raise ValueError(f"unknown media type {media_type}")
    members = scans.scan(spark, scans.ArchiveMembers, path, glob=_globs(media_type))
    rows = members.select(
        F.concat("archive", F.lit("!"), "member").alias("media_path"), F.col("length").alias("file_size"), F.md5("content").alias("md5"), F.col("content").alias("clip_bytes")
    )
    clips = _clips(rows, media_type, embedder, vectors, ("http_archive", {"url": path, "media_type": media_type}), category, "clip_bytes")
    return clips.withColumns({"clip_bytes": F.lit(None).cast("binary"), "clip_string": F.lit(None).cast("string")}) if thin else clips


def feed_items(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """title, url, filename of the enclosures of an RSS or Atom file, in feed order; ``limit`` 0 takes all."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    place = F.monotonically_increasing_id().alias("__row")
    rss = read("item", "title string, enclosure struct<_url:string,_type:string>").select("title", F.col("enclosure._url").alias("url"), place)
    linked = read("entry", "title string, link array<struct<_rel:string,_href:string>>").select("title", "link", place)
    atom = linked.select("title", F.get(F.filter("link", lambda x: x["_rel"] == "enclosure"), 0)["_href"].alias("url"), "__row")
    urls = rss.unionByName(atom).where("url is not null").withColumn("filename", S.url_filename(F.col("url"))).orderBy("__row")
    return (urls.limit(limit) if limit else urls).drop("__row")


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """filename, fold, target, category, esc10, src_file, take of a sound-collection table."""
    raw = spark.read.csv(path, header=True, schema="filename string, fold string, target string, category string, esc10 string, src_file string, take string")
    return raw.select("filename", F.col("fold").cast("int").alias("fold"), F.col("target").cast("int").alias("target"), "category", (F.col("esc10") == "True").alias("esc10"), "src_file", "take")


def image_batch(rows: DataFrame) -> DataFrame:
    """Images (n x 3072 bytes, planes of red, green and blue) as pixels height x width x channel, flattened."""

    def run(batches):
        for pdf in batches:
            planes = np.stack([np.frombuffer(b, np.uint8) for b in pdf["data"]]).reshape(-1, 3, 32, 32).transpose(0, 2, 3, 1)
            yield pd.DataFrame({"image_id": pdf["image_id"], "label": pdf["label"], "pixels": [p.tobytes() for p in planes]})

    return rows.select("image_id", "label", "data").mapInPandas(run, "image_id long, label int, pixels binary")


def labels_json(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, md5, label, origin, origin_name, filename, category, path of a label file; entries that are no objects are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.variant_get(F.try_parse_json("value"), "$.labels", "array<variant>").alias("labels"))
    if raw.where("labels is not null").isEmpty():
        raise ValueError("no JSON with a list of labels")
    each = raw.select(F.posexplode("labels").alias("entry_id", "v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    get = lambda k, kind="string": F.try_variant_get("v", f"$.{k}", kind)
    own = [get(k).alias(k) for k in ("md5", "label", "origin_name", "filename", "category")]
    origin = get("origin", "struct<importer:string,params:map<string,string>>").alias("origin")
    return each.select(F.col("entry_id").cast("long").alias("entry_id"), *own, origin, S.first_named(get("path"), get("file"), get("filename")).alias("path"))


def labels_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """entry_id, md5, label and other columns of a CSV label file: header trimmed and lower-cased, label lower-cased, blank rows left out.

    Entries are numbered from 0 in file order, files by path, since the last entry of a clip wins.  Without an
    ``encoding``, files are UTF-8 where all of their lines are valid, else Latin-1."""
    rows = _csv_rows(spark, path, encoding, lambda names: {"md5", "label"} <= names, "columns md5 and label are needed")
    return _numbered(rows, "md5")


def _csv_rows(spark: SparkSession, path: str, encoding: str | None, fits: Callable[[set[str]], object], what: str) -> DataFrame:
    """Trimmed columns of a CSV file under their trimmed, lower-cased names, with the place of each row."""
    if encoding is None:
        broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
        encoding = "UTF-8" if broken.isEmpty() else "ISO-8859-1"
    raw = spark.read.option("encoding", encoding).csv(path, header=True)
    names = [c.replace("\ufeff", "").replace("ï»¿", "").strip().lower() for c in raw.columns]
    if not fits(set(names)):
        raise ValueError(what)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__row")]
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in zip(raw.columns, names, strict=True)], *place).withColumn("label", F.lower("label"))


def _numbered(rows: DataFrame, needed: str) -> DataFrame:
    kept = rows.where((F.coalesce(needed, F.lit("")) != "") & (F.coalesce("label", F.lit("")) != ""))
    return renumber(kept, "__file", "__at", "__row", column="entry_id").withColumn("entry_id", F.col("entry_id") - 1).drop("__file", "__at", "__row")


def path_labels_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """entry_id, path, label of a CSV that names files; ``file`` and ``filename`` stand for ``path`` too.

    As in ``labels_csv`` the header is trimmed and lower-cased, labels are lower-cased, rows without path or label are left out."""
    rows = _csv_rows(spark, path, encoding, lambda names: "label" in names and {"path", "file", "filename"} & names, "columns path and label are needed")
    named = S.first_named(*[F.col(c) for c in ("path", "file", "filename") if c in rows.columns])
    return _numbered(rows.withColumn("path", named), "path").select("entry_id", "path", "label")


def trainer_rows(labels: DataFrame) -> DataFrame:
    """path, label, media_type of entries that can train: a valid label, a known suffix, of the first media type only."""
    ok = labels.withColumn("media_type", S.media_type(F.col("path"))).where(F.col("label").isin("good", "bad") & F.col("path").isNotNull() & F.col("media_type").isNotNull())
    first = ok.agg(F.min_by("media_type", "entry_id").alias("first"))
    return ok.crossJoin(F.broadcast(first)).where(F.col("media_type") == F.col("first")).select("entry_id", "path", "label", "media_type")


def detector_json(spark: SparkSession, path: str, media_type: str = "audio") -> DataFrame:
    """One detector from an exchange file: weights are required, threshold 0.5 and media type are defaults, the name is the file's."""
    text = spark.read.text(path, wholetext=True).first()
    d = json.loads(text[0])
    w = d.get("weights") if isinstance(d, dict) else None
    if not w:
        raise ValueError("the detector has no weights")
    name = d.get("name") or Path(path).stem
    row = (name, d.get("media_type") or media_type, w["0.weight"], w["0.bias"], [float(x) for x in np.ravel(w["2.weight"])], float(np.ravel(w["2.bias"])[0]), float(d.get("threshold", 0.5)), None)
    return spark.createDataFrame([row], DETECTORS)


def dataset(spark: SparkSession, path: str, thin: bool = False) -> DataFrame:
    """A saved dataset: Parquet, or a .pkl file of the exchange format (clips without media or vector are left out)."""
    if path.lower().endswith((".pkl", ".pickle")):
        return _shaped(scans.saved_clips(spark, path, thin=thin))
    found = _shaped(spark.read.parquet(path))
    return found.withColumns({"clip_bytes": F.lit(None).cast("binary"), "clip_string": F.lit(None).cast("string")}) if thin else found


def wav(frequency: float, duration: float, rate: int = 22050) -> bytes:
    """A sine tone as 16-bit mono WAV."""
    n = int(rate * duration)
    data = (np.sin(2 * math.pi * frequency * np.arange(n) / rate) * 0.5 * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def tones(spark: SparkSession, n: int = 20) -> DataFrame:
    """Synthetic tone clips: frequency 200 + 50 (i - 1) Hz, duration 1 + 0.5 (i mod 5) s."""
    i = F.col("id")
    rows = spark.range(1, n + 1).select(
        i.alias("clip_id"), F.lit("audio").alias("type"), (200 + 50 * (i - 1)).cast("int").alias("frequency"), (1 + 0.5 * (i % 5)).alias("duration"),
        F.concat(F.lit("tone_"), i.cast("string"), F.lit(".wav")).alias("filename"), F.lit("test").alias("category"), i.alias("ord"),
    )
    ship(spark)
    make = F.udf(lambda f, d: wav(f, d), "binary")
    rows = rows.withColumn("clip_bytes", make("frequency", "duration"))
    return _shaped(rows.withColumns({"file_size": F.octet_length("clip_bytes").cast("long"), "md5": F.md5("clip_bytes"), "origin_name": F.col("filename")}))

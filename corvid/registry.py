"""Named plugins and saved processors: sources, sinks, embedders, detectors, extractors, settings."""

from __future__ import annotations

import importlib
import json
import logging
import pkgutil
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.schema import DETECTORS

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Option:
    """One option of a plugin."""

    name: str
    kind: str = "text"
    required: bool = True
    default: object = None


class Plugin(ABC):
    """A named plugin with options."""

    name: str = ""
    options: tuple[Option, ...] = ()

    def checked(self, values: dict) -> dict:
        """Values with defaults filled in; ValueError for one that is missing or unknown."""
        known = {o.name: o for o in self.options}
        if odd := set(values) - set(known):
            raise ValueError(f"{self.name}: unknown options {sorted(odd)}")
        out = {n: values.get(n, o.default) for n, o in known.items()}
        if bare := [n for n, o in known.items() if o.required and out[n] in (None, "")]:
            raise ValueError(f"{self.name}: missing options {bare}")
        return out

    def as_dict(self) -> dict:
        return {"name": self.name, "options": [asdict(o) for o in self.options]}


class Source(Plugin):
    """Reads clips or labels."""

    @abstractmethod
    def read(self, spark: SparkSession, **values) -> DataFrame: ...

    def origin(self, values: dict) -> tuple[str, dict]:
        return self.name, {k: str(v) for k, v in values.items() if v is not None}


class Sink(Plugin):
    """Writes results; returns a message."""

    @abstractmethod
    def write(self, results: DataFrame, **values) -> str: ...


class Processor(ABC):
    """Something that judges or reads one clip."""

    name: str = ""
    media_type: str = ""

    def load_model(self) -> None:
        return None


class Detector(Processor):
    @abstractmethod
    def detect(self, clip: dict) -> bool: ...


class Extractor(Processor):
    @abstractmethod
    def extract(self, clip: dict) -> list[dict]: ...


class Registry:
    """Plugins by name; a module that fails to load is reported and passed over."""

    def __init__(self, kind: type = object):
        self.kind, self._found = kind, {}

    def add(self, plugin) -> None:
        self._found[plugin.name] = plugin

    def get(self, name: str):
        if name not in self._found:
            raise KeyError(f"no {self.kind.__name__.lower()} named {name}; there are {', '.join(self.names())}")
        return self._found[name]

    def names(self) -> list[str]:
        return sorted(self._found)

    def discover(self, package: str) -> None:
        """Add every object PLUGIN of the modules of a package."""
        for m in pkgutil.iter_modules(importlib.import_module(package).__path__):
            try:
                found = getattr(importlib.import_module(f"{package}.{m.name}"), "PLUGIN", None)
            except Exception as e:  # noqa: BLE001  a broken plugin must not stop the others
                log.warning("plugin %s.%s is passed over: %s", package, m.name, e)
                continue
            if found is not None:
                self.add(found)


sources, sinks = Registry(Source), Registry(Sink)
label_importers, processor_importers = Registry(Source), Registry(Source)
extractor_makers: dict[str, Callable[[dict], Extractor]] = {}


class FolderSource(Source):
    name, options = "folder", (Option("path"), Option("media_type"), Option("embedder", "object", False))

    def read(self, spark, **values):
        from corvid.sources import files

        v = self.checked(values)
        return files.folder(spark, v["path"], v["media_type"], v["embedder"], origin=self.origin({k: v[k] for k in ("path", "media_type")}))


class DatasetSource(Source):
    name, options = "dataset", (Option("path"),)

    def read(self, spark, **values):
        from corvid.sources import files

        return files.dataset(spark, self.checked(values)["path"])


class CombineSource(Source):
    name, options = "combine_datasets", (Option("paths", "list"),)

    def read(self, spark, **values):
        from corvid.operators.datasets import combine
        from corvid.sources import files

        paths = self.checked(values)["paths"]
        return combine([files.dataset(spark, p) for p in paths], list(paths))


class ArchiveSource(Source):
    name, options = "http_archive", (Option("path"), Option("to", "text", False), Option("media_type"), Option("embedder", "object", False))

    def read(self, spark, **values):
        """Members are read where they lie; with ``to``, a shared folder, they are unpacked there first."""
        from corvid.sources import files

        v = self.checked(values)
        if not v["to"]:
            return files.archive_scan(spark, v["path"], v["media_type"], v["embedder"])
        return files.archive(spark, v["path"], v["to"], v["media_type"], v["embedder"])


class PlaylistSource(Source):
    """A video playlist: fetching needs a network and an outside tool, so only the listing of a saved feed is read."""

    name, options = "playlist", (Option("path"), Option("limit", "number", False, 0))

    def read(self, spark, **values):
        from corvid.sources import files

        v = self.checked(values)
        return files.feed_items(spark, v["path"], int(v["limit"]))


class FeedSource(PlaylistSource):
    name = "rss_feed"


class JsonLabels(Source):
    name, options = "json_labels", (Option("path"),)

    def read(self, spark, **values):
        from corvid.sources import files

        return files.labels_json(spark, self.checked(values)["path"])


class CsvLabels(Source):
    name, options = "csv_labels", (Option("path"), Option("encoding", "text", False, "UTF-8"))

    def read(self, spark, **values):
        from corvid.sources import files

        return files.labels_csv(spark, **self.checked(values))


class DetectorFile(Source):
    """A detector from an exchange file."""

    name, options = "detector_file", (Option("path"), Option("media_type", "text", False, "audio"))

    def read(self, spark, **values):
        from corvid.sources import files

        return files.detector_json(spark, **self.checked(values))


class LabelFile(Source):
    """A detector trained on the files that a label file (JSON, or CSV with path and label) names."""

    name, options = "label_file", (Option("path"), Option("embedder", "object"), Option("name", "text", False, "detector"), Option("epochs", "number", False, None))
    csv = False

    def read(self, spark, **values):
        from corvid.operators import training
        from corvid.sources import files

        v = self.checked(values)
        labels = files.path_labels_csv(spark, v["path"]) if self.csv else files.labels_json(spark, v["path"])
        typed = files.trainer_rows(labels)
        how = {} if v["epochs"] is None else {"epochs": int(v["epochs"])}
        made = training.from_label_file(labels, v["embedder"], **how)
        first = typed.select("media_type").first()
        return made.row(spark, v["name"], first["media_type"])


class CsvLabelFile(LabelFile):
    name, csv = "csv_label_file", True


class FileSink(Sink):
    name, options = "file", (Option("path"), Option("media_type", "text", False, "audio"))

    def write(self, results, **values):
        from corvid.sinks import files

        v = self.checked(values)
        return files.results_json(results, v["path"], v["media_type"])


class CsvSink(Sink):
    name, options = "csv", (Option("path"),)

    def write(self, results, **values):
        from corvid.sinks import files

        path = self.checked(values)["path"]
        files.hits_csv(results, path)
        return f"hits written to {path}"


for _kind in (FolderSource, DatasetSource, CombineSource, ArchiveSource, PlaylistSource, FeedSource, JsonLabels, CsvLabels):
    sources.add(_kind())
for _kind in (JsonLabels, CsvLabels):
    label_importers.add(_kind())
for _kind in (DetectorFile, LabelFile, CsvLabelFile):
    processor_importers.add(_kind())
for _kind in (FileSink, CsvSink):
    sinks.add(_kind())


class Detectors:
    """A saved table of detectors; adding overwrites, renaming onto a taken name fails."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def empty(cls, spark: SparkSession) -> "Detectors":
        return cls(spark.createDataFrame([], DETECTORS))

    def add(self, rows: DataFrame) -> "Detectors":
        return Detectors(self.table.join(rows.select("name"), "name", "left_anti").select(*self.table.columns).unionByName(rows))

    def delete(self, name: str) -> "Detectors":
        return Detectors(self.table.where(F.col("name") != name))

    def rename(self, old: str, new: str) -> "Detectors":
        have = {r[0] for r in self.table.where(F.col("name").isin(old, new)).select("name").collect()}
        if old not in have:
            raise KeyError(old)
        if new in have:
            raise ValueError(f"{new} is taken")
        return Detectors(self.table.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name"))))

    def of_type(self, media_type: str) -> DataFrame:
        return self.table.where(F.col("media_type") == media_type)

    def missing(self, names: list[str]) -> list[str]:
        """Names not in the table yet: what a settings file still has to bring in."""
        have = {r[0] for r in self.table.where(F.col("name").isin(names)).select("name").collect()} if names else set()
        return [n for n in names if n not in have]


@dataclass(frozen=True)
class Recipe:
    """How a favourite detector is made: its name, the processor importer, and that importer's values."""

    name: str
    importer: str
    values: dict

    @classmethod
    def of(cls, entry: dict) -> Recipe:
        """From a settings entry; ValueError for one that names no detector or importer."""
        if not isinstance(entry, dict) or not entry.get("processor_name") or not entry.get("processor_importer"):
            raise ValueError("a recipe needs processor_name and processor_importer")
        return cls(str(entry["processor_name"]), str(entry["processor_importer"]), dict(entry.get("field_values") or {}))

    def as_entry(self) -> dict:
        return {"processor_name": self.name, "processor_importer": self.importer, "field_values": self.values}


RECIPE_ERRORS = "name string, importer string, error string"


def cook(spark: SparkSession, entries: list, detectors: Detectors, names: list[str] | None = None) -> tuple[Detectors, DataFrame]:
    """The detectors that recipes of a settings file make, and a row (name, importer, error) for each that failed.

    Only recipes whose name the table lacks are run (and, with ``names``, only those), in file order; of two recipes of
    one name the last counts.  One that fails stops no other: its importer's rows are read here, so that an error that
    only reading shows is told too."""
    recipes, failed = {}, []
    for e in entries:
        try:
            r = Recipe.of(e)
            recipes[r.name] = r
        except (ValueError, TypeError) as error:
            failed.append((e.get("processor_name") if isinstance(e, dict) else None, e.get("processor_importer") if isinstance(e, dict) else None, str(error)))
    wanted = [n for n in recipes if names is None or n in names]
    for name in detectors.missing(wanted):
        r = recipes[name]
        try:
            rows = processor_importers.get(r.importer).read(spark, **r.values).limit(2).collect()
            if len(rows) != 1:
                raise ValueError("no single detector was made")
            made = spark.createDataFrame([rows[0]], DETECTORS).withColumn("name", F.lit(name))
            detectors = detectors.add(made)
        except Exception as error:  # noqa: BLE001  a broken recipe must not stop the others
            log.warning("recipe %s is passed over: %s", name, error)
            failed.append((name, r.importer, str(error).split("\n")[0][:500]))
    return detectors, spark.createDataFrame(failed, RECIPE_ERRORS)


class Extractors:
    """A saved table of extractors (name, kind, media_type, config as JSON); a row is taken only if its maker can build it."""

    SCHEMA = "name string, kind string, media_type string, config string"

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def empty(cls, spark: SparkSession) -> "Extractors":
        return cls(spark.createDataFrame([], cls.SCHEMA))

    def add(self, name: str, kind: str, media_type: str, config: dict) -> "Extractors":
        """Adding overwrites; ValueError for an unknown kind or a config that its maker refuses."""
        self.build(kind, config)
        row = self.table.sparkSession.createDataFrame([(name, kind, media_type, json.dumps(config, sort_keys=True))], self.SCHEMA)
        return Extractors(self.table.where(F.col("name") != name).unionByName(row))

    def delete(self, name: str) -> "Extractors":
        return Extractors(self.table.where(F.col("name") != name))

    def rename(self, old: str, new: str) -> "Extractors":
        return Extractors(Detectors(self.table).rename(old, new).table)

    def of_type(self, media_type: str) -> dict[str, Callable[[], Extractor]]:
        """Makers of the extractors of a media type, by name: ``operators.extract.run`` calls them in tasks."""
        rows = self.table.where(F.col("media_type") == media_type).orderBy("name").collect()
        return {r["name"]: partial(extractor_makers[r["kind"]], json.loads(r["config"])) for r in rows}

    @staticmethod
    def build(kind: str, config: dict) -> Extractor:
        if kind not in extractor_makers:
            raise ValueError(f"no kind of extractor named {kind}; there are {', '.join(sorted(extractor_makers))}")
        try:
            return extractor_makers[kind](config)
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"{kind} can't be built from this config: {e}") from e


@dataclass
class Settings:
    """Settings with their bounds; saved as JSON."""

    inclusion: int = 0
    volume: float = 1.0
    calibrate_count: int = 2
    calibration_fraction: float = 0.5
    safe_thresholds: bool = False
    enrich_descriptions: bool = False
    favorite_processors: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.inclusion = int(min(10, max(-10, self.inclusion)))
        self.volume = float(min(1.0, max(0.0, self.volume)))
        self.calibrate_count = int(min(100, max(1, self.calibrate_count)))
        self.calibration_fraction = float(min(1.0, max(0.0, self.calibration_fraction)))

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def loads(cls, text: str) -> "Settings":
        """Settings of a JSON text; unknown keys are ignored, what can't be read gives the defaults."""
        try:
            d = json.loads(text)
        except ValueError:
            return cls()
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in known}) if isinstance(d, dict) else cls()


class StatusTracker:
    """Progress of a long job as status, message, current, total and error, with the seconds since the status began; safe between threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._now, self._began = ("idle", "", 0, 0, None), time.monotonic()

    def update(self, status: str, message: str = "", current: int = 0, total: int = 0, error: str | None = None) -> None:
        with self._lock:
            if status != self._now[0]:
                self._began = time.monotonic()
            self._now = (status, message, current, total, error)

    def get(self) -> dict:
        with self._lock:
            return dict(zip(("status", "message", "current", "total", "error"), self._now, strict=True)) | {"elapsed": time.monotonic() - self._began}


progress, sort_progress = StatusTracker(), StatusTracker()

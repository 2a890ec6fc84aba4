"""Scalar column functions over items, labels and file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.schema import EXTENSIONS, MIME


def text_of(c: Column | str) -> Column:
    """Null where a string is empty after trimming: what counts as absent."""
    return F.nullif(F.trim(c if isinstance(c, Column) else F.col(c)), F.lit(""))


def first_named(*cols: Column | str) -> Column:
    """The first of several alias columns that holds something."""
    return F.coalesce(*[text_of(c) for c in cols])


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")).cast("long")


def clean_prefix(text: Column, n: int = 1000) -> Column:
    """The first ``n`` characters, trimmed; null where nothing is left."""
    return text_of(F.substring(text, 1, n))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    whens = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(key == next(iter(table)), F.lit(next(iter(table.values())))))
    return whens.otherwise(default)


def mime_type(path: Column, default: str = "application/octet-stream") -> Column:
    """MIME type by suffix."""
    return _lookup(extension(path), MIME, F.lit(default))


def media_type(path: Column) -> Column:
    """Media type by suffix; null where the suffix is unknown."""
    return _lookup(extension(path), {e: kind for kind, exts in EXTENSIONS.items() for e in exts}, F.lit(None).cast("string"))


def url_filename(url: Column) -> Column:
    """The last path part of a link without query and fragment, behind eight digits of the link's hash."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    return F.concat(F.substring(F.md5(url), 1, 8), F.lit("_"), basename(path))


def origin_key(origin: Column) -> Column:
    """A canonical string of an origin, the same for any order of its parameters; null for no origin."""
    params = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(origin["params"], F.create_map().cast("map<string,string>"))))))
    return F.when(origin.isNotNull() & origin["importer"].isNotNull(), F.concat_ws("|", origin["importer"], params))


def origin_display(origin: Column) -> Column:
    """``importer(first parameter)``, the parameter of the smallest name; the importer alone where there is none."""
    first = F.element_at(F.transform(F.array_sort(F.map_entries(origin["params"])), lambda e: e["value"]), 1)
    return F.when(F.coalesce(F.size(origin["params"]), F.lit(0)) > 0, F.concat(origin["importer"], F.lit("("), first, F.lit(")"))).otherwise(origin["importer"])


def wrapped(template: Column, text: Column) -> Column:
    """A prompt template with ``{text}`` filled in."""
    return F.replace(template, F.lit("{text}"), text)


def sample_frames(n: Column, k: int = 8) -> Column:
    """Indices of min(k, n) evenly spaced frames of n."""
    m = F.least(n, F.lit(k)).cast("long")
    return F.when(n < 1, F.array().cast("array<bigint>")).when(m == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(m - 1, F.lit(1))), lambda i: F.floor(i * (n - 1) / F.greatest(m - 1, F.lit(1))))
    )


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def inclusion_weights(inclusion: int) -> tuple[float, float]:
    """Weights of false positives and false negatives: a positive inclusion makes misses dearer, a negative one false alarms."""
    return (1.0, 2.0**inclusion) if inclusion >= 0 else (2.0**-inclusion, 1.0)

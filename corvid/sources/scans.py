"""Python data sources whose tasks read parts of files: members of archives, saved clips, hashes of files.

Planning reads names and places alone (the directory of a zip, the headers of a tar, a listing of a folder); content is read by
the tasks, each a stretch of about ``STRETCH`` bytes.  Paths are local to every executor (a shared mount) or URIs that
``pyarrow.fs`` opens.  No reader unpacks anything to disk or runs code that a file names.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import pickletools
import posixpath
import struct
import tarfile
import zipfile
import zlib
from bz2 import BZ2Decompressor
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvid.storage import ship

#: Bytes of content that one task reads, unless a single file is longer; bytes read at a time.
STRETCH, CHUNK = 64 << 20, 8192
#: Files or members of one task.
MOST = 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    return fs.LocalFileSystem(), path


def _files(path: str, recursive: bool = False, glob: str = "*") -> list[tuple[str, int]]:
    """(path, length) of a file, or of a folder's files that fit ``glob`` and hold something, by path.  Names are matched in any case."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=recursive))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    kept = [f for f in found if f.type == fs.FileType.File and f.size and any(fnmatch.fnmatch(f.base_name.lower(), g) for g in glob.split(","))]
    return sorted((prefix + f.path, f.size) for f in kept)


def _stretches(sizes: list[int], most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of about ``most`` bytes."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (total + n > most or i - first >= MOST):
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def with_content(rows, column: str = "media_path", out: str = "content"):
    """``rows`` with the bytes of the file at ``column`` (null where it can't be read), each read in the task that holds its row."""

    @F.pandas_udf("binary")
    def read(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(path):
            try:
                system, inner = opened(path)
                with system.open_input_stream(inner, compression=None) as f:
                    return f.read()
            except (OSError, TypeError):
                return None

        for s in paths:
            yield pd.Series([one(p) for p in s], dtype=object)

    # said to be nondeterministic so that a filter on the content does not read it a second time
    return rows.withColumn(out, read.asNondeterministic()(F.col(column)))


# archives


@dataclass
class Members(InputPartition):
    """Members of a zip or a plain tar by place: (name, length, offset, stored length, method, crc)."""

    path: str
    kind: str
    members: list[tuple]


@dataclass
class Stream(InputPartition):
    """A packed tar: it can only be read from its beginning."""

    path: str


def _safe(name: str) -> str:
    flat = posixpath.normpath(name.replace("\\", "/"))
    if flat.startswith(("/", "../")) or flat == ".." or flat[1:2] == ":":
        raise ValueError(f"the archive leads outside its folder: {name}")
    return flat


def _inflated(raw: bytes, method: int) -> bytes:
    if method == zipfile.ZIP_STORED:
        return raw
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(raw, -15)
    if method == zipfile.ZIP_BZIP2:
        return BZ2Decompressor().decompress(raw)
    if method == zipfile.ZIP_LZMA:
        return zipfile.LZMADecompressor().decompress(raw)
    raise ValueError(f"packing method {method} is not known")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*").lower()
        self.content, self.most = options.get("content", "true") == "true", int(options.get("stretch", STRETCH))

    def _wanted(self, name: str, size: int) -> bool:
        return size > 0 and any(fnmatch.fnmatch(posixpath.basename(name).lower(), g) for g in self.glob.split(","))

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path, _ in _files(self.path):
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                head = f.read(6)
                f.seek(0)
                if head[:2] in (b"\x1f\x8b", b"BZ") or head == b"\xfd7zXZ\x00":
                    found.append(Stream(path))
                    continue
                try:
                    kind, members = ("zip", self._zipped(f)) if head[:2] == b"PK" else ("tar", self._tarred(f))
                except (tarfile.ReadError, zipfile.BadZipFile):
                    raise ValueError(f"neither zip nor tar: {path}") from None
            found += [Members(path, kind, members[a:b]) for a, b in _stretches([m[3] for m in members], self.most)]
        return found

    def _zipped(self, f) -> list[tuple]:
        out = []
        with zipfile.ZipFile(f) as z:
            for m in z.infolist():
                name = _safe(m.filename)
                if not m.is_dir() and self._wanted(name, m.file_size):
                    if m.flag_bits & 1:
                        raise ValueError(f"{m.filename} is encrypted")
                    out.append((name, m.file_size, m.header_offset, m.compress_size, m.compress_type, m.CRC))
        return out

    def _tarred(self, f) -> list[tuple]:
        out = []
        with tarfile.open(fileobj=f, mode="r:") as t:
            for m in t:
                name = _safe(m.name)
                if m.isreg() and not m.issparse() and self._wanted(name, m.size):
                    out.append((name, m.size, m.offset_data, m.size, -1, 0))
        return out

    def read(self, part: InputPartition) -> Iterator[tuple]:
        system, inner = opened(part.path)
        if isinstance(part, Stream):
            with system.open_input_stream(inner, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as t:
                for m in t:
                    name = _safe(m.name)
                    if m.isreg() and self._wanted(name, m.size):
                        yield part.path, name, m.size, t.extractfile(m).read() if self.content else None
            return
        if not self.content:
            yield from ((part.path, m[0], m[1], None) for m in part.members)
            return
        with system.open_input_file(inner) as f:
            for name, size, offset, stored, method, crc in part.members:
                f.seek(offset)
                if method >= 0:
                    head = f.read(30)
                    f.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                    data = _inflated(f.read(stored), method)
                    if len(data) != size or zlib.crc32(data) != crc:
                        raise ValueError(f"{name} in {part.path} is damaged")
                else:
                    data = f.read(stored)
                yield part.path, name, size, data


class ArchiveMembers(DataSource):
    """Regular files in zip and tar archives: archive, member, length, content.

    Options: path (an archive or a folder of them), glob (of base names, comma-separated), content (false: null, not read).
    A name that leads outside the archive, an encrypted or a damaged member raises ValueError."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


# hashes of files


@dataclass
class Paths(InputPartition):
    files: list[tuple[str, int]]


def md5_of(path: str) -> str:
    """Hash of a file, ``CHUNK`` bytes of which are held at a time."""
    system, inner = opened(path)
    sha = hashlib.md5()
    with system.open_input_stream(inner, compression=None, buffer_size=0) as f:
        while part := f.read(CHUNK):
            sha.update(part)
    return sha.hexdigest()


class HashReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o = self.options
        files = _files(o["path"], o.get("recursive", "false") == "true", o.get("glob", "*").lower())
        return [Paths(files[a:b]) for a, b in _stretches([n for _, n in files], int(o.get("stretch", STRETCH)))]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        for path, n in part.files:
            yield path, n, md5_of(path)


class FileHashes(DataSource):
    """path, length, md5 of files.  Options: path, glob, recursive.  No file is held as a whole."""

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "path string, length long, md5 string"

    def reader(self, schema) -> DataSourceReader:
        return HashReader(dict(self.options))


# saved clips


@dataclass(frozen=True)
class Span:
    """Bytes that stay in the file until they are asked for."""

    offset: int
    length: int


class _Named:
    """A function that a file names; only those of ``_KNOWN`` are understood, and none is called."""

    def __init__(self, name: str):
        self.name = name


class _Array:
    """An array under construction."""

    def __init__(self) -> None:
        self.value = None


# Names that stand for arrays in saved files.
_KNOWN = frozenset(
    f"{m}.{n}"
    for m in ("numpy", "numpy.core.multiarray", "numpy._core.multiarray", "numpy.core.numeric", "numpy._core.numeric", "_codecs", "collections", "builtins")
    for n in ("ndarray", "dtype", "_reconstruct", "scalar", "_frombuffer", "encode", "OrderedDict", "bytearray")
)
LONG = 4096


class Reading:
    """A machine for the opcodes of plain data in a pickle.  Long bytes are read as ``Span``; anything else raises ValueError."""

    def __init__(self, file) -> None:
        self.file = file
        self.stack: list = []
        self.marks: list[int] = []
        self.memo: dict[int, object] = {}

    def bytes_of(self, x) -> bytes:
        if isinstance(x, Span):
            self.file.seek(x.offset)
            return self.file.read(x.length)
        return bytes(x)

    def _marked(self) -> list:
        at = self.marks.pop()
        items = self.stack[at:]
        del self.stack[at:]
        return items

    def run(self):
        push = self.stack.append
        for op, arg, pos in pickletools.genops(self.file):
            name = op.name
            if name in ("PROTO", "FRAME"):
                continue
            if name == "STOP":
                return self.stack.pop()
            if name == "MARK":
                self.marks.append(len(self.stack))
            elif name in ("BINBYTES", "SHORT_BINBYTES", "BINBYTES8", "BYTEARRAY8"):
                head = {"SHORT_BINBYTES": 2, "BINBYTES": 5}.get(name, 9)
                push(Span(pos + head, len(arg)) if len(arg) > LONG else bytes(arg))
            elif name in ("NONE", "NEWTRUE", "NEWFALSE"):
                push({"NONE": None, "NEWTRUE": True, "NEWFALSE": False}[name])
            elif name in ("MEMOIZE", "PUT", "BINPUT", "LONG_BINPUT"):
                self.memo[len(self.memo) if name == "MEMOIZE" else int(arg)] = self.stack[-1]
            elif name in ("GET", "BINGET", "LONG_BINGET"):
                push(self.memo[int(arg)])
            elif name in ("EMPTY_DICT", "EMPTY_LIST", "EMPTY_TUPLE", "EMPTY_SET"):
                push({"D": dict, "L": list, "T": tuple, "S": set}[name[6]]())
            elif name in ("TUPLE", "LIST", "DICT", "FROZENSET"):
                items = self._marked()
                push({"TUPLE": tuple, "LIST": list, "FROZENSET": frozenset}[name](items) if name != "DICT" else dict(zip(items[::2], items[1::2], strict=True)))
            elif name in ("TUPLE1", "TUPLE2", "TUPLE3"):
                n = int(name[-1])
                items = tuple(self.stack[-n:])
                del self.stack[-n:]
                push(items)
            elif name in ("SETITEMS", "APPENDS", "ADDITEMS"):
                items, into = self._marked(), self.stack[-1]
                if name == "SETITEMS":
                    into.update(zip(items[::2], items[1::2], strict=True))
                elif name == "APPENDS":
                    into.extend(items)
                else:
                    into.update(items)
            elif name == "SETITEM":
                value, key = self.stack.pop(), self.stack.pop()
                self.stack[-1][key] = value
            elif name == "APPEND":
                value = self.stack.pop()
                self.stack[-1].append(value)
            elif name == "POP_MARK":
                self._marked()
            elif name == "POP":
                self.stack.pop()
            elif name in ("GLOBAL", "STACK_GLOBAL"):
                if name == "GLOBAL":
                    full = arg.replace(" ", ".")
                else:
                    last = self.stack.pop()
                    full = f"{self.stack.pop()}.{last}"
                if full not in _KNOWN:
                    raise ValueError(f"the file names {full}, which is no plain data")
                push(_Named(full.rpartition(".")[2]))
            elif name == "REDUCE":
                args = self.stack.pop()
                push(self._made(self.stack.pop(), args))
            elif name == "BUILD":
                self._built(self.stack.pop())
            elif op.arg is not None and isinstance(arg, (int, float, str, bool)) and op.stack_before == []:
                push(arg)
            else:
                raise ValueError(f"opcode {name} is no plain data")
        raise ValueError("the file ends early")

    def _made(self, what, args):
        kind = what.name if isinstance(what, _Named) else ""
        if kind == "_reconstruct":
            return _Array()
        if kind == "dtype":
            return _Dtype(str(args[0]))
        if kind == "encode":
            return args[0].encode(args[1] if len(args) > 1 else "utf-8")
        if kind == "bytearray":
            return args[0] if args else b""
        if kind == "OrderedDict":
            return {}
        if kind == "scalar":
            return np.frombuffer(self.bytes_of(args[1]), args[0].kind())[0].item()
        if kind == "_frombuffer":
            return np.frombuffer(self.bytes_of(args[0]), args[1].kind()).reshape(args[2], order=args[3])
        raise ValueError(f"a call of {kind or type(what).__name__} is no plain data")

    def _built(self, state) -> None:
        top = self.stack[-1]
        if isinstance(top, _Dtype):
            top.order = state[1]
        elif isinstance(top, _Array):
            _, shape, dtype, columns, raw = state
            kind = dtype.kind()
            top.value = np.frombuffer(self.bytes_of(raw), kind).reshape(shape, order="F" if columns else "C")
        else:
            raise ValueError("an object with a state of its own is no plain data")


class _Dtype:
    def __init__(self, code: str):
        self.code, self.order = code, "="

    def kind(self) -> np.dtype:
        found = np.dtype(self.code)
        if found.hasobject:
            raise ValueError("arrays of objects are no plain data")
        return found.newbyteorder(self.order) if self.order in "<>" else found


# Keys of the exchange format by media type.
OLD_BYTES = {"audio": "wav_bytes", "video": "video_bytes", "image": "image_bytes", "paragraph": "text_content"}
FOLDER_KEYS = {"audio": "audio_dir", "video": "video_dir", "image": "image_dir", "paragraph": "text_dir"}
SAVED = (
    "clip_id long, type string, duration double, file_size long, md5 string, embedding array<float>, clip_bytes binary, clip_string string, media_path string, filename string, "
    "category string, origin struct<importer:string,params:map<string,string>>, origin_name string, width int, height int, word_count int, character_count int, ord long, resolved boolean"
)


class SavedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.thin = options.get("thin", "false") == "true"
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else [c.strip().split(" ")[0] for c in SAVED.split(", ")]

    def partitions(self) -> list[InputPartition]:
        return [Paths([f]) for f in _files(self.options["path"], True, "*.pkl,*.pickle")]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        for path, _ in part.files:
            system, inner = opened(path)
            with io.BufferedReader(system.open_input_file(inner), 1 << 16) as f:
                machine = Reading(f)
                data = machine.run()
                if not isinstance(data, dict):
                    raise ValueError(f"{path} holds no clips")
                clips = data["clips"] if "clips" in data else data
                made = data.get("creation_info") if "clips" in data else None
                origin = {"importer": made.get("importer", "unknown"), "params": made.get("field_values", {})} if made else None
                for ord_, (key, clip) in enumerate(clips.items()):
                    row = self._row(machine, key, clip, data if "clips" in data else {}, origin)
                    row["ord"] = ord_
                    yield tuple(row.get(c) for c in self.columns)

    def _row(self, machine: Reading, key, clip: dict, data: dict, origin) -> dict:
        kind = clip.get("type", "audio")
        name = clip.get("filename", f"clip_{key}.{kind}")
        media = next((x for k in ("clip_string" if kind == "paragraph" else "clip_bytes", OLD_BYTES.get(kind, "")) if (x := clip.get(k)) is not None and x != b"" and (x != "" or kind == "paragraph")), None)
        beside = None
        if "filename" in clip and data.get(FOLDER_KEYS.get(kind, "")) and (self.thin or media is None):
            at = posixpath.join(str(data[FOLDER_KEYS[kind]]), clip["filename"])
            system, inner = opened(at)
            if system.get_file_info(inner).type == fs.FileType.File:
                beside = at
        vector = clip.get("embedding")
        vector = vector.value if isinstance(vector, _Array) else vector
        found = clip.get("origin") or origin
        row = {
            "clip_id": int(key), "type": kind, "duration": float(clip.get("duration") or 0), "file_size": clip.get("file_size", 0), "md5": clip.get("md5") or None,
            "embedding": None if vector is None else [float(x) for x in np.ravel(vector)], "filename": name, "category": clip.get("category", "unknown"),
            "origin": found and Row(importer=found.get("importer"), params={str(k): None if v is None else str(v) for k, v in (found.get("params") or {}).items()}),
            "origin_name": clip.get("origin_name", name), "media_path": clip.get("media_path") or beside,
            "width": clip.get("width") if kind == "image" else None, "height": clip.get("height") if kind == "image" else None,
            "word_count": clip.get("word_count") if kind == "paragraph" else None, "character_count": clip.get("character_count") if kind == "paragraph" else None,
        }
        if self.thin:
            return row | {"resolved": vector is not None}
        # bytes are read only where a column or a missing hash or size asks for them
        asked = {"clip_bytes", "clip_string"} & set(self.columns) or "md5" in self.columns and not row["md5"] or "file_size" in self.columns and "file_size" not in clip
        content = None
        if media is None and beside:
            system, inner = opened(beside)
            if asked:
                with system.open_input_stream(inner, compression=None) as f:
                    content = f.read()
        elif media is not None and asked:
            content = media.encode() if isinstance(media, str) else machine.bytes_of(media)
        there = bool(content) if asked else beside is not None or (media.length > 0 if isinstance(media, Span) else bool(media))
        if content:
            row |= {"md5": row["md5"] or hashlib.md5(content).hexdigest(), "file_size": clip.get("file_size", len(content))}
            row |= {"clip_string": content.decode("utf-8", "replace")} if kind == "paragraph" else {"clip_bytes": content}
        if beside is not None:
            row["media_path"] = beside
        return row | {"resolved": there and vector is not None}


class SavedClips(DataSource):
    """Clips of saved dataset files of the exchange format, and whether their media and vector were found.

    Options: path (a file or a folder of .pkl files), columns (comma-separated: what is not named is not read), thin
    (true: no media, paths instead).  A file is one task's work; its media are read one at a time."""

    @classmethod
    def name(cls) -> str:
        return "saved_clips"

    def schema(self) -> str:
        if not self.options.get("columns"):
            return SAVED
        kinds = {c.split(" ", 1)[0]: c for c in SAVED.split(", ")}
        return ", ".join(kinds[c.strip()] for c in self.options["columns"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return SavedReader(dict(self.options))


def scan(spark: SparkSession, kind: type[DataSource], path: str, **options):
    """A scan of one of these sources."""
    ship(spark)
    spark.dataSource.register(kind)
    reader = spark.read.format(kind.name()).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


def saved_clips(spark: SparkSession, path: str, columns: list[str] | None = None, thin: bool = False, missing: Observation | None = None):
    """Clips of saved files whose media and vector are there; ``missing`` observes how many were not (``missing.get["missing"]``)."""
    more = {"columns": ",".join([*columns, *({"resolved"} - set(columns))])} if columns else {}
    rows = scan(spark, SavedClips, path, thin=thin, **more)
    if missing is not None:
        rows = rows.observe(missing, F.count_if(~F.col("resolved")).alias("missing"))
    return rows.where("resolved").drop("resolved")

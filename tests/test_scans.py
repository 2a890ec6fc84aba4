"""Scans of archives, saved datasets and files, against plain reading."""

import hashlib
import io
import os
import pickle
import random
import tarfile
import tracemalloc
import zipfile

import numpy as np
import pytest
from pyspark.sql import Observation

from corvid import registry
from corvid.operators.embed import HashingEmbedder
from corvid.sources import files, scans


def bodies(n, seed=1):
    rng = random.Random(seed)
    return {f"d{i % 7}/f{i}.{'TXT' if i % 5 == 0 else 'txt'}": f"text {i} " * rng.randint(1, 40) for i in range(n)}


def test_zip_members_are_many_tasks_and_equal_a_plain_listing(spark, tmp_path):
    want = bodies(3000)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for i, (name, body) in enumerate(want.items()):
            z.writestr(name, body, (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[i % 4])
        z.writestr("empty.txt", "")
        z.writestr("d0/", "")
        z.writestr("d0/other.bin", "x")
    got = scans.scan(spark, scans.ArchiveMembers, str(tmp_path / "x.zip"), glob="*.txt", stretch=20_000)
    assert got.rdd.getNumPartitions() > 10
    assert {r.member: bytes(r.content).decode() for r in got.collect()} == want
    names = scans.scan(spark, scans.ArchiveMembers, str(tmp_path / "x.zip"), content=False).collect()
    assert len(names) == 3001 and {r.content for r in names} == {None} and {r.member: r.length for r in names}["d0/other.bin"] == 1


@pytest.mark.parametrize("packed", ["", "gz", "bz2", "xz"])
def test_tar_members(spark, tmp_path, packed):
    want = bodies(200, 2)
    with tarfile.open(tmp_path / "x.tar", f"w:{packed}") as t:
        for name, body in want.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body.encode()))
        link = tarfile.TarInfo("link.txt")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    got = scans.scan(spark, scans.ArchiveMembers, str(tmp_path / "x.tar"), glob="*.txt", stretch=2000)
    assert {r.member: bytes(r.content).decode() for r in got.collect()} == want
    assert (got.rdd.getNumPartitions() == 1) == bool(packed)


def test_archives_of_a_folder_as_clips(spark, tmp_path):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("b.txt", f"two words {k}")
            z.writestr("sub/a.txt", "one")
            z.writestr("pic.jpg", "x")
    got = files.archive_scan(spark, str(tmp_path), "paragraph", HashingEmbedder).orderBy("clip_id").collect()
    assert [r.clip_id for r in got] == [1, 2, 3, 4, 5, 6] and got[0].media_path.endswith("0.zip!b.txt") and got[0].word_count == 3
    assert all(r.md5 == hashlib.md5(bytes(r.clip_bytes)).hexdigest() and r.origin.importer == "http_archive" for r in got)
    thin = files.archive_scan(spark, str(tmp_path), "paragraph", HashingEmbedder, thin=True).orderBy("clip_id").collect()
    assert [(r.md5, r.embedding) for r in thin] == [(r.md5, r.embedding) for r in got] and {r.clip_bytes for r in thin} == {None}
    again = registry.sources.get("http_archive").read(spark, path=str(tmp_path / "1.zip"), media_type="paragraph", embedder=HashingEmbedder)
    assert again.count() == 2


def test_bad_archives_are_refused(spark, tmp_path):
    read = lambda name: scans.scan(spark, scans.ArchiveMembers, str(tmp_path / name)).collect()
    for k, name in enumerate(["../out.txt", "/abs.txt", "a/../../out.txt", "c:\\out.txt"]):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("fine.txt", "x")
            z.writestr(name, "x")
        with pytest.raises(Exception, match="outside"):
            read(f"{k}.zip")
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        info = tarfile.TarInfo("../up.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"x"))
    with pytest.raises(Exception, match="outside"):
        read("t.tgz")
    (tmp_path / "no.rar").write_bytes(b"Rar!\x1a\x07\x00 and more")
    with pytest.raises(Exception, match="neither zip nor tar"):
        read("no.rar")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.txt", "the content")
    raw = (tmp_path / "d.zip").read_bytes().replace(b"the content", b"The content", 1)
    (tmp_path / "d.zip").write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        read("d.zip")
    with pytest.raises(Exception, match="absent"):
        read("absent.zip")


def clip(i, kind="audio", **more):
    return {"type": kind, "duration": 1.5, "file_size": 5, "filename": f"f{i}", "category": "c", "embedding": np.arange(3, dtype=np.float32) + i, "md5": f"h{i}"} | more


@pytest.mark.parametrize("protocol", [0, 2, 4, 5])
def test_saved_clips_of_both_layouts(spark, tmp_path, protocol):
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "f3").write_bytes(b"beside")
    big = os.urandom(20_000)
    clips = {
        1: clip(1, clip_bytes=big),
        2: clip(2, wav_bytes=b"old key", embedding=[1.0, 2.0, 3.0], md5=None, file_size=7),
        3: clip(3, origin={"importer": "folder", "params": {"path": "/x"}}),
        4: clip(4),  # nowhere to be found
        5: clip(5, "paragraph", clip_string="some text\né", word_count=3, character_count=11),
        6: clip(6, "image", image_bytes=b"png", width=4, height=np.int64(5)),
        7: clip(7, clip_bytes=big, embedding=np.arange(6, dtype=">f8").reshape(2, 3, order="F")),
    }
    if protocol == 0:
        del clips[1], clips[7]  # text protocols hold bytes as calls
        clips = {k: v | {"embedding": [float(x) for x in np.ravel(v["embedding"])]} | {x: int(v[x]) for x in ("height",) if x in v} for k, v in clips.items()}
    made = {"clips": clips, "audio_dir": str(tmp_path / "media"), "creation_info": {"importer": "demo", "field_values": {"name": "n"}}}
    (tmp_path / "new.pkl").write_bytes(pickle.dumps(made, protocol=protocol))
    missing = Observation()
    got = {r.clip_id: r for r in scans.saved_clips(spark, str(tmp_path / "new.pkl"), missing=missing).collect()}
    assert set(got) == set(clips) - {4} and missing.get["missing"] == 1
    if protocol:
        assert bytes(got[1].clip_bytes) == big == bytes(got[7].clip_bytes) and got[7].embedding == [0, 2, 4, 1, 3, 5]
    assert bytes(got[2].clip_bytes) == b"old key" and got[2].md5 == hashlib.md5(b"old key").hexdigest() and got[2].origin.params == {"name": "n"}
    assert bytes(got[3].clip_bytes) == b"beside" and got[3].media_path == str(tmp_path / "media" / "f3") and got[3].origin.params == {"path": "/x"}
    assert got[5].clip_string == "some text\né" and got[5].clip_bytes is None and got[5].word_count == 3 and (got[6].width, got[6].height) == (4, 5)
    assert {tuple(got[i].embedding) for i in (3, 5)} == {(3.0, 4.0, 5.0), (5.0, 6.0, 7.0)}
    thin = {r.clip_id: r for r in scans.saved_clips(spark, str(tmp_path / "new.pkl"), thin=True).collect()}
    assert set(thin) == set(clips) and {r.clip_bytes for r in thin.values()} == {None} and thin[3].media_path and thin[4].media_path is None
    few = scans.saved_clips(spark, str(tmp_path / "new.pkl"), columns=["clip_id", "embedding"])
    assert few.columns == ["clip_id", "embedding"] and {r.clip_id for r in few.collect()} == set(clips) - {4}
    (tmp_path / "old.pkl").write_bytes(pickle.dumps(clips, protocol=protocol))
    old = {r.clip_id: r for r in files.dataset(spark, str(tmp_path / "old.pkl")).collect()}
    assert set(old) == set(clips) - {3, 4} and old[2].origin is None
    assert files.dataset(spark, str(tmp_path / "old.pkl"), thin=True).count() == len(clips)


def test_saved_files_run_no_code(spark, tmp_path):
    class Bad:
        def __reduce__(self):
            return os.system, (f"touch {tmp_path}/ran",)

    class Own:
        pass

    for name, what in (("call", {1: clip(1, clip_bytes=b"x", extra=Bad())}), ("state", {1: clip(1, clip_bytes=b"x", extra=Own)}), ("list", [1, 2]), ("objects", {1: clip(1, embedding=np.array([{}], dtype=object))})):
        try:
            (tmp_path / f"{name}.pkl").write_bytes(pickle.dumps(what))
        except (pickle.PicklingError, AttributeError):
            continue
        with pytest.raises(Exception, match="no plain data|holds no clips"):
            scans.saved_clips(spark, str(tmp_path / f"{name}.pkl")).collect()
    assert not (tmp_path / "ran").exists()


def test_columns_that_are_not_asked_for_are_not_read(tmp_path):
    (tmp_path / "x.pkl").write_bytes(pickle.dumps({"clips": {i: clip(i, clip_bytes=os.urandom(50_000)) for i in range(5)}}))
    asked = []

    def read(columns):
        reader = scans.SavedReader({"path": str(tmp_path / "x.pkl"), "columns": columns})
        return [r for p in reader.partitions() for r in reader.read(p)]

    real = scans.Reading.bytes_of
    try:
        scans.Reading.bytes_of = lambda self, x: asked.append(len(x) if isinstance(x, bytes) else x.length) or real(self, x)
        assert read("clip_id,resolved") == [(i, True) for i in range(5)] and 50_000 not in asked
        assert [len(r[0]) for r in read("clip_bytes")] == [50_000] * 5 and asked.count(50_000) == 5
    finally:
        scans.Reading.bytes_of = real


def test_thin_scan_holds_no_file(spark, tmp_path):
    body = os.urandom(1 << 20) * 32
    (tmp_path / "big.wav").write_bytes(body)
    (tmp_path / "small.WAV").write_bytes(b"s")
    (tmp_path / "none.wav").write_bytes(b"")
    tracemalloc.start()
    assert scans.md5_of(str(tmp_path / "big.wav")) == hashlib.md5(body).hexdigest()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20
    thin = files.folder(spark, str(tmp_path), "audio", thin=True).orderBy("clip_id").collect()
    whole = files.folder(spark, str(tmp_path), "audio").orderBy("clip_id").collect()
    assert [(r.filename, r.md5, r.file_size, r.clip_id) for r in thin] == [(r.filename, r.md5, r.file_size, r.clip_id) for r in whole] and len(thin) == 2
    assert {r.clip_bytes for r in thin} == {None} and thin[0].media_path.endswith("big.wav")
    many = scans.scan(spark, scans.FileHashes, str(tmp_path), stretch=1)
    assert many.rdd.getNumPartitions() == 2


def test_thin_scan_embeds_by_path(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"word{i} other")
    thin, whole = (files.folder(spark, str(tmp_path), "paragraph", HashingEmbedder, thin=t).orderBy("clip_id").collect() for t in (True, False))
    assert [(r.filename, r.embedding) for r in thin] == [(r.filename, r.embedding) for r in whole] and thin[0].clip_string is None

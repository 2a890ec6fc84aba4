import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvid.operators import datasets, labels
from corvid.schema import CLIPS, ORIGIN

ENTRY = "entry_id long, label string, md5 string, origin struct<importer:string,params:map<string,string>>, origin_name string"


def clip_rows(spark):
    o = lambda p: Row(importer="folder", params={"path": p, "type": "audio"})
    return spark.createDataFrame(
        [(1, "h1", o("/a"), "a"), (2, "h2", o("/a"), "b"), (3, "h1", o("/b"), "a"), (4, "", None, "")],
        "clip_id long, md5 string, origin struct<importer:string,params:map<string,string>>, origin_name string",
    )


def test_resolution_is_a_union_of_both_matches(spark):
    o = Row(importer="folder", params={"type": "audio", "path": "/a"})
    e = spark.createDataFrame([(1, "good", "h1", o, "a"), (2, "good", "", None, ""), (3, "bad", "h9", o, "zz"), (4, "odd", "h2", None, None)], ENTRY)
    r = labels.resolve(e, clip_rows(spark))
    assert sorted((x.entry_id, x.clip_id, x.kind) for x in r.collect()) == [(1, 1, 0), (1, 3, 1), (4, 2, 1)]
    assert [tuple(x) for x in labels.first_match(r).orderBy("entry_id").collect()] == [(1, 1), (4, 2)]
    assert labels.apply_counts(e, r).first().asDict() == {"applied": 1, "missing": 2, "skipped": 1}
    assert sorted(x.entry_id for x in labels.missing(e, r).collect()) == [2, 3]


def machine(rows):
    now, out = {}, []
    for clip, seq, vote, imp in sorted(rows, key=lambda r: r[1]):
        now[clip] = "unlabel" if not imp and now.get(clip) == vote else vote
        out.append((clip, seq, now[clip]))
    return now, out


def test_toggle_equals_a_state_machine(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(8), i, rng.choice(["good", "bad"]), False) for i in range(300)]
    df = spark.createDataFrame(rows, "clip_id long, seq long, vote string, is_import boolean")
    now, out = machine(rows)
    got = labels.toggled(df)
    assert sorted(map(tuple, got.collect())) == sorted(out)
    assert {r.clip_id: r.label for r in labels.current(got).collect()} == {c: v for c, v in now.items() if v != "unlabel"}
    rows = [(c, s, v, rng.random() < 0.3) for c, s, v, _ in rows]
    df = spark.createDataFrame(rows, df.schema)
    assert {r.clip_id: r.label for r in labels.folded(df).collect()} == {c: v for c, v in machine(rows)[0].items() if v != "unlabel"}


def test_click_ordinals_skip_numbers_taken_back(spark):
    h = spark.createDataFrame([(1, 1, "good"), (2, 2, "bad"), (1, 3, "unlabel"), (3, 4, "good"), (2, 5, "good")], "clip_id long, seq long, label string")
    assert sorted(map(tuple, labels.click_ordinals(h).collect())) == [(2, 4), (3, 3)]


def clips_of(spark, rows):
    full = [{"clip_id": i, "type": t, "md5": m, "filename": f"f{i}", "category": c} for i, t, m, c in rows]
    return spark.createDataFrame([Row(**{f.name: r.get(f.name) for f in CLIPS.fields}) for r in full], CLIPS)


def test_combine_keeps_first_copies_and_renumbers(spark):
    a = clips_of(spark, [(1, "audio", "x", "c"), (2, "audio", "", "c"), (3, "audio", "y", "c")])
    b = clips_of(spark, [(1, "audio", "y", "d"), (2, "audio", "", "d"), (3, "audio", "z", "d")])
    got = datasets.combine([a, b]).orderBy("clip_id").collect()
    assert [(r.clip_id, r.md5, r.category) for r in got] == [(1, "x", "c"), (2, "", "c"), (3, "y", "c"), (4, "", "d"), (5, "z", "d")]
    with pytest.raises(ValueError, match="video"):
        datasets.combine([a, clips_of(spark, [(1, "video", "q", "c")])])
    with pytest.raises(ValueError):
        datasets.combine([a])


@pytest.mark.parametrize("fraction", [0.01, 0.25, 0.99])
def test_split_guarantees(spark, fraction):
    rows = [(i, "audio", str(i), c) for i, c in enumerate(["a"] * 40 + ["b"] * 2 + ["c"])]
    got = datasets.stratified_split(clips_of(spark, rows), fraction, 7).groupBy("category").agg(F.count_if(F.col("side") == "test").alias("t"), F.count("*").alias("n"))
    n = {r.category: (r.t, r.n) for r in got.collect()}
    assert n["a"][0] == min(39, max(1, round(40 * fraction))) and n["b"][0] == 1 and n["c"][0] == 0


def test_reingest_appends_wanted_rows_of_named_sources(spark):
    clips = clips_of(spark, [(5, "audio", "x", "c")])
    o = Row(importer="folder", params={"path": "/a"})
    again = clips_of(spark, [(1, "audio", "y", "c"), (2, "audio", "z", "c"), (3, "audio", "w", "c")]).withColumn("origin", F.struct(F.lit("folder").alias("importer"), F.create_map(F.lit("path"), F.lit("/a")).alias("params")).cast(ORIGIN)).withColumn("origin_name", F.col("filename"))
    miss = spark.createDataFrame([(1, "good", "y", o, None), (2, "good", None, o, "f3"), (3, "good", "z", None, None)], ENTRY)
    got = datasets.reingest(miss, again, clips).orderBy("clip_id").collect()
    assert [r.clip_id for r in got] == [5, 6, 7] and {r.md5 for r in got} == {"x", "y", "w"}

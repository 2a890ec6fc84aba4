"""Labels: resolution against clips, bulk application, and the vote log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalars import origin_key, text_of
from corvid.operators.ranges import ranked


def resolve(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """entry_id, clip_id, kind (0 origin, 1 md5): clips that equal an entry by (origin, origin name) or by md5.

    Two equi-joins and a union; an OR in one join would be a nested loop.  Null origins and empty names or hashes
    never match; a pair found both ways is kept once, as origin."""
    e = entries.select("entry_id", origin_key(F.col("origin")).alias("key"), text_of("origin_name").alias("name"), text_of("md5").alias("hash"))
    c = clips.select("clip_id", origin_key(F.col("origin")).alias("key"), text_of("origin_name").alias("name"), text_of("md5").alias("hash"))
    by_origin = e.join(c, ["key", "name"]).select("entry_id", "clip_id", F.lit(0).alias("kind"))
    by_hash = e.join(c.select("clip_id", "hash"), "hash").select("entry_id", "clip_id", F.lit(1).alias("kind"))
    return by_origin.unionByName(by_hash).groupBy("entry_id", "clip_id").agg(F.min("kind").alias("kind"))


def first_match(resolved: DataFrame) -> DataFrame:
    """entry_id and its first clip: origin matches before md5 matches, then by id."""
    return resolved.groupBy("entry_id").agg(F.min(F.struct("kind", "clip_id")).alias("m")).select("entry_id", F.col("m.clip_id").alias("clip_id"))


def valid(label: Column) -> Column:
    return F.coalesce(label.isin("good", "bad"), F.lit(False))


def missing(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entries of a valid label that match no clip."""
    return entries.where(valid(F.col("label"))).join(resolved.select("entry_id").distinct(), "entry_id", "left_anti")


def apply_counts(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """applied, missing, skipped: entries, not clips."""
    hit = resolved.select("entry_id").distinct().withColumn("hit", F.lit(True))
    ok, found = valid(F.col("label")), F.coalesce("hit", F.lit(False))
    return entries.join(hit, "entry_id", "left").agg(
        F.count_if(ok & found).alias("applied"), F.count_if(ok & ~found).alias("missing"), F.count_if(~ok).alias("skipped")
    )


def apply_labels(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """clip_id, label after a bulk import: set, not toggled; the last entry of a clip wins."""
    rows = entries.where(valid(F.col("label"))).join(resolved, "entry_id")
    return rows.groupBy("clip_id").agg(F.max_by("label", "entry_id").alias("label"))


def toggled(votes: DataFrame) -> DataFrame:
    """clip_id, seq, label of a log of clicks (clip_id, seq, vote): the same vote again takes it back.

    Closed form over gaps and islands: within a run of equal votes of a clip, odd places set and even places unset."""
    by_clip = Window.partitionBy("clip_id").orderBy("seq")
    by_vote = Window.partitionBy("clip_id", "vote").orderBy("seq")
    run = F.row_number().over(by_clip) - F.row_number().over(by_vote)
    place = F.row_number().over(Window.partitionBy("clip_id", "vote", "run").orderBy("seq"))
    return votes.withColumn("run", run).select("clip_id", "seq", F.when(place % 2 == 1, F.col("vote")).otherwise(F.lit("unlabel")).alias("label"))


def folded(log: DataFrame) -> DataFrame:
    """clip_id, label of a log (clip_id, seq, vote, is_import) that mixes clicks and imports; unlabelled clips left out."""
    step = lambda now, e: F.when(~e["is_import"] & (e["vote"] == now), F.lit("unlabel")).otherwise(e["vote"])
    last = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "vote", "is_import"))), F.lit("unlabel"), step)
    return log.groupBy("clip_id").agg(last.alias("label")).where("label <> 'unlabel'")


def current(history: DataFrame) -> DataFrame:
    """clip_id, label, seq: the latest label of every clip that has one."""
    return history.groupBy("clip_id").agg(F.max_by("label", "seq").alias("label"), F.max("seq").alias("seq")).where("label <> 'unlabel'")


def click_ordinals(history: DataFrame) -> DataFrame:
    """clip_id, click: the 1-based number of the accepted vote that still stands; numbers taken back are not reused.

    Numbers come from sorted ranges of accepted votes, so a long log is many tasks' work."""
    accepted = ranked(history.where("label <> 'unlabel'").select("clip_id", "seq"), [F.col("seq"), F.col("clip_id")], "click")
    return accepted.join(current(history).select("clip_id", "seq"), ["clip_id", "seq"]).select("clip_id", F.col("click").cast("long").alias("click"))


def vote_sets(history: DataFrame) -> DataFrame:
    """label, ord, clip_id: both vote sets in vote order, good first."""
    return ranked(current(history), [F.col("seq"), F.col("clip_id")], "ord", ("label",)).select("label", "ord", "clip_id")


def labelset(votes: DataFrame, clips: DataFrame) -> DataFrame:
    """The exported label set: good in vote order, then bad; votes of clips that are not loaded are left out."""
    rows = votes.join(clips.select("clip_id", "md5", "origin", "origin_name", "filename", "category"), "clip_id")
    return ranked(rows, [F.col("seq"), F.col("clip_id")], "ord", ("label",)).select("label", "ord", "md5", "origin", text_of("origin_name").alias("origin_name"), text_of("filename").alias("filename"), text_of("category").alias("category"))


def labelset_from_hits(hit: DataFrame, clips: DataFrame) -> DataFrame:
    """Hits as good labels, with the clip's origin and name where the hit has none."""
    own = clips.select("clip_id", F.col("origin").alias("c_origin"), F.col("origin_name").alias("c_name"), F.col("filename").alias("c_file"), F.col("md5").alias("c_md5"))
    return hit.join(own, "clip_id", "left").select(
        "clip_id", F.lit("good").alias("label"), F.coalesce("origin", "c_origin").alias("origin"),
        F.coalesce(text_of("origin_name"), text_of("c_name"), text_of("filename"), text_of("c_file")).alias("origin_name"), F.coalesce(text_of("md5"), text_of("c_md5")).alias("md5"),
    )


def sort_labels(labels: DataFrame, by: str = "time") -> DataFrame:
    """Label entries by time, name, confidence (either way) or id; a missing time or score counts as -1."""
    score = F.coalesce("score", F.lit(-1.0))
    sure = F.when(F.col("score").isNull(), F.lit(-1.0)).when(F.col("label") == "good", score).otherwise(1 - score)
    order = {
        "time": [F.desc(F.coalesce("click", F.lit(-1)))], "name": [F.asc("filename")], "confidence_desc": [sure.desc()], "confidence_asc": [sure.asc()], "id": [],
    }[by]
    return labels.withColumn("confidence", sure).orderBy(*order, "clip_id")


def recent_texts(log: DataFrame) -> DataFrame:
    """text, seq: distinct search texts, the last used first."""
    return log.groupBy("text").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"))

"""Whole datasets: combining, renumbering, slicing, splitting and re-ingesting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalars import origin_key, text_of
from corvid.operators.ranges import ranked


def dedup_by_md5(clips: DataFrame) -> DataFrame:
    """The first row (src, pos) of every md5; rows without one all stay.

    The keeper of a hash is found with a map-side combined minimum, so a hash that a third of all rows share is no
    hot partition."""
    place = F.struct("src", "pos")
    hashed = clips.where(text_of("md5").isNotNull())
    first = hashed.groupBy("md5").agg(F.min(place).alias("first")).select("md5", F.col("first.src").alias("src"), F.col("first.pos").alias("pos"))
    kept = hashed.join(first, ["md5", "src", "pos"], "left_semi")
    return kept.unionByName(clips.where(text_of("md5").isNull()).select(*kept.columns))


def renumber(clips: DataFrame, *order: str, column: str = "clip_id") -> DataFrame:
    """Ids 1..n in the given order.

    Sorted ranges number their own rows; only the counts of ranges are summed in one task."""
    return ranked(clips, [F.col(c) for c in order], column)


def combine(parts: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Union of at least two datasets of one media type, first copy of each md5 kept, ids renumbered.

    Empty parts are skipped; parts of two types raise ValueError naming both."""
    if len(parts) < 2:
        raise ValueError("at least two datasets are needed")
    names = names or [f"dataset {i + 1}" for i in range(len(parts))]
    types, used = {}, []
    for i, (name, part) in enumerate(zip(names, parts, strict=True)):
        row = part.select("type").limit(1).first()
        if row is not None:
            types.setdefault(row["type"], name)
            used.append(part.withColumns({"src": F.lit(i).cast("long"), "pos": F.col("clip_id")}))
    if len(types) > 1:
        raise ValueError("media types differ: " + ", ".join(f"{n} holds {t}" for t, n in types.items()))
    if not used:
        raise ValueError("no clips")
    return renumber(dedup_by_md5(reduce(DataFrame.unionByName, used)).drop("clip_id"), "src", "pos").drop("src", "pos")


def category_slice(clips: DataFrame, start: int, end: int, categories: list[str] | None = None) -> DataFrame:
    """Rows start..end (exclusive) of every category in file-name order.

    The filter on the row number itself lets every task drop all but its first ``end`` rows before the shuffle."""
    chosen = clips if categories is None else clips.where(F.col("category").isin(categories))
    rn = F.row_number().over(Window.partitionBy("category").orderBy("filename", "clip_id"))
    return chosen.withColumn("place", rn).where((F.col("place") <= end) & (F.col("place") > start)).withColumn("place", F.col("place") - 1)


def split_key(seed: Column | int, category: Column, item: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed) if isinstance(seed, int) else seed, category.cast("string"), item.cast("string")), 256)


def stratified_split(clips: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """``clips`` with ``side`` (test or simulation), split within each category by a seeded hash order.

    n * fraction, half to even, go to test; both sides get one at least where a category has two.  Places come from
    sorted ranges, so a category of a third of all rows is many tasks' work."""
    placed = ranked(clips.withColumn("__h", split_key(seed, F.col("category"), F.col("clip_id"))), [F.col("__h"), F.col("clip_id")], "rn", ("category",))
    counts = placed.groupBy(F.col("category").alias("__k")).agg(F.max("rn").alias("n"))
    want = F.bround(F.col("n") * F.lit(float(fraction)), 0)
    n_test = F.when(F.col("n") < 2, F.lit(0)).otherwise(F.least(F.greatest(want, F.lit(1)), F.col("n") - 1))
    whole = placed.join(counts, F.col("category").eqNullSafe(F.col("__k")))
    return whole.withColumn("side", F.when(F.col("rn") <= n_test, "test").otherwise("simulation")).select(*clips.columns, "side")


def reingest(missing: DataFrame, reread: DataFrame, clips: DataFrame) -> DataFrame:
    """Rows of re-read sources that a missing entry asks for by origin name or md5, with fresh ids after the largest one.

    Only sources named by an entry's origin are looked at; entries without an origin ask for nothing."""
    want = missing.where(F.col("origin").isNotNull()).select(origin_key(F.col("origin")).alias("key"), text_of("origin_name").alias("name"), text_of("md5").alias("hash"))
    rows = reread.withColumn("key", origin_key(F.col("origin")))
    asked = want.select("key", F.explode(F.array(F.struct(F.lit("n").alias("k"), F.col("name").alias("v")), F.struct(F.lit("h").alias("k"), F.col("hash").alias("v")))).alias("x")).select("key", "x.k", "x.v").where("v is not null").distinct()
    by_name = rows.join(asked.where("k = 'n'").select("key", F.col("v").alias("origin_name")), ["key", "origin_name"], "left_semi")
    by_hash = rows.join(asked.where("k = 'h'").select("key", F.col("v").alias("md5")), ["key", "md5"], "left_semi")
    found = by_name.unionByName(by_hash.select(*by_name.columns)).dropDuplicates(["key", "origin_name", "md5"]).drop("key")
    top = clips.agg(F.coalesce(F.max("clip_id"), F.lit(0)).alias("top"))
    fresh = renumber(found.drop("clip_id").withColumn("ord", F.coalesce("ord", F.lit(0).cast("long"))), "ord", "origin_name", "md5")
    return clips.unionByName(fresh.crossJoin(F.broadcast(top)).withColumn("clip_id", F.col("clip_id") + F.col("top")).drop("top").select(*clips.columns))


def next_clip_id(clips: DataFrame) -> DataFrame:
    """next_id: one more than the largest id, 1 for none."""
    return clips.agg((F.coalesce(F.max("clip_id"), F.lit(0)) + 1).cast("long").alias("next_id"))


def with_precomputed(clips: DataFrame, vectors: DataFrame) -> DataFrame:
    """``clips`` whose embedding and md5 come from ``vectors`` (filename, vector, md5) where it has them."""
    known = vectors.select("filename", F.col("vector").alias("__v"), F.col("md5").alias("__m"))
    return clips.join(known, "filename", "left").withColumns({"embedding": F.coalesce("__v", "embedding"), "md5": F.coalesce(text_of("__m"), "md5")}).drop("__v", "__m")

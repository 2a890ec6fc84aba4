"""Sharding by fixed virtual slots.

Every record is hashed into one of ``N_VSLOTS`` virtual slots.  Bytes and rows
are summed per slot (a map-side combined aggregate of at most ``N_VSLOTS`` rows)
and a slot-to-shard map is made from those sums: heaviest slot first, each to the
lightest shard so far.  The map is a small versioned table
(``version, vslot, shard``); rebalancing writes a next version in which only the
slots that must move have another shard.

Null and edge cases: a null text counts as empty, a null id is a value of its own, rows
equal in id and text share a slot by eights (a hot key is spread like any others), an empty
table gives an empty result, and other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.operators import ranges
from corvid.storage import durable, table_path

#: Slots are fixed for the life of a data set; the map's size is bounded by it.
N_VSLOTS = 4096
#: Rows equal in id and text that share a slot.
TOGETHER = 8


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_vslots: int = N_VSLOTS) -> DataFrame:
    """id, UTF-8 size plus one, CRC-32 of the text and the virtual slot of every record.

    The slot is a hash of id, text and a salt.  Rows equal in id and text are numbered by sorted ranges where there are
    more than ``TOGETHER`` of them, and every ``TOGETHER`` of them have a salt of their own: which of them has which does
    not show in the result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text).alias("mark"),
    )
    read = durable(read, "shard-records")
    hot = durable(read.groupBy("mark").count().where(F.col("count") > TOGETHER).select("mark"), "shard-hot")
    many = ranges.ranked(read.join(hot, "mark", "left_semi"), [F.col("size")], "place", ("mark",))
    salted = read.join(hot, "mark", "left_anti").withColumn("salt", F.lit(0).cast("long"))
    salted = salted.unionByName(many.withColumn("salt", F.floor((F.col("place") - 1) / TOGETHER)).drop("place"))
    return salted.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("mark", "salt"), F.lit(n_vslots)).cast("int").alias("vslot"))


def slot_loads(recs: DataFrame, n_vslots: int = N_VSLOTS) -> DataFrame:
    """vslot, bytes, rows of every slot, of those without records too: later records may come into them."""
    held = recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = recs.sparkSession.range(n_vslots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "full").fillna(0, ["bytes", "rows"])


def _pour(slots: DataFrame, start: Column, version: int) -> DataFrame:
    """Deal ``slots`` (vslot, bytes), heaviest first, each to the lightest shard of ``start`` (bytes per shard).

    One fold over at most N_VSLOTS entries."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("vslot"))))

    def step(acc: Column, s: Column) -> Column:
        pick = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda b, i: F.when(i == pick, b - s["neg"]).otherwise(b)).alias("loads"),
            F.concat(acc["owner"], F.array(pick)).alias("owner"),
        )

    folded = slots.agg(order.alias("order")).select(
        "order",
        F.aggregate(
            "order",
            F.struct(start.alias("loads"), F.array().cast("array<int>").alias("owner")),
            step,
        ).alias("dealt"),
    )
    return (
        folded.select(F.explode(F.arrays_zip(F.col("order.vslot").alias("vslot"), F.col("dealt.owner").alias("shard"))).alias("x"))
        .select(F.lit(version).alias("version"), F.col("x.vslot").alias("vslot"), F.col("x.shard").alias("shard"))
    )


def first_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: version, vslot, shard.  Slots without bytes are spread evenly."""
    dealt = _pour(loads.where("bytes > 0").select("vslot", "bytes"), F.array_repeat(F.lit(0).cast("long"), n_shards), 1)
    return dealt.unionByName(loads.where("bytes = 0").select(F.lit(1).alias("version"), "vslot", _even(n_shards).alias("shard")))


def _even(n_shards: int) -> Column:
    return F.pmod("vslot", F.lit(n_shards)).cast("int")


def rebalance(old: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version of ``old`` for ``n_shards``: slots that begin beyond a shard's fair share move, all others stay.

    Growing by one shard moves slots only into the new one: every old shard keeps its share at least.  Slots that ``old``
    lacks are added."""
    now = old.select("version", "vslot", "shard").join(loads.select("vslot", "bytes"), "vslot", "full").fillna(0, ["bytes"])
    by_shard = Window.partitionBy("shard").orderBy("vslot")
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(n_shards)
    own = F.coalesce(F.col("shard") < n_shards, F.lit(False))
    now = now.withColumn("stays", own & ((F.sum("bytes").over(by_shard) - F.col("bytes") < share) | (share == 0)))
    # slots without bytes and without a shard of their own weigh nothing in the fold: they are spread evenly
    now = now.withColumn("even", ~own & (F.col("bytes") == 0))
    version = F.max("version").over(Window.partitionBy()) + 1
    now = now.withColumn("next", version)
    kept = now.where("stays")
    base = [F.coalesce(F.sum(F.when((F.col("shard") == i) & F.col("stays"), F.col("bytes"))), F.lit(0)).cast("long") for i in range(n_shards)]
    start = now.agg(F.array(*base).alias("start"), F.max("next").alias("next"))
    movers = now.where(~F.col("stays") & ~F.col("even")).select("vslot", "bytes").crossJoin(F.broadcast(start))
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("vslot"))))

    def step(acc: Column, s: Column) -> Column:
        pick = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda b, i: F.when(i == pick, b - s["neg"]).otherwise(b)).alias("loads"),
            F.concat(acc["owner"], F.array(pick)).alias("owner"),
        )

    moved = (
        movers.groupBy("start", "next").agg(order.alias("order"))
        .select("next", "order", F.aggregate("order", F.struct(F.col("start").alias("loads"), F.array().cast("array<int>").alias("owner")), step).alias("dealt"))
        .select("next", F.explode(F.arrays_zip(F.col("order.vslot").alias("vslot"), F.col("dealt.owner").alias("shard"))).alias("x"))
        .select(F.col("next").alias("version"), F.col("x.vslot").alias("vslot"), F.col("x.shard").alias("shard"))
    )
    spread = now.where("even").select(F.col("next").alias("version"), "vslot", _even(n_shards).alias("shard"))
    return kept.select(F.col("next").alias("version"), "vslot", "shard").unionByName(moved).unionByName(spread)


def save_map(shard_map: DataFrame, path: str) -> None:
    """Append one version of the map to the map table at ``path``."""
    shard_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the latest by default."""
    stored = spark.read.parquet(path).select("version", "vslot", "shard")
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def place(recs: DataFrame, loads: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Shard of every record and its gapless position within the shard.

    Positions are counted per virtual slot and shifted by the rows of the
    shard's earlier slots, so no task sorts a whole shard.  A record whose slot
    the map lacks is kept, without a shard; ``rebalance`` adds such slots."""
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    spots = (
        shard_map.select("vslot", "shard").join(F.broadcast(loads), "vslot", "left")
        .select("vslot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        recs.withColumn("n", F.row_number().over(within))
        .join(F.broadcast(spots), "vslot", "left")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), "vslot")
    )


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, vslot of every record, with shards of near-equal bytes.

    Records are placed by the latest version of the map stored at ``map_path``; where none is given, a first version is
    made from their loads and stored beside the other tables of the session."""
    recs = durable(records(docs, id_col, text_col), "shard-slots")
    loads = durable(slot_loads(recs), "shard-loads")
    if map_path is None:
        map_path = table_path(docs.sparkSession, "shard-map")
        save_map(first_map(loads, n_shards), map_path)
    return place(recs, loads, load_map(docs.sparkSession, map_path))

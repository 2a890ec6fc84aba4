"""Mixing sources to target weights.

Words of each source are packed, document after document, into blocks of
``block_words``.  A source's target is turned into slots (block reads).  Every output
shard draws its counts by source from a multinomial over all sources, the last shards
corrected to the targets.  A shard reads as many slots as it drew from its own stretch
of the source's index space, so the draw decides what is read; each slot is mapped to a
block by the source's own pseudorandom index permutation (a Feistel network, one key per
pass over the source), and blocks are joined to slots by index.  The last slot of a
source reads only as many words as the target still lacks, so a source's words come out
at its target rounded to a whole word.

Nothing is collected but sums of the source table; a source that holds a third of
all rows is packed in ``PACK_CHUNKS`` separate ranges.

Edge cases: null texts have size 0; documents of size 0 are never read and take
part with taken 0; a null source is a source, last in order; repeated rows are
separate documents; an empty table gives an empty result; other columns are
ignored (``mixed_texts`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.storage import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block.
BLOCK_WORDS = 512
#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: All words taken, as a share of all words there.
TOTAL_SHARE = 1.5
#: No source is read more often than this.
MAX_PASSES = 2.0
#: Ranges in which a source is packed; bounds the rows sorted by one task.
PACK_CHUNKS = 4096
#: Output shards at least, and slots of a shard at most.
N_SHARDS, SHARD_SLOTS = 64, 1 << 16
SEED = 20240229
_SLOT_CHUNK = 1 << 16


def sized(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, source, size (words) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), *([F.col("text")] if keep_text else []))


def targets(docs_sized: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, passes: float = MAX_PASSES) -> DataFrame:
    """src (rank from 0), source, source_size, target: words shared by weight under the cap of each source.

    The common level is found by repeated sums over the source table; each round
    caps the sources above their limit and shares what is left by weight."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    per = durable(
        docs_sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", rank).withColumn("w", weight),
        "mix-sources",
    )
    cap = F.col("source_size") * F.lit(passes)
    total, w = per.agg(F.sum("source_size"), F.sum("w")).first()
    words, level, capped = share * (total or 0), 0.0, -1
    if total:
        level = words / w
        while True:
            over = cap < F.col("w") * F.lit(level)
            n, capsum, w = per.agg(
                F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.sum(F.when(~over, F.col("w")))
            ).first()
            if n == capped or not w:
                break
            level, capped = (words - capsum) / w, n
    return per.select("src", "source", "source_size", F.least(cap, F.col("w") * F.lit(level)).cast("double").alias("target"))


def packed(docs_sized: DataFrame, per_source: DataFrame, chunks: int = PACK_CHUNKS) -> DataFrame:
    """Documents with words, with ``src`` and ``off``, the place of their first word in the source's stream."""
    rows = (
        docs_sized.where("size > 0")
        .join(per_source.select(F.col("source").alias("s"), "src"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)).cast("int"))
    )
    # sums per range first: at most `chunks` rows a source
    starts = rows.groupBy("src", "chunk").agg(F.sum("size").alias("words")).withColumn(
        "start", F.sum("words").over(Window.partitionBy("src").orderBy("chunk")) - F.col("words")
    ).drop("words")
    inner = Window.partitionBy("src", "chunk").orderBy("doc_id", "size")
    run = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("run", run).join(starts, ["src", "chunk"]).withColumn("off", F.col("start") + F.col("run")).drop("run", "start", "chunk")


def blocks(docs_packed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The pieces of documents in each block: src, block, off, doc_id, size, lo and hi (words within the block)."""
    first, last = F.floor(F.col("off") / block_words), F.floor((F.col("off") + F.col("size") - 1) / block_words)
    each = docs_packed.select("src", "off", "doc_id", "size", F.explode(F.sequence(first, last)).alias("block"))
    at = F.col("block") * block_words
    return each.select(
        "src", "block", "off", "doc_id", "size",
        F.greatest(F.col("off") - at, F.lit(0)).alias("lo"),
        F.least(F.col("off") + F.col("size") - at, F.lit(block_words)).alias("hi"),
    )


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of range(n) sends each index: four Feistel rounds, walked until inside the range."""
    if n <= 1:
        return index.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = _mix64(np.uint64(key & (2**64 - 1)) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                left, right = right, left ^ (_mix64(right + k) & mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def _key(source: str | None, epoch: int, seed: int) -> int:
    h = seed * 1_000_003 + epoch * 7_919 + (0 if source is None else 1)
    for b in (source or "").encode():
        h = (h * 1_099_511_628_211 ^ b) & (2**64 - 1)
    return h


def streams(per_source: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """src, source, full, blocks, short, passes, part, room, slots, cut: what is read of each source, in two parts.

    Part 0 holds the passes that read every block (``room`` = ``slots``), part 1 the pass that reads ``slots`` of the
    ``room`` full blocks, the last of them only up to ``cut`` words.  Words beyond the full blocks are in part 2: the one
    short block, read up to ``cut``."""
    size, words = F.col("source_size"), F.round("target").cast("long")
    rows = per_source.where("source_size > 0").select(
        "src", "source", F.floor(size / block_words).alias("full"), F.ceil(size / block_words).alias("blocks"),
        (size % block_words).alias("short"), F.floor(words / size).alias("passes"), F.pmod(words, size).alias("rest"),
    )
    inner = F.least(F.col("rest"), F.col("full") * block_words)
    part = lambda k, room, slots, cut: F.struct(F.lit(k).alias("part"), room.cast("long").alias("room"), slots.cast("long").alias("slots"), cut.cast("long").alias("cut"))
    each = F.array(
        part(0, F.col("passes") * F.col("blocks"), F.col("passes") * F.col("blocks"), F.lit(block_words)),
        part(1, F.col("full"), F.ceil(inner / block_words), inner - (F.ceil(inner / block_words) - 1) * block_words),
        part(2, F.lit(1), F.when(F.col("rest") > inner, 1).otherwise(0), F.col("rest") - inner),
    )
    return rows.withColumn("p", F.explode(each)).select("src", "source", "full", "blocks", "short", "passes", "p.*").where("slots > 0")


def drawn(read: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """The rows of ``streams`` for each shard, with ``lo`` (its stretch of the part's index space) and ``n`` (slots read from it).

    Every shard draws its counts by source from one multinomial over all of them.  A shard reads the first ``n`` indices of
    its own stretch; where the counts miss the target, the last shards' are corrected.  One row holds the source table: a
    few numbers a source."""
    names = ["src", "source", "part", "full", "blocks", "short", "passes", "room", "slots", "cut"]
    whole = read.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("all"))
    shards = read.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, k in zip(b.column("shard").to_pylist(), b.column("k").to_pylist(), strict=True):
                share = np.array(k, dtype=np.float64)
                total = share.sum()
                own = int(total * (shard + 1)) // n_shards - int(total * shard) // n_shards
                n = np.random.default_rng([seed, shard]).multinomial(own, share / total)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(n), shard, np.int32), "at": np.arange(len(n), dtype=np.int32), "n": n.astype(np.int64)})

    counts = shards.repartition(min(n_shards, 64), "shard").crossJoin(F.broadcast(whole.select(F.col("all.slots").alias("k")))).where(F.size("k") > 0)
    got = counts.mapInArrow(draw, "shard int, at int, n long")
    listed = whole.select(F.posexplode("all").alias("at", "r")).select("at", "r.*")
    all_read = F.col("room") == F.col("slots")  # then a shard's stretch is as long as its count
    rows = got.join(listed, "at").withColumn("lo", F.floor(F.col("room") * F.col("shard") / n_shards)).withColumn(
        "space", F.when(all_read, F.col("slots")).otherwise(F.floor(F.col("room") * (F.col("shard") + 1) / n_shards) - F.col("lo"))
    ).withColumn("n", F.least("n", "space"))
    # from the last shard backwards: what lacks is filled in, what is too much is taken away
    later = Window.partitionBy("at").orderBy(F.desc("shard")).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("slots") - F.sum("n").over(Window.partitionBy("at"))
    left = F.coalesce(F.sum(F.col("space") - F.col("n")).over(later), F.lit(0))
    gone = F.coalesce(F.sum("n").over(later), F.lit(0))
    more = F.greatest(F.lit(0), F.least(gap - left, F.col("space") - F.col("n")))
    less = F.greatest(F.lit(0), F.least(-gap - gone, F.col("n")))
    return rows.withColumn("n2", F.col("n") + more - less).withColumn("after", F.coalesce(F.sum("n2").over(later), F.lit(0))).select(
        "shard", *names, F.when(all_read, F.col("slots") - F.col("n2") - F.col("after")).otherwise(F.col("lo")).alias("lo"), F.col("n2").alias("n"), "after"
    ).where("n > 0")


def shards_of(slots_: int) -> int:
    """Output shards of a mix of so many slots: N_SHARDS, more where they would hold over SHARD_SLOTS."""
    return max(N_SHARDS, -(-slots_ // SHARD_SLOTS))


def slots(per_source: DataFrame, n_shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """shard, src, slot, epoch, block, words: which block each output slot reads, and how many of its words.

    A slot's number is unique within its source; its index in its part goes through the source's own permutation."""
    read = streams(per_source, block_words)
    total = read.agg(F.sum("slots")).first()[0] or 0
    n_shards = n_shards or shards_of(total)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                k = np.arange(r["lo"], r["hi"])
                take, full, passes = np.full(len(k), block_words), r["full"], r["passes"]
                if r["part"] == 0:
                    epoch, block = k // r["blocks"], k % r["blocks"]
                else:
                    epoch, block = np.full(len(k), passes), k + (r["part"] == 2) * full
                for e in np.unique(epoch):
                    inner = (epoch == e) & (block < full)
                    block[inner] = permute(block[inner], full, _key(r["source"], int(e), seed))
                take[block == full] = r["short"]
                if r["part"] and r["ends"]:
                    take[-1] = r["cut"]
                slot = k + (r["part"] > 0) * passes * r["blocks"] + (r["part"] > 1) * full
                same = {n: np.full(len(k), r[n], np.int32) for n in ("shard", "src")}
                yield pa.RecordBatch.from_pydict(same | {"slot": slot, "epoch": epoch.astype(np.int32), "block": block, "words": take})

    ranges = drawn(read, n_shards, seed).withColumn("end", F.col("lo") + F.col("n")).withColumn("lo", F.explode(F.sequence("lo", F.col("end") - 1, F.lit(_SLOT_CHUNK)))).withColumn(
        "hi", F.least("end", F.col("lo") + _SLOT_CHUNK)
    ).withColumn("ends", (F.col("after") == 0) & (F.col("hi") == F.col("end"))).select("shard", "src", "source", "part", "full", "blocks", "short", "passes", "cut", "lo", "hi", "ends")
    # a number of its own: the few short rows make all slots, and must not be put together into one task
    tasks = max(int(per_source.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (4 * _SLOT_CHUNK))
    return ranges.repartition(tasks, "shard", "src", "part", "lo").mapInArrow(mapped, "shard int, src int, slot long, epoch int, block long, words long")


def mix(pieces: DataFrame, per_source: DataFrame, n_shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix of ``blocks``: shard, src, slot, epoch, off, doc_id, size, lo, hi — the words [lo, hi) of a document read by a slot."""
    # the slots grow with the corpus though they are made from a few source rows: never broadcast
    read = slots(per_source, n_shards, block_words, seed).hint("merge").join(pieces, ["src", "block"])
    base = F.col("block") * block_words - F.col("off")
    return read.select(
        "shard", "src", "slot", "epoch", "off", "doc_id", "size",
        (base + F.col("lo")).alias("lo"), (base + F.least("hi", "words")).alias("hi"),
    ).where("hi > lo")


def taken(docs: DataFrame, n_shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix reads, repeats counted) of every document."""
    docs_sized = durable(sized(docs), "mix-sizes")
    per_source = targets(docs_sized)
    laid = durable(packed(docs_sized, per_source).select("doc_id", "source", "size", "src", "off"), "mix-packed")
    got = mix(blocks(laid, block_words), per_source, n_shards, block_words, seed).groupBy("src", "off").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    with_words = laid.join(got, ["src", "off"], "left").select("doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    without = docs_sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    per = per_source.select(F.col("source").alias("s"), "source_size", "target")
    return (
        with_words.unionByName(without).join(per, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


_CUT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"


def _laid(docs: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``packed`` documents with the columns ``names`` (as they are, in ``row``), and the targets."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    wide = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.struct(*[F.col(n) for n in names]).alias("row"))
    per_source = targets(durable(wide.select("doc_id", "source", "size"), "mix-sizes"))
    return packed(wide, per_source), per_source


def mixed_blocks(docs: DataFrame, n_shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, slot (unique within its source), source, doc_ids, n_words and text of every block that is read.

    Documents are packed into blocks of ``block_words`` (words parted by a space, the last block of a source shorter), and
    slots meet blocks by index."""
    laid, per_source = _laid(docs, ["text"])
    words = F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})"), F.lit(1))
    at = F.col("block") * block_words
    first, last = F.floor(F.col("off") / block_words), F.floor((F.col("off") + F.col("size") - 1) / block_words)
    pieces = laid.withColumn("all", words).withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(at - F.col("off"), F.lit(0))
    n = F.least(F.col("off") + F.col("size"), at + block_words) - F.col("off") - lo
    pieces = pieces.select("src", "source", "block", "off", "doc_id", F.slice("all", (lo + 1).cast("int"), n.cast("int")).alias("w"))
    whole = pieces.groupBy("src", "source", "block").agg(F.array_sort(F.collect_list(F.struct("off", "doc_id", "w"))).alias("p"))
    read = slots(per_source, n_shards, block_words, seed).hint("merge").join(whole, ["src", "block"])
    held = F.slice(F.flatten("p.w"), F.lit(1), F.col("words").cast("int"))
    return read.select("shard", "slot", "source", F.col("p.doc_id").alias("doc_ids"), F.size(held).alias("n_words"), F.array_join(held, " ").alias("text"))


def mixed_texts(docs: DataFrame, n_shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The documents as the mix reads them: for each pass that reads from a document one row, its text cut to the words read.

    Columns are those of ``docs``, of which ``text``, and ``n_chars`` if there, follow the cut; names used inside don't clash."""
    laid, per_source = _laid(docs, docs.columns)
    read = mix(blocks(laid, block_words), per_source, n_shards, block_words, seed)
    parts = read.groupBy("src", "off", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
    text = F.col("row.text")
    words = F.regexp_extract_all(text, F.lit(_CUT), F.lit(1))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), "")
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"]) == F.col("size")
    out = laid.join(parts, ["src", "off"]).withColumn("cut", F.when(whole, text).otherwise(F.ltrim(cut)))
    new = {"text": F.col("cut"), "n_chars": F.char_length("cut").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


SIZES_SQL = """
WITH n AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM n GROUP BY source),
c AS (SELECT source, source_size, w, 2.0 * source_size AS cap, 2.0 * source_size / w AS r FROM s),
-- the level at which the sources of a lower ratio are capped and the rest shared by weight: the first that fits
l AS (
  SELECT r, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c WHERE source_size > 0),
v AS (SELECT max(level) FILTER (WHERE level <= r) AS level FROM l)
SELECT n.doc_id, n.size, c.source_size, least(c.cap, c.w * coalesce(v.level, 0)) AS target
FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source, v
"""

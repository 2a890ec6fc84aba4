"""N-gram Jaccard join with a token-group matrix.

Documents of equal shingle sets form a class (a 64-bit set hash).  The work is on
classes:

1. *Order.*  A sketch counts documents per shingle bucket over the whole corpus;
   shingles are ordered rare first.  Two sets with Jaccard >= t share one of the
   first ``|S| - ceil(t |S|) + 1`` shingles in any common order, so only this head
   of each set is indexed, packed by hash range into binary rows.  A shingle that
   more than ``LIST`` documents may hold is dealt to several rows by a second hash.
2. *Leaders.*  The classes under one shingle are tried against its leader, one of
   ``LEADERS`` by the shingle's low bits (the leaders of a dealt shingle against the
   first of them); pairs that reach t by exact comparison are links, and linked
   classes form components.
3. *Token-group matrix.*  Classes in reach of another component under a shingle are
   partitioned into groups of similar ones: those whose most common shared shingle
   is the same, of like size, at most about ``MEMBERS`` classes and ``TOKENS``
   shingles a group.  The matrix holds a packed row for each group (``Group``): the union
   of its shingles and which members hold each.  A class asks the groups that hold a class
   of another component within its reach (by size and by the places of the shingle in
   both), the smaller component asking the larger.  Signatures (the hash ranges in which a
   set, or a group's union, has shingles) settle most asks without moving a set.  The
   overlap of the asking set with the union bounds its overlap with every member; only groups with
   ``|Q n U| >= t |Q|`` are opened: the overlap with each member is counted from the
   row, and one link is kept for each component newly reached.
4. *Components* of all links.

A group gives back at most as many links as it has askers and members, so a group of
near copies costs a few comparisons a member and no rows but its links.  Sets are
compared by their 64-bit hashes, which are written once, in buckets by class, for the
classes that share a shingle within reach.

Edge cases: null or empty texts have an empty set and link with nothing; texts of
fewer than ``k`` words are one shingle; rows that repeat an id are one document with
several texts; a null id stays null and takes its class's component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.components import components
from corvid.llm.shingles import mix64, shingle_sets
from corvid.storage import bucketed, buckets as n_buckets, durable

#: Buckets of the frequency sketch, as a power of two: grows with the corpus between these.
SKETCH_BITS = (16, 22)
_CHUNKS = 64
#: Postings held by a task before they are handed on, and about as many as one packed row's task gets.
_FLUSH, _BUCKET = 1 << 20, 4_000_000
#: Leaders tried under different shingles of a class.
LEADERS = 4
#: Classes under one shingle that one task takes; beyond it the shingle is dealt to several.
LIST = 1 << 16
#: Classes, and shingles, of one group of the token-group matrix.
MEMBERS, TOKENS = 256, 1 << 20
#: Askers of a group, or classes of a leader, that one task takes.
ASKERS = 4096
#: Bits of the filter that keeps sets nobody asks for out of the shuffle, as a power of two: at least 32 a class between these.
FILTER_BITS = (16, 28)


def needed(t: int, size: np.ndarray) -> np.ndarray:
    """Shingles of a set of this size that a partner must share: ceil(t% of size)."""
    return -(-(t * size) // 100)


def _bits(n: int, between: tuple[int, int]) -> int:
    """The power of two that holds eight times ``n``, between two bounds."""
    return min(between[1], max(between[0], (8 * n).bit_length()))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    return shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), k)


def _set_class(s: np.ndarray) -> int:
    """A hash of a whole set that doesn't depend on order."""
    with np.errstate(over="ignore"):
        a, b = mix64(s + np.uint64(0x51ED270B)).sum(), np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA0761D6478BD642F)))
        return int(mix64(np.array([a + b * np.uint64(3) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def _place(s: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of hashes, as an index."""
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def folded(arrays: DataFrame, how: str, dtype: str) -> list[tuple[int, bytes]]:
    """Arrays of equal chunks (chunk, data) added up as long or or-ed: one array a chunk, whatever the number of rows.

    The result has a bounded size (the caller's number of chunks times the chunk)."""
    op, wide = (np.add, np.int64) if how == "add" else (np.bitwise_or, dtype)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, dtype=dtype)
                total[chunk] = op(total[chunk], x) if chunk in total else x.astype(wide)
        if total:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(total), pa.int32()), "data": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    return [(r[0], bytes(r[1])) for r in arrays.repartition(16, "chunk").mapInArrow(fold, "chunk int, data binary").collect()]


def classes(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """doc_id, text_hash, n, cls of every document (chunk null), and the sketch arrays of each task (doc_id null, chunk and data set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        types = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n": pa.int64(), "cls": pa.int64(), "chunk": pa.int32(), "data": pa.binary()}
        seen = False
        for batch in batches:
            n, cls = [], []
            for s in _sets(batch, k):
                n.append(len(s))
                cls.append(_set_class(s) if len(s) else None)
                np.add.at(counts, _place(s, bits), 1)
            seen = True
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.int64()),
                    "chunk": pa.nulls(len(n), pa.int32()), "data": pa.nulls(len(n), pa.binary()),
                }
            )
        if seen:
            parts = [np.minimum(x, 65535).astype(np.uint16).tobytes() for x in np.split(counts, _CHUNKS)]
            none = pa.nulls(_CHUNKS, pa.int64())
            rest = {"chunk": pa.array(range(_CHUNKS), pa.int32()), "data": pa.array(parts, pa.binary())}
            yield pa.RecordBatch.from_pydict({"doc_id": none, "text_hash": none, "n": none, "cls": none} | rest, schema=pa.schema(types))

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, cls long, chunk int, data binary")


def frequencies(table: DataFrame, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sketch bucket a coarse rank by its document count (log scale, one byte), and the parts its shingles are dealt to."""
    counts = np.zeros(1 << bits, np.int64)
    width = len(counts) // _CHUNKS
    for chunk, data in folded(table.where("chunk is not null").select("chunk", "data"), "add", "uint16"):
        counts[chunk * width : (chunk + 1) * width] = np.frombuffer(data, np.int64)
    return np.minimum(255, np.log2(1 + counts) * 6).astype(np.uint8), np.clip(-(-counts // most), 1, 65535).astype(np.uint16)


def postings(docs: DataFrame, order, k: int, t: int, buckets: int, bits: int) -> DataFrame:
    """The head shingles of each class, packed: bucket, part (-1 unless dealt), tok (u32), doc (u16 into cls and size), pos (u16)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, parts = order.value
        seen: set[int] = set()
        held, held_cls, held_size, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            tok = np.concatenate(held)
            lens = np.array([len(x) for x in held])
            doc = np.repeat(np.arange(len(held)), lens)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)
            cls, size = np.array(held_cls, np.int64), np.array(held_size, np.int32)
            dealt = parts[_place(tok, bits)].astype(np.uint64)
            turn = mix64(cls.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))[doc]
            part = np.where(dealt > 1, (turn % dealt).astype(np.int64), -1)
            mixed = mix64(tok)
            key = ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) + (part + 1) * buckets
            by = np.argsort(key, kind="stable")
            keys, cuts = np.unique(key[by], return_index=True)
            out = {n: [] for n in ("bucket", "part", "tok", "doc", "pos", "cls", "size")}
            for q, i in zip(keys, np.split(by, cuts[1:]), strict=True):
                own, local = np.unique(doc[i], return_inverse=True)
                out["bucket"].append(q % buckets)
                out["part"].append(q // buckets - 1)
                out["tok"].append(mixed[i].astype(np.uint32).tobytes())
                out["doc"].append(local.astype(np.uint16).tobytes())
                out["pos"].append(np.minimum(pos[i], 65535).astype(np.uint16).tobytes())
                out["cls"].append(cls[own].tobytes())
                out["size"].append(size[own].tobytes())
            return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int32() if n in ("bucket", "part") else pa.binary()) for n, v in out.items()})

        for batch in batches:
            for s in _sets(batch, k):
                if not len(s):
                    continue
                c = _set_class(s)
                if c in seen:
                    continue
                if len(seen) < 1_000_000:  # copies within a task are sent once; beyond this, once more
                    seen.add(c)
                head = len(s) - int(needed(t, np.int64(len(s)))) + 1
                by = np.argsort(rank[_place(s, bits)], kind="stable")
                held.append(s[by[:head]])
                held_cls.append(c)
                held_size.append(len(s))
                total += head
                if total >= _FLUSH or len(held) == 65535:
                    yield flush()
                    held, held_cls, held_size, total = [], [], [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, part int, tok binary, doc binary, pos binary, cls binary, size binary")


def _fit(z, m, z2, m2, t: int):
    """Whether two sets can reach t through a shingle, by their sizes z and the largest partners m they can have."""
    return (100 * z >= t * z2) & (100 * z2 >= t * z) & (m >= z2) & (m2 >= z)


def leaders_and_lists(posted: DataFrame, t: int, most: int) -> DataFrame:
    """Per bucket: pairs (a, b) of each class with its leader under a shingle, and the shingles (lid) of three classes or
    more, packed: c (class), z (size), m (the largest partner the class can have through the shingle), n (classes there).

    Dealt shingles are listed whole, and their leaders (lead) in rows of their own."""

    def reduce(table: pa.Table) -> pa.Table:
        bucket, dealt = table.column("bucket")[0].as_py(), table.column("part")[0].as_py() >= 0
        col = {n: [np.frombuffer(x, d) for x in table.column(n).to_pylist()] for n, d in (("tok", np.uint32), ("doc", np.uint16), ("pos", np.uint16), ("cls", np.int64), ("size", np.int32))}
        tok = np.concatenate(col["tok"])
        cls = np.concatenate([c[d] for c, d in zip(col["cls"], col["doc"], strict=True)])
        size = np.concatenate([c[d] for c, d in zip(col["size"], col["doc"], strict=True)]).astype(np.int64)
        pos = np.concatenate(col["pos"]).astype(np.int64)
        del col
        # |x n y| >= t/(1+t) (|x|+|y|) and |x n y| <= |x| - pos bound the partner's size
        reach = (size - pos) * (100 + t) // t - size
        turn = mix64(cls.view(np.uint64) + (tok.astype(np.uint64) % np.uint64(LEADERS)) * np.uint64(0x9E3779B97F4A7C15))
        by = np.lexsort((pos, turn, tok))
        tok, cls, size, reach = tok[by], cls[by], size[by], reach[by]
        fresh = np.ones(len(tok), bool)
        fresh[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
        tok, cls, size, reach = tok[fresh], cls[fresh], size[fresh], reach[fresh]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.empty(0, np.int64)
        count = np.diff(np.r_[start, len(tok)])
        lead = np.repeat(start, count)
        fits = (np.arange(len(tok)) != lead) & _fit(size, reach, size[lead], reach[lead], t)
        pairs = np.unique(np.stack([cls[fits], cls[lead[fits]]], 1), axis=0)
        lid, length, packed, first = [], [], ([], [], []), []
        listed = np.ones(len(start), bool) if dealt else count > 2
        for s, n in zip(start[listed], count[listed], strict=True):
            c, z, m = cls[s : s + n], size[s : s + n], reach[s : s + n]
            if not dealt:
                # an entry no other can reach by size is dropped
                zs = np.sort(z)
                near = np.searchsorted(zs, np.minimum(m, z * 100 // t), "right") - np.searchsorted(zs, needed(t, z), "left")
                live = near > (m >= z)
                if live.sum() < 2:
                    continue
                c, z, m = c[live], z[live], m[live]
            for lo, hi, is_lead in [(0, len(c), False)] + [(0, 1, True)] * dealt:
                lid.append((bucket << 32) + int(tok[s]))
                length.append(most if dealt else int(n))
                first.append(is_lead)
                for out, x in zip(packed, (c, z, m), strict=True):
                    out.append(x[lo:hi].tobytes())
        n, k = len(pairs), len(lid)
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(pairs[:, 0], pa.int64()), pa.nulls(k, pa.int64())]),
                "b": pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(k, pa.int64())]),
                "lid": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(lid, pa.int64())]),
                "n": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(length, pa.int64())]),
                "lead": pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(first, pa.bool_())]),
                **{name: pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(x, pa.binary())]) for name, x in zip("czm", packed, strict=True)},
            }
        )

    return posted.groupBy("bucket", "part").applyInArrow(reduce, "a long, b long, lid long, n long, lead boolean, c binary, z binary, m binary")


def _entries(lists: DataFrame) -> DataFrame:
    """lid, n, c, z, m: the lists, one row an entry."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lid, n, *cols in zip(*[batch.column(x).to_pylist() for x in ("lid", "n", "c", "z", "m")], strict=True):
                c, z, m = (np.frombuffer(x, np.int64) for x in cols)
                yield pa.RecordBatch.from_pydict({"lid": np.full(len(c), lid), "n": np.full(len(c), n), "c": c, "z": z, "m": m})

    return lists.select("lid", "n", "c", "z", "m").mapInArrow(spread, "lid long, n long, c long, z long, m long")


def led(found: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of the leaders of a dealt shingle's parts with the first of them."""
    leads = _entries(found.where("lead")).withColumn("turn", F.xxhash64("c", F.pmod("lid", F.lit(LEADERS))))
    first = leads.groupBy("lid").agg(F.min(F.struct("turn", "c", "z", "m")).alias("f"))
    fits = _fit(F.col("z"), F.col("m"), F.col("f.z"), F.col("f.m"), t)
    return leads.join(first, "lid").where(fits & (F.col("c") != F.col("f.c"))).select(F.col("c").alias("a"), F.col("f.c").alias("b"))


def _asked(spark: SparkSession, ids: DataFrame):
    """A filter of the class ids in ``ids`` (column c): false for a class that is surely not among them."""
    bits = _bits(4 * ids.count(), FILTER_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(1 << bits, np.uint8)
        for b in batches:
            m[_place(mix64(b.column("c").to_numpy().view(np.uint64)), bits)] = 1
        packed = np.split(np.packbits(m), _CHUNKS)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([i for i, x in enumerate(packed) if x.any()], pa.int32()), "data": pa.array([x.tobytes() for x in packed if x.any()], pa.binary())})

    whole = np.zeros((1 << bits) // 8, np.uint8)
    width = len(whole) // _CHUNKS
    for chunk, data in folded(ids.mapInArrow(mark, "chunk int, data binary"), "or", "uint8"):
        whole[chunk * width : (chunk + 1) * width] = np.frombuffer(data, np.uint8)
    return spark.sparkContext.broadcast((bits, whole))


def class_sets(docs: DataFrame, asked, k: int) -> DataFrame:
    """cls and its sorted shingles (eight bytes each) of every class the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = asked.value
        seen: set[int] = set()
        for batch in batches:
            cls, data, size = [], [], 0
            for s in _sets(batch, k):
                if not len(s):
                    continue
                c = _set_class(s)
                slot = int(mix64(np.array([c], np.int64).view(np.uint64))[0] >> np.uint64(64 - bits))
                if c in seen or not packed[slot >> 3] >> (7 - (slot & 7)) & 1:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                cls.append(c)
                data.append(s.tobytes())
                size += len(data[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "tokens": pa.array(data, pa.binary())})
                    cls, data, size = [], [], 0
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "tokens": pa.array(data, pa.binary())})

    # copies of a class in different tasks: any one of them is the set; dealt once, for ``bucketed``
    return docs.select("text").mapInArrow(run, "cls long, tokens binary").repartition(n_buckets(docs.sparkSession), "cls").dropDuplicates(["cls"])


def _u64(data) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """Which hash ranges a set has shingles in: four to eight ranges a shingle, a power of two, in order (true or false)."""
    bits = max(8, int(4 * len(s) - 1).bit_length())
    out = np.zeros(1 << bits, bool)
    out[_place(s, bits)] = True
    return out


def coarse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signatures in the ranges of the coarser one."""
    n = min(len(x), len(y))
    return x.reshape(n, -1).any(1), y.reshape(n, -1).any(1)


def signed(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (cls and others) with the size and the packed signature of their set; the set itself doesn't move."""
    names = rows.columns
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = [_u64(x.as_buffer()) for x in b.column("tokens")]
            new = {"n": pa.array([len(x) for x in sets_], pa.int64()), "sign": pa.array([np.packbits(signature(x)).tobytes() for x in sets_], pa.binary())}
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in names} | new)

    return rows.join(sets, "cls").select(*names, "tokens").mapInArrow(run, f"{kept}, n long, sign binary")


def _bools(sign) -> np.ndarray:
    return np.unpackbits(np.frombuffer(sign.as_buffer(), np.uint8)).astype(bool)


def _led_rows(pairs: DataFrame) -> DataFrame:
    """cls, b, part, a: for each leader and part a row of its own (a null), and its classes, ASKERS to a part."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("long").alias("parts"))
    leads = parts.select(F.col("b").alias("cls"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"))
    return leads.unionByName(pairs.join(parts, "b").select(F.col("a").alias("cls"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), "a"))


def _met(rows: DataFrame, key: tuple[str, str], asker: str) -> DataFrame:
    """``rows`` dealt by ``key``, what is asked before the askers."""
    return rows.repartition(*key).sortWithinPartitions(*key, F.col(asker).asc_nulls_first())


def likely_pairs(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for t: each range that one set has and the other has not is a shingle they don't share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, size = np.zeros(1, bool), 0
        for b in batches:
            keep = []
            for a, n, sign in zip(b.column("a").to_pylist(), b.column("n").to_pylist(), b.column("sign"), strict=True):
                x = _bools(sign)
                if a is None:
                    lead, size = x, n
                    keep.append(False)
                    continue
                x, y = coarse(x, lead)
                most = min(n - int((x & ~y).sum()), size - int((y & ~x).sum()))
                keep.append((100 + t) * most >= t * (n + size))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _met(signed(_led_rows(pairs), sets), ("b", "part"), "a").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b: a class and its leader) whose sets reach the threshold, compared exactly.

    A leader's set meets the sets of its classes, ASKERS at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.empty(0, np.uint64)
        for b in batches:
            keep = []
            for a, x in zip(b.column("a").to_pylist(), b.column("tokens"), strict=True):
                x = _u64(x.as_buffer())
                if a is None:  # the leader stands before its classes
                    lead = x
                    keep.append(False)
                    continue
                n = int((lead[np.minimum(np.searchsorted(lead, x), len(lead) - 1)] == x).sum())
                keep.append(100 * n >= t * (len(x) + len(lead) - n))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = _led_rows(pairs).join(sets, "cls").select("b", "part", "a", "tokens")
    return _met(rows, ("b", "part"), "a").mapInArrow(compare, "a long, b long")


def matrix_asks(lists: DataFrame, components_: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """Members (c, z, g, grp: a class, its size, component and group of the matrix) and asks (q, qz, g, grp: which class asks which group)."""
    sized = components_.join(components_.groupBy("component").agg(F.count(F.lit(1)).alias("gn")), "component")
    placed = _entries(lists).join(sized, F.col("c") == F.col("node"), "left").select("lid", "n", "c", "z", "m", F.coalesce("component", "c").alias("g"), F.coalesce("gn", F.lit(1)).alias("gn"))
    # a list all in one component is settled
    mixed = placed.groupBy("lid").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("lid")
    placed = durable(placed.join(mixed, "lid", "left_semi"), "ngram-placed")
    # at home under the most common shingle
    homes = placed.groupBy("c").agg(F.max(F.struct("n", "lid"))["lid"].alias("home"), F.first("z").alias("z"), F.first("g").alias("g"), F.first("gn").alias("gn"))
    homes = homes.withColumn("bin", F.floor(F.log("z") / F.log(F.lit(4 / 3))))
    parts = homes.groupBy("home", "bin").agg(F.ceil(F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum("z") / TOKENS)).alias("parts"))
    members = homes.join(parts, ["home", "bin"]).withColumn("grp", F.xxhash64("home", "bin", F.pmod(F.xxhash64("c"), F.col("parts"))))
    members = durable(members.select("c", "z", "g", "gn", "home", "grp"), "ngram-members")
    rank = F.struct("gn", "g")
    # which homes a class can reach under a shingle, then which of their groups
    there = placed.join(members.select("c", "home"), "c").groupBy("lid", "home").agg(
        F.min("z").alias("z0"), F.max("z").alias("z1"), F.max("m").alias("m1"), F.max(rank).alias("top"))
    can = (F.col("m") >= F.col("z0")) & (F.col("m1") >= F.col("z")) & (100 * F.col("z") >= t * F.col("z0")) & (100 * F.col("z1") >= t * F.col("z")) & (F.col("top") > rank)
    homely = placed.join(there, "lid").where(can).groupBy("c", "home").agg(*[F.first(x).alias(x) for x in ("z", "g", "gn")])
    groups = members.groupBy("home", "grp").agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.max(rank).alias("top"))
    fits = (100 * F.col("z") >= t * F.col("z0")) & (100 * F.col("z1") >= t * F.col("z")) & (F.col("top") > rank)
    asks = homely.join(groups, "home").where(fits).select(F.col("c").alias("q"), F.col("z").alias("qz"), "g", "grp")
    return members, durable(asks, "ngram-asks")


class Group:
    """A packed row of the token-group matrix: the members' classes, sizes and components, the union of their shingles, and
    for each of those the members that hold it (``holders`` from ``at``)."""

    def __init__(self, members: list[tuple[int, int, int, np.ndarray]]):
        ids, z, g, sets = zip(*members, strict=True)
        self.ids, self.z, self.g = (np.array(x, np.int64) for x in (ids, z, g))
        x = np.concatenate(sets)
        by = np.argsort(x, kind="stable")
        self.holders = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])[by]
        self.union, at = np.unique(x[by], return_index=True)
        self.at = np.r_[at, len(x)]

    def near(self, tokens: np.ndarray, t: int) -> np.ndarray:
        """Indices of the members that reach t with a set; none are counted unless the bound lets the group be opened."""
        place = np.searchsorted(self.union, tokens)
        place = place[self.union[np.minimum(place, len(self.union) - 1)] == tokens]
        if 100 * len(place) < t * len(tokens):  # no member can share more than the union does
            return place[:0]
        lo, n = self.at[place], self.at[place + 1] - self.at[place]
        ends = np.cumsum(n)
        both = np.bincount(self.holders[np.repeat(lo - ends + n, n) + np.arange(ends[-1])], minlength=len(self.ids))
        return np.flatnonzero(100 * both >= t * (len(tokens) + self.z - both))


def _asking_rows(members: DataFrame, asks: DataFrame) -> DataFrame:
    """cls, grp, turn, q, z, g: the members of each group that is asked (q null), for each turn of its askers, and those, ASKERS to a turn."""
    turns = asks.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / ASKERS, F.sum("qz") / (8 * TOKENS))).alias("turns"))
    here = members.join(turns, "grp").select(
        F.col("c").alias("cls"), "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(None).cast("long").alias("q"), "z", "g")
    return here.unionByName(asks.join(turns, "grp").select(F.col("q").alias("cls"), "grp", F.pmod(F.xxhash64("q"), F.col("turns")).alias("turn"), "q", F.col("qz").alias("z"), "g"))


def likely_asks(members: DataFrame, asks: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The asks (q, qz, g, grp) that the group's signature, the ranges in which its union has shingles, leaves room for t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, union = None, None
        for b in batches:
            keep = []
            for grp, turn, q, n, sign in zip(*[b.column(x).to_pylist() for x in ("grp", "turn", "q", "n")], b.column("sign"), strict=True):
                x = _bools(sign)
                if (grp, turn) != now:
                    now, union = (grp, turn), None
                if q is None:
                    union = x if union is None else np.logical_or(*coarse(union, x))
                    keep.append(False)
                    continue
                x, y = coarse(x, union)
                keep.append(100 * (n - int((x & ~y).sum())) >= t * n)
            yield b.select(["q", "z", "g", "grp"]).filter(pa.array(keep, pa.bool_())).rename_columns(["q", "qz", "g", "grp"])

    return _met(signed(_asking_rows(members, asks), sets), ("grp", "turn"), "q").mapInArrow(run, "q long, qz long, g long, grp long")


def opened(members: DataFrame, asks: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Links (a, b) of askers with members of the groups that the bound lets them open: one for each component newly reached.

    The matrix is made where the askers of a group come, ASKERS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, group, root = None, [], None, {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for b in batches:
            found = []
            for grp, turn, q, cls, z, g, tokens in zip(*[b.column(n).to_pylist() for n in ("grp", "turn", "q", "cls", "z", "g")], b.column("tokens"), strict=True):
                tokens = _u64(tokens.as_buffer())
                if (grp, turn) != now:
                    now, held, group, root = (grp, turn), [], None, {}
                if q is None:  # the members stand before their askers
                    held.append((cls, z, g, tokens))
                    continue
                if group is None:
                    group, held = Group(held), []
                hit = group.near(tokens, t)
                _, one = np.unique(group.g[hit], return_index=True)
                for j in hit[one]:
                    x, y = find(g), find(int(group.g[j]))
                    if x != y:
                        root[x] = y
                        found.append((q, int(group.ids[j])))
            a, c = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64())})

    rows = _asking_rows(members, asks).join(sets, "cls").select("grp", "turn", "q", "cls", "z", "g", "tokens")
    return _met(rows, ("grp", "turn"), "q").mapInArrow(run, "a long, b long")


def grown(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after more links: the known ones count as links to their least node, so the rounds start from stars."""
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, most: int = LIST) -> DataFrame:
    """doc_id, n_shingles, component_id, label (one for each component, null for empty sets) and text_hash of every document: Jaccard of k-word shingles >= percent / 100."""
    spark = docs.sparkSession
    slim = _with_text(docs, id_col, text_col)
    bits = _bits(slim.count(), SKETCH_BITS)
    table = durable(classes(slim, k, bits), "ngram-classes")
    rows = table.where("chunk is null").select("doc_id", "text_hash", "n", "cls")
    order = spark.sparkContext.broadcast(frequencies(table, bits, most))
    heads = rows.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(heads) // _BUCKET)
    found = durable(leaders_and_lists(postings(slim, order, k, percent, buckets, bits), percent, most), "ngram-lists")
    lists = found.where("not lead")
    pairs = durable(found.where("a is not null").select("a", "b").unionByName(led(found, percent)).distinct(), "ngram-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).unionByName(_entries(lists).select("c")).distinct()
    sets = bucketed(class_sets(slim, _asked(spark, durable(ids, "ngram-live")), k), "ngram-sets", "cls")
    groups = durable(components(linked(durable(likely_pairs(pairs, sets, percent), "ngram-likely"), sets, percent)), "ngram-groups")
    members, asks = matrix_asks(lists, groups, percent)
    asks = durable(likely_asks(members, asks, sets, percent), "ngram-likely-asks")
    if not asks.isEmpty():
        groups = grown(groups, durable(opened(members, asks, sets, percent), "ngram-opened"))
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    labelled = least.join(groups, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("component", "cls").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = labelled.join(firsts, "label").select(F.col("cls").alias("k"), "component_id", "label")
    return rows.join(by_class, F.col("cls") == F.col("k"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "label", "text_hash"
    )


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.a, r.c FROM p JOIN r ON p.b = r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

"""Prefix trie of conversations, by an LCP-aware external mergesort.

Turns become 128-bit marks of role and text, conversations become strings of marks, and the
trie's nodes are the distinct prefixes of these strings.  Strings are cut into segments of
``SEGMENT`` turns, each beneath a root that stands for all turns before it, so that no row
grows with a conversation; equal segments are counted first, so that none grows with a group
of copies.

* Runs: every Arrow batch is sorted, each string with the length of its common prefix (LCP)
  with the one before it, and written to the shared folder.
* Merge: strings are dealt to sorted ranges of about ``RANGE`` rows.  In a range, a loser
  tree merges the runs: of two heads the one that shares more turns with the last string put
  out is the smaller, and only equal LCPs are compared, from there on.
* Trie: the merged stream keeps the open path as a stack.  A string closes the nodes
  beyond its LCP, which are finished, and opens its own.  A range knows how much it shares with
  its neighbours (two numbers a range, which are broadcast), so a node that spans ranges is put
  out in parts that add up.

Totals of a lower segment's root are handed to the segment above, deepest level first; a
root with one conversation needs no merge, so there are as many levels as turns that two
conversations share, divided by ``SEGMENT``.

Edge cases: a null role or text counts as empty; turns are ordered by turn (null first), equal
ones by a hash of role and text; repeated rows are turns of their own; turns without a conv_id
belong to no conversation and are left out; a conversation without turns after rebuilding is a
member of the root alone; an empty table gives an empty result; extra columns are ignored.
``c - c % 20`` takes the remainder's sign from c, as SQL does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators import ranges
from corvid.storage import durable

#: Turns of a segment, and segments of a range of the merge (their mean).
SEGMENT, RANGE = 512, 8192
#: Conversations whose first turns a conversation may take over.
FAMILY, TAKEN = 20, 4
MARK = 16
#: Characters of a piece of a list of ids.
PIECE = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv, place (from 1), mark (128 bits of role and text) and words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    each = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("mark"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return ranges.ranked(each, [F.col("turn").asc_nulls_first(), F.col("mark")], "place", ("conv",)).drop("turn")


def _taken(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(TAKEN))


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv, size (turns of the rebuilt conversation), pos (from 0), mark, words; a row of pos -1 for every conversation."""
    first = F.when(F.col("place") < TAKEN, F.struct("place", "mark", "words"))
    convs = durable(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(first)).alias("head")), "trie-heads")
    convs = convs.withColumn("h", _taken(F.col("conv")))
    heads = convs.select(F.col("conv").alias("from"), F.col("head").alias("lent"))
    convs = convs.withColumn("from", F.col("conv") - F.col("conv") % FAMILY).join(heads, "from", "left")
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<place:bigint,mark:binary,words:bigint>>"))
    convs = convs.select("conv", "h", lent.alias("lent"), (F.size(lent) + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size"))
    convs = durable(convs, "trie-conversations")
    own = placed.where(F.col("place") > _taken(F.col("conv"))).join(convs.select("conv", "size", "h", F.size("lent").alias("n_lent")), "conv")
    own = own.select("conv", "size", (F.col("place") - 1 - F.col("h") + F.col("n_lent")).alias("pos"), "mark", "words")
    lent = convs.select("conv", "size", F.posexplode("lent").alias("pos", "t")).select("conv", "size", F.col("pos").cast("long").alias("pos"), "t.mark", "t.words")
    none = convs.select("conv", "size", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("long").alias("words"))
    return own.unionByName(lent).unionByName(none)


def _node(root: Column, seq: Column) -> Column:
    return F.unhex(F.md5(F.concat(root, F.unhex(F.md5(seq)))))


def _node_of(root: bytes, seq: bytes) -> bytes:
    return hashlib.md5(root + hashlib.md5(seq).digest()).digest()


def _roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Roots of segments, from rows in order of (conv, level)."""
    conv, root = None, bytes(MARK)
    for f in frames:
        found = []
        for c, digest in zip(f["conv"], f["digest"], strict=True):
            if c != conv:
                conv, root = c, bytes(MARK)
            found.append(root)
            root = hashlib.md5(root + bytes(digest)).digest()
        yield pd.DataFrame({"conv": f["conv"], "level": f["level"], "root": found})


def segments(turned: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv, level, root, seq (marks of the segment's turns), words (array), last (the conversation ends in it)."""
    n = int(turned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = F.floor(F.greatest(F.col("pos"), F.lit(0)) / segment).cast("int")
    # dealt by (conv, level) outright: a conversation with very many turns is many groups
    dealt = turned.withColumn("level", level).repartition(n, "conv", "level")
    held = F.sort_array(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "mark", "words"))))
    whole = dealt.groupBy("conv", "level").agg(F.max("size").alias("size"), held.alias("t")).where((F.size("t") > 0) | (F.col("size") == 0))
    seq = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["mark"])), ""))
    cut = whole.select("conv", "level", seq.alias("seq"), F.col("t.words").alias("words"), ((F.col("level") + 1) * segment >= F.col("size")).alias("last"), "size")
    cut = durable(cut, "trie-segments")
    short = cut.where(F.col("size") <= segment).withColumn("root", F.lit(bytes(MARK)))
    long = cut.where(F.col("size") > segment)
    digests = long.select("conv", "level", F.unhex(F.md5("seq")).alias("digest")).repartition(n, "conv").sortWithinPartitions("conv", "level")
    roots = digests.mapInPandas(_roots, "conv long, level int, root binary")
    return short.unionByName(long.join(roots, ["conv", "level"])).drop("size")


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Comma-joined ids of each node, in pieces, from rows in order of (node, conv)."""
    node, ids, size = None, [], 0
    made: list[tuple[bytes, int, str]] = []
    for f in frames:
        for k, c in zip(f["node"], f["conv"], strict=True):
            k = bytes(k)
            if ids and (k != node or size > PIECE):
                made.append((node, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            node = k
            ids.append(int(c))
            size += 12
        if made:
            yield pd.DataFrame(made, columns=["node", "conv", "ids"])
            made = []
    if ids:
        yield pd.DataFrame([(node, ids[0], ",".join(map(str, ids)))], columns=["node", "conv", "ids"])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's pieces, from rows in order of (node, conv)."""
    node, sha = None, None
    for f in frames:
        made = []
        for k, ids in zip(f["node"], f["ids"], strict=True):
            k = bytes(k)
            if k == node:
                sha.update(b",")
            else:
                if sha is not None:
                    made.append((node, sha.hexdigest()))
                node, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        yield pd.DataFrame(made, columns=["node", "ends"])
    if sha is not None:
        yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends"])


def ends(cut: DataFrame) -> DataFrame:
    """node and ends, the digest of the ids of the conversations that end there.

    Ids are sorted by ranges of (node, id) and joined to pieces there; a node's pieces then pass one digest in order, so
    that a node at which a third of all conversations end is read as a stream of a few long pieces."""
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = cut.where("last").select(_node(F.col("root"), F.col("seq")).alias("node"), "conv")
    pieces = at.repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv").mapInPandas(_pieces, "node binary, conv long, ids string")
    return pieces.repartition(n, "node").sortWithinPartitions("node", "conv").mapInPandas(_digests, "node binary, ends string")


def lcp_of(a: bytes, b: bytes, start: int = 0) -> int:
    """Marks that two strings share from their beginning, the first ``start`` known to be shared."""
    n = min(len(a), len(b)) // MARK
    step, i = 1, start
    while i < n:  # doubling steps while they agree, single ones after the first that does not
        j = min(n, i + step)
        if a[i * MARK : j * MARK] == b[i * MARK : j * MARK]:
            i, step = j, step * 2
        elif step == 1 or j == i + 1:
            break
        else:
            step = max(1, (j - i) // 2)
    return i


RUN_SCHEMA = "key binary, words array<long>, n_convs long, conv long, ends string, kids long, leaves long, saved long"


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each frame sorted by key, with run, place in it and LCP with the row before."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for i, f in enumerate(frames):
        f = f.assign(key=[bytes(k) for k in f["key"]]).sort_values("key", kind="stable", ignore_index=True)
        keys = f["key"].tolist()
        shared = [0, *(lcp_of(a, b) for a, b in zip(keys, keys[1:], strict=False))] if keys else []
        yield f.assign(run=task << 32 | i, place=range(len(f)), lcp=shared)


class Losers:
    """Merge of sorted runs by a loser tree that carries LCPs.  Gives (row, LCP with the row given before)."""

    def __init__(self, runs: list[list[int]], keys: list[bytes], lcps: list[int]) -> None:
        self.runs, self.keys, self.lcps = runs, keys, lcps
        self.n = 1
        while self.n < len(runs):
            self.n *= 2
        self.at = [0] * self.n
        self.tree = [(-1, -1)] * self.n  # run and LCP of the loser at each inner node
        heads = [(r, 0) if r < len(runs) and runs[r] else (r, -1) for r in range(self.n)]
        level, base = heads, self.n
        while len(level) > 1:  # first round: every head against the empty string
            base //= 2
            level = [self._play(level[2 * i], level[2 * i + 1], base + i) for i in range(base)]
        self.winner = level[0]

    def _play(self, a: tuple[int, int], b: tuple[int, int], node: int) -> tuple[int, int]:
        """The winner of two heads; the loser stays at ``node`` with its LCP with the winner.  An exhausted run has LCP -1."""
        if a[1] == b[1] and a[1] >= 0:
            x, y = (self.keys[self.runs[s][self.at[s]]] for s in (a[0], b[0]))
            shared = lcp_of(x, y, a[1])
            if y[shared * MARK :] < x[shared * MARK :]:
                a, b = b, a
            b = (b[0], shared)
        elif a[1] < b[1]:
            a, b = b, a
        self.tree[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        while self.winner[1] >= 0:
            run, shared = self.winner
            rows = self.runs[run]
            yield rows[self.at[run]], shared
            self.at[run] += 1
            now = (run, self.lcps[rows[self.at[run]]]) if self.at[run] < len(rows) else (run, -1)
            node = (self.n + run) // 2
            while node >= 1 and self.n > 1:
                now = self._play(now, self.tree[node], node)
                node //= 2
            self.winner = now


#: kind: 0 a finished node, 1 a part of a node that spans ranges, 2 (a part of) the totals of a segment's root.
NODE_SCHEMA = (
    "kind int, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)


class _Open:
    """A node of the open path."""

    __slots__ = ("conv", "ends", "kids", "leaf", "leaves", "n", "new", "saved", "shared", "told", "words")

    def __init__(self, words: int, new: bool, shared: bool) -> None:
        self.words, self.new, self.shared = words, new, shared
        self.n = self.kids = self.leaves = self.saved = 0
        self.conv, self.ends, self.leaf = None, None, True
        self.told: list[list] = []  # records of children, waiting for this node's least conversation


def trie_of(level: int, segment: int, frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one range of merged runs."""
    frame = frame.sort_values(["run", "place"], kind="stable", ignore_index=True)
    keys, words = [bytes(k) for k in frame["key"]], frame["words"].tolist()
    columns = [frame[c].tolist() for c in ("n_convs", "conv", "kids", "leaves", "saved")]
    endings = frame["ends"].tolist()
    runs = [g.tolist() for g in frame.groupby("run", sort=False).indices.values()]
    before, after = int(frame["lcp_in"].iloc[0]), int(frame["lcp_out"].iloc[0])
    lcps = frame["lcp"].tolist()
    out: list[list] = []
    path: list[_Open] = []
    last = b""

    def close() -> None:
        top, e = path.pop(), len(path)  # e marks of ``last`` stand before the node's own: e = 0 is the root
        if top.leaf:
            top.leaves += 1
        top.saved += (top.n - top.new) * top.words
        inner = level > 0 and e == 0
        name = None
        if inner or e == 0:
            name = last[:MARK]
        elif top.shared or e == segment or top.told:
            name = _node_of(last[:MARK], last[MARK : MARK * (e + 1)])
        for record in top.told:
            if top.shared or inner:
                record[2] = name
            else:
                record[5] = top.conv
            out.append(record)
        kind = 2 if inner else 1 if top.shared else 0
        record = [kind, name if kind or e == segment or e == 0 else None, None, level * segment + e, top.conv, None, top.n, top.kids, top.leaves, top.saved, top.ends]
        if path:
            under = path[-1]
            under.n += top.n
            under.conv = top.conv if under.conv is None else min(under.conv, top.conv)
            under.leaves += top.leaves
            under.saved += top.saved
            under.kids += top.new
            if kind == 1:  # parts meet later: the parent is told by name
                record[2] = last[:MARK] if e == 1 else _node_of(last[:MARK], last[MARK : MARK * e])
                out.append(record)
            else:
                under.told.append(record)
        else:
            out.append(record)

    for row, shared in Losers(runs, keys, lcps):
        key, start = keys[row], not last
        while len(path) > shared:
            close()
        for e in range(len(path), len(key) // MARK):
            if path:
                path[-1].leaf = False
            path.append(_Open(words[row][e - 1] if e else 0, not (start and e < before), start and e < before))
        last, top = key, path[-1]
        n, conv, kids, leaves, saved = (c[row] for c in columns)
        top.n += n
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends = endings[row]
        top.kids += kids
        top.leaves += leaves
        top.saved += saved
        top.leaf = top.leaf and not kids
    for e in range(min(after, len(path))):
        path[e].shared = True
    if path and after >= len(path):
        path[-1].leaf = False  # the next range goes on below it
    while path:
        close()
    # whole numbers that may be missing stay exact as objects
    return pd.DataFrame({name: pd.Series(col, dtype=object) for name, col in zip(_NAMES, zip(*out, strict=True), strict=True)} if out else {name: [] for name in _NAMES})


_NAMES = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        lcps = {
            name: [0 if a is None or b is None else lcp_of(bytes(a), bytes(b)) for a, b in zip(f[x], f[y], strict=True)]
            for name, x, y in (("lcp_in", "before", "first"), ("lcp_out", "last", "after"))
        }
        yield pd.DataFrame({"range": f["range"], **lcps})


def merged(rows: DataFrame, level: int, segment: int, per_range: int) -> DataFrame:
    """Nodes of one level, as ``NODE_SCHEMA``: runs, ranges, merges, and the parts of nodes that span ranges put together."""
    spark = rows.sparkSession
    runs = durable(rows.mapInPandas(_runs, RUN_SCHEMA + ", run long, place long, lcp int"), "trie-runs")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // per_range))
    dealt = durable(runs.repartitionByRange(n, "key").withColumn("range", F.spark_partition_id()), "trie-ranges")
    order = Window.orderBy("range")
    bounds = dealt.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    bounds = bounds.select("range", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    edges = bounds.mapInPandas(_edges, "range int, lcp_in int, lcp_out int")
    nodes = dealt.join(F.broadcast(edges), "range").groupBy("range").applyInPandas(lambda f: trie_of(level, segment, f), NODE_SCHEMA)
    nodes = durable(nodes, "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.where("kind > 0").groupBy("kind", "node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("ends").alias("ends")
    )
    return nodes.where("kind = 0").unionByName(parts)


def _lone(rows: DataFrame, segment: int) -> DataFrame:
    """Nodes of segments whose root has one conversation alone."""
    j = F.col("j") + 1
    at = rows.select("level", "root", "seq", "conv", "ends", F.size("words").alias("n"), F.posexplode("words").alias("j", "w"))
    ending = F.when((j == F.col("n")) & F.col("ends").isNotNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
    return at.select(
        F.lit(0).alias("kind"), F.when(j == segment, _node(F.col("root"), F.col("seq"))).alias("node"), F.when(j == 1, F.col("root")).alias("parent"),
        (F.col("level").cast("long") * segment + j).alias("depth"), F.col("conv").alias("conv_id"), F.when(j > 1, F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), ending.alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(j == F.col("n"), F.col("ends")).alias("ends"),
    )


def trie(conversations: DataFrame, segment: int = SEGMENT, per_range: int = RANGE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    cut = durable(segments(rebuilt(turns(conversations)), segment), "trie-segments")
    same = cut.groupBy("level", "root", F.md5("seq").alias("digest")).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.first("seq").alias("seq"), F.first("words").alias("words")
    )
    same = same.withColumn("node", _node(F.col("root"), F.col("seq"))).join(ends(cut), "node", "left").drop("digest")
    same = durable(same, "trie-distinct")
    deep = same.where("level > 0")
    members = durable(deep.groupBy("level", "root").agg(F.sum("n_convs").alias("m")), "trie-roots")
    levels = [r.level for r in members.where("m > 1").select("level").distinct().collect()]
    lone = deep.join(members.where("m = 1").select("level", "root"), ["level", "root"])
    nodes = _lone(lone, segment)
    # totals of roots whose segments are done: those of one conversation first, which has one way down and one leaf
    totals = members.where("m = 1").select("root", F.lit(1).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    for level in [*sorted(levels, reverse=True), 0]:
        rows = same.where(F.col("level") == level)
        if level:
            rows = rows.join(members.where((F.col("m") > 1) & (F.col("level") == level)).select("root"), "root")
        # only a full segment can be the root of others
        full = F.when(F.size("words") == segment, F.col("node"))
        rows = rows.join(totals.withColumnRenamed("root", "below"), full == F.col("below"), "left")
        none = {"kids": 0, "leaves": 0, "saved": 0}
        rows = rows.fillna(none).select(F.concat("root", "seq").alias("key"), "words", "n_convs", "conv", "ends", *none)
        found = durable(merged(rows, level, segment, per_range), "trie-level")
        nodes = nodes.unionByName(found.where("kind < 2"))
        totals = totals.unionByName(found.where("kind = 2").select(F.col("node").alias("root"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    nodes = durable(nodes, "trie-all")
    named = nodes.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    asked = nodes.where("parent is not null").join(named, "parent", "left").withColumn("parent_conv_id", F.col("found"))
    told = nodes.where("parent is null").withColumn("found", F.lit(None).cast("long"))
    return told.unionByName(asked).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")
    )


ORACLE_SQL = r"""
WITH RECURSIVE own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal id, a bit at a time
crc AS (
  SELECT c, CAST(c AS VARCHAR) AS s, CAST(0 AS INTEGER) AS k, CAST(4294967295 AS BIGINT) AS r FROM (SELECT DISTINCT c FROM own)
  UNION ALL
  SELECT c, s, k + 1, xor(u // 2, 3988292384 * (u % 2))
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(r, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE r END AS u
        FROM crc WHERE k < 8 * length(s))),
taken AS (SELECT c, xor(r, 4294967295) % 4 AS h FROM crc WHERE k = 8 * length(s)),
turned AS (
  SELECT t.c, o.i, o.role, o.text FROM taken t JOIN own o ON o.c = t.c - t.c % 20 AND o.i <= t.h
  UNION ALL
  SELECT o.c, o.i, o.role, o.text FROM own o JOIN taken t ON o.c = t.c AND o.i > t.h),
marked AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, md5(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text) AS m,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turned),
prefixes AS (
  SELECT c, d, words, md5(string_agg(m, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS node,
         md5(coalesce(string_agg(m, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS parent,
         d = count(*) OVER (PARTITION BY c) AS last FROM marked
  UNION ALL
  SELECT c, 0, 0, md5(''), NULL, c NOT IN (SELECT c FROM turned) FROM taken),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM prefixes GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
subtree AS (
  SELECT p.node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n LEFT JOIN kids k ON k.node = n.node JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN subtree s ON s.node = n.node
"""

"""Approximate nearest neighbours by score-aware quantisation, four-bit tables and exact reranking.

Unit vectors are cut into subspaces of two dimensions with 16 codewords each, and what is
left over is coded once more in the same way.  Codes and codewords minimise ``|r|^2 + (eta - 1) (r . x)^2`` over the residual r: the part of the
error along the vector, which moves high inner products most, weighs eta times as much.
Codewords are fitted on a bounded sample; every row is coded and written once, and stays where
it is: queries come to the rows, ``QUERIES`` at a time by broadcast (of that bounded size), and
each task scans the codes of its rows by summing 16-entry tables.  The best ``KEEP`` a query are
scored exactly, which gives a score to reach, as do the nearest found so far; then every row of
the block whose score by code plus the norm of its rest reaches it is scored exactly in double
precision, so that no neighbour is lost, however many near copies there are.  What is shuffled
are the few nearest that each task found for each query.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do null ids; vectors are searched among those of their own length (one index a length);
equal scores go to the smaller id, at the last place too; a query never finds its own id; an id
that stands for several vectors asks with the one of the smallest hash and is found by its
nearest, once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.vector_dedup import usable
from corvid.storage import durable

#: Vectors the codewords are fitted on, by the order of a hash.
SAMPLE = 8192
#: Candidates a query and block whose exact scores tell how far the others must reach.
KEEP = 128
#: More than single precision loses when table entries are summed.
_SLACK = 1e-4
#: Rows that a task scans at a time, and queries of one broadcast (for vectors of 64 numbers; fewer longer ones).
ROWS, QUERIES = 65_536, 65_536
#: Share of a vector's norm from which inner products count as high.
HIGH = 0.2


class Codes:
    """Codewords words[level, m, 16, width]: each level codes what the levels before it left over."""

    def __init__(self, words: np.ndarray, eta: float):
        self.words, self.eta = words, eta

    def parts(self, x: np.ndarray) -> np.ndarray:
        _, m, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors, all subspaces of the first level, then those of the next."""
        p = self.parts(x)
        left, out = p, []
        for words in self.words:
            codes = descend(p, left, words, self.eta, sweeps)
            left = left - words[np.arange(words.shape[0]), codes]
            out.append(codes)
        return np.concatenate(out, 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, dim: int) -> np.ndarray:
        """The vectors that codes stand for."""
        m = self.words.shape[1]
        x = sum(words[np.arange(m), codes[:, i * m : (i + 1) * m]] for i, words in enumerate(self.words))
        return x.reshape(len(codes), -1)[:, :dim]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with the codewords: (levels * m, 16, queries), float32."""
        t = np.einsum("qmw,lmcw->lmcq", self.parts(q), self.words)
        return t.reshape(-1, *t.shape[2:]).astype(np.float32)


def descend(p: np.ndarray, goal: np.ndarray, words: np.ndarray, eta: float, sweeps: int, codes: np.ndarray | None = None) -> np.ndarray:
    """Codes for ``goal`` by coordinate descent on the score-aware loss of vectors ``p``."""
    n, m, _ = p.shape
    rows = np.arange(n)
    if codes is None:
        codes = np.stack([((goal[:, j, None] - words[j]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    along = ((goal - words[np.arange(m), codes]) * p).sum((1, 2))
    for _ in range(sweeps):
        for j in range(m):
            r = goal[:, j, None] - words[j]
            a = (r * p[:, j, None]).sum(2)
            rest = along - a[rows, codes[:, j]]
            codes[:, j] = ((r**2).sum(2) + (eta - 1) * (rest[:, None] + a) ** 2).argmin(1)
            along = rest + a[rows, codes[:, j]]
    return codes


def fit(x: np.ndarray, width: int = 2, levels: int = 2, rounds: int = 4, seed: int = 5) -> Codes:
    """Codewords for unit vectors."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    m = -(-d // width)
    eta = max(1.0, (d - 1) * HIGH**2 / (1 - HIGH**2))
    own = Codes(np.zeros((levels, m, 16, width)), eta)
    p = own.parts(x)
    goal = p
    for words in own.words:
        for j in range(m):
            w = goal[rng.choice(len(x), 16, replace=len(x) < 16), j] + rng.normal(0, 1e-6, (16, width))
            for _ in range(6):
                c = ((goal[:, j, None] - w) ** 2).sum(2).argmin(1)
                n = np.bincount(c, minlength=16)[:, None]
                w = np.where(n > 0, np.stack([np.bincount(c, goal[:, j, k], 16) for k in range(width)], 1) / np.maximum(n, 1), w)
            words[j] = w
        codes = None
        for _ in range(rounds):
            codes = descend(p, goal, words, eta, 1, codes)
            along = ((goal - words[np.arange(m), codes]) * p).sum((1, 2))
            for j in range(m):
                x_j, g_j, c_j = p[:, j], goal[:, j], codes[:, j]
                rest = along - ((g_j - words[j][c_j]) * x_j).sum(1)
                aim = g_j + (eta - 1) * (rest + (g_j * x_j).sum(1))[:, None] * x_j
                for c in range(16):
                    mine = c_j == c
                    if mine.sum() > width:
                        left = mine.sum() * np.eye(width) + (eta - 1) * x_j[mine].T @ x_j[mine]
                        words[j, c] = np.linalg.solve(left, aim[mine].sum(0))
                along = rest + ((g_j - words[j][c_j]) * x_j).sum(1)
        codes = descend(p, goal, words, eta, 1, codes)
        goal = goal - words[np.arange(m), codes]
    return own


def _plain(b: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    column = b.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(b: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    x = _plain(b, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(rows: DataFrame, codes, dim: int) -> DataFrame:
    """vec_id, embedding, its codes, two to a byte, and the norm of what the codes leave over (of the unit vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b, dim)
                c = codes.value.encode(x)
                left = np.linalg.norm(x - codes.value.decode(c, dim), axis=1)
                c = np.pad(c, ((0, 0), (0, c.shape[1] % 2)))
                packed = c[:, ::2] << 4 | c[:, 1::2]
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "embedding": b.column("embedding"), "code": pa.array([r.tobytes() for r in packed], pa.binary()), "rest": pa.array(left, pa.float64())})

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, code binary, rest double")


def best_of(score: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the ``keep`` best scores, equal scores by smaller index."""
    if len(score) > keep:
        least = np.partition(score, len(score) - keep)[len(score) - keep]
        over = np.flatnonzero(score > least)
        return np.concatenate([over, np.flatnonzero(score == least)[: keep - len(over)]])
    return np.arange(len(score))


def nearest_of(about: np.ndarray, rest: np.ndarray, x: np.ndarray, unit: np.ndarray, q: np.ndarray, most: int, keep: int, reach: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Indices and exact scores of the ``most`` nearest rows to q, equal scores by smaller index; those below ``reach`` may be left out.

    The ``keep`` best by code give a score that the ``most`` nearest reach at least; every row that
    could reach it, by its score by code and the norm of its rest, is scored exactly."""
    first = best_of(about, max(keep, most))
    own = q / np.abs(q).max()
    own = own / np.linalg.norm(own)
    if len(first) >= most:
        reach = max(reach - 1e-12, np.partition(unit[first] @ own, -most)[-most])
    hit = np.flatnonzero(about + rest >= reach - _SLACK * max(1, len(q) / 512))
    score = unit[hit] @ own
    if len(hit) > most:  # rounding must not decide between equal scores
        hit = hit[score >= np.partition(score, -most)[-most] - 1e-12]
    score = np.array([float(np.dot(q, y) / (np.sqrt(np.dot(q, q)) * np.sqrt(np.dot(y, y)))) for y in x[hit]])
    top = best_of(score, most)
    return hit[top], score[top]


class Nearest:
    """The ``most`` nearest rows found so far of each query: ids and scores, nearest first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, codes: Codes, most: int, keep: int):
        self.ids, self.queries, self.codes, self.most, self.keep = ids, queries, codes, most, keep
        self.unit = queries / np.abs(queries).max(1, keepdims=True)
        self.unit /= np.linalg.norm(self.unit, axis=1, keepdims=True)
        self.found = np.full((len(ids), most), -1, np.int64)
        self.score = np.full((len(ids), most), -np.inf)

    def scan(self, ids: np.ndarray, rest: np.ndarray, x: np.ndarray, code: np.ndarray) -> None:
        """Take in a block of rows, in order of id."""
        unit = x / np.abs(x).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for lo in range(0, len(self.ids), 64):
            part = self.codes.tables(self.unit[lo : lo + 64])
            total = np.zeros((len(ids), part.shape[2]), np.float32)
            for j in range(part.shape[0]):
                total += part[j][code[:, j]]
            for i in range(lo, lo + part.shape[2]):
                hit, score = nearest_of(np.ascontiguousarray(total[:, i - lo]), rest, x, unit, self.queries[i], self.most, self.keep, self.score[i, -1])
                new, sure = np.concatenate([self.found[i], ids[hit]]), np.concatenate([self.score[i], score])
                order = np.lexsort((new, -sure))[: self.most]
                self.found[i], self.score[i] = new[order], sure[order]

    def batch(self) -> pa.RecordBatch:
        there = self.score > -np.inf
        return pa.RecordBatch.from_pydict({"query_id": np.repeat(self.ids, there.sum(1)), "vec_id": self.found[there], "score": self.score[there]})


def nearest_in_place(rows: DataFrame, asked, codes, dim: int, most: int, keep: int = KEEP) -> DataFrame:
    """query_id, vec_id, score: the ``most`` nearest that each task finds among its coded rows for every query of the
    broadcast ``asked`` (ids, vectors)."""
    block = max(1, ROWS * 64 // max(64, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, held, n = None, [], 0

        def scan() -> None:
            a = pa.Table.from_batches(held).sort_by("vec_id")
            packed = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(a.num_rows, -1)
            code = np.empty((a.num_rows, packed.shape[1] * 2), np.uint8)
            code[:, ::2], code[:, 1::2] = packed >> 4, packed & 15
            near.scan(a.column("vec_id").to_numpy(), a.column("rest").to_numpy(), _plain(a, dim), code)

        for b in batches:
            if not b.num_rows:
                continue
            if near is None:
                near = Nearest(*asked.value, codes.value, most, keep)
            held.append(b)
            n += b.num_rows
            if n >= block:
                scan()
                held, n = [], 0
        if held:
            scan()
        if near is not None:
            yield near.batch()

    return rows.select("vec_id", "embedding", "code", "rest").mapInArrow(run, "query_id long, vec_id long, score double")


def in_turn(queries: DataFrame, n: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of the queries, about ``size`` at a time."""
    parts = max(1, -(-n // size))
    for i in range(parts):
        part = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)) == i).select("vec_id", "embedding").toArrow().sort_by("vec_id")
        if part.num_rows:
            yield part.column("vec_id").to_numpy(), np.array(part.column("embedding").to_pylist())


def search(vectors: DataFrame, every: int = 50, k: int = 5, keep: int = KEEP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id ``every`` divides.

    Equal vectors are indexed once, so copies don't crowd out the candidates; the ``k`` nearest
    classes of a query are then spread into their smallest ids."""
    spark = vectors.sparkSession
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        .withColumns({"dim": F.size("embedding"), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    )
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    classes = durable(rows.groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("vec_id"), F.any_value("embedding").alias("embedding")), "ann-classes")
    place = F.struct("h1", "h2", "dim")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min_by("embedding", place).alias("embedding"), F.min_by("dim", place).alias("dim"))
    queries = durable(queries, "ann-queries")
    counts = dict(queries.groupBy("dim").count().collect())
    found = []
    for dim, n_queries in sorted(counts.items()):  # one space a length; as a rule there is one
        own = classes.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).select("embedding").collect()
        x = np.array([r[0] for r in sample])
        x = x / np.abs(x).max(1, keepdims=True)
        codes = spark.sparkContext.broadcast(fit(x / np.linalg.norm(x, axis=1, keepdims=True)))
        index = durable(coded(own, codes, dim), "ann-index")
        for asked in in_turn(queries.where(F.col("dim") == dim), n_queries, max(1, QUERIES * 64 // max(64, dim))):
            found.append(nearest_in_place(index, spark.sparkContext.broadcast(asked), codes, dim, k + 1, keep))
            if len(found) == 32:  # the plan stays short, however many lengths and turns there are
                found = [durable(reduce(DataFrame.unionByName, found), "ann-nearest")]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = reduce(DataFrame.unionByName, found).withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    # each class gives its k + 1 smallest ids: enough, whichever of them is the query's own
    same = Window.partitionBy("h1", "h2", "dim").orderBy("vec_id")
    members = (
        rows.select("vec_id", "h1", "h2", "dim").distinct().withColumn("m", F.row_number().over(same)).where(F.col("m") <= k + 1)
        .join(classes.select("h1", "h2", "dim", F.col("vec_id").alias("node")), ["h1", "h2", "dim"]).select("node", F.col("vec_id").alias("member"))
    )
    spread = top.join(members, F.col("vec_id") == F.col("node")).where("member <> query_id").select("query_id", F.col("member").alias("vec_id"), "score")
    return spread.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

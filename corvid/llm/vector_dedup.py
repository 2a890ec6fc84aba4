"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors of a label are one class with a weight, so a vector that a third of all
rows share is compared once.  Centroids are fitted on a bounded sample; every class has
one home cell, and is also sent as a guest to each cell in which a partner could live:
if y is at home in c' and |x - y| <= d, then x is no further than d from the plane between
its own centroid and c'.  Within a cell, guests and homes meet the homes in blocks of
``BLOCK``; each ordered pair is thus compared exactly once, and no link is lost to a cell
border.  A block returns counts and a spanning forest, never its pairs.

Cosines are in double precision on the original components.

Edge cases: vectors that are null, zero, or hold null or non-finite components, null
labels and null ids link with nothing; vectors of different lengths never link; repeated
rows are separate vectors, and rows that share an id are one node of the groups; ties of the cosine at the threshold link; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.components import components
from corvid.storage import durable

#: Vectors k-means is fitted on, by the order of a hash: sixteen a cell between these, and components of them at most.
SAMPLE, COMPONENTS = (16384, 131072), 1 << 24
#: Aim of classes a cell, most centroids (beyond CELL times as many classes a label, cells grow), vectors a block.
CELL, MAX_CELLS, BLOCK = 2000, 8192, 1024
#: Vectors placed at once.
_PLACED = 256


def usable(embedding) -> object:
    """True where a vector can take part: every component finite, one not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def centroids(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def placed(classes: DataFrame, cells: dict[int, np.ndarray], reach: float) -> DataFrame:
    """label, dim, cell, home, node, weight, embedding: each class in its home cell and as guest where a partner may live."""
    shared = classes.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                c = shared.value.get(int(dim))
                x = _matrix(part.column("embedding"), int(dim))
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if c is None or len(c) < 2:
                    rows, cell, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
                else:
                    found = []
                    for at in range(0, len(x), _PLACED):
                        dot = x[at : at + _PLACED] @ c.T
                        best = dot.argmax(1)
                        gap = np.sqrt(np.maximum(0, 2 - 2 * c[best] @ c.T))
                        near = dot[np.arange(len(dot)), best][:, None] - dot <= reach * gap + 1e-9
                        near[np.arange(len(dot)), best] = True
                        r, near_cell = np.nonzero(near)
                        found.append((r + at, near_cell, best[r] == near_cell))
                    rows, cell, home = (np.concatenate(f) for f in zip(*found, strict=True))
                out = part.take(pa.array(rows))
                yield pa.RecordBatch.from_pydict(
                    {n: out.column(n) for n in ("label", "dim", "node", "weight", "embedding")} | {"cell": pa.array(cell, pa.int64()), "home": pa.array(home)}
                )

    return classes.mapInArrow(run, "label int, dim int, node long, weight long, embedding array<double>, cell long, home boolean")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compared(cells: DataFrame, threshold: float) -> DataFrame:
    """node, links, root: per block, the weight of a class's partners there and one linked node of the block's forest."""
    sizes = cells.groupBy("label", "dim", "cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all"))
    n_h, n_q = F.ceil(F.col("homes") / BLOCK), F.ceil(F.col("all") / BLOCK)
    keyed = cells.join(sizes, ["label", "dim", "cell"]).where("homes > 0").withColumns({"nh": n_h, "nq": n_q})
    keyed = keyed.withColumns({"hb": F.pmod(F.xxhash64("node"), F.col("nh")), "qb": F.pmod(F.xxhash64("node", F.lit(1)), F.col("nq"))})
    cols = ["label", "dim", "cell", "node", "weight", "embedding"]
    asks = keyed.select(*cols, "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nh") - 1)).alias("hb"), F.lit(False).alias("home"))
    homes = keyed.where("home").select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"), "hb", F.lit(True).alias("home"))

    def block(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        home = t.column("home").to_numpy().astype(bool)
        node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        x = _matrix(t.column("embedding").combine_chunks(), dim)
        norm = np.linalg.norm(x, axis=1)
        q, h = np.flatnonzero(~home), np.flatnonzero(home)
        hit = (x[q] @ x[h].T) / (norm[q][:, None] * norm[h][None]) >= threshold
        hit &= node[q][:, None] != node[h][None]
        links = hit @ weight[h]
        ids, at = np.unique(node, return_inverse=True)
        i, j = np.nonzero(hit)
        root = _forest(len(ids), at[q][i], at[h][j])
        some = links > 0
        linked = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table(
            {
                "node": pa.array(np.concatenate([node[q][some], ids[linked]])),
                "links": pa.array(np.concatenate([links[some], np.zeros(len(linked), np.int64)]).astype(np.int64)),
                "root": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(ids[root[linked]], pa.int64())]),
            }
        )

    both = asks.unionByName(homes)
    return both.groupBy("label", "dim", "cell", "hb", "qb").applyInArrow(block, "node long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.where(fine).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = durable(
        keyed.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")),
        "vector-classes",
    )
    cells = {}
    for dim, most in classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count")).collect() if not classes.isEmpty() else []:
        k = int(min(MAX_CELLS, -(-most // CELL), max(1, COMPONENTS // dim // 8)))
        if k > 1:
            n = min(max(SAMPLE[0], 16 * k), SAMPLE[1], COMPONENTS // dim)
            x = np.array([r[0] for r in classes.where(F.col("dim") == dim).orderBy(F.xxhash64("node", F.lit(2)), "node").select("embedding").limit(n).collect()])
            cells[dim] = centroids(x / np.linalg.norm(x, axis=1, keepdims=True), k)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    out = durable(compared(placed(classes.select("label", "dim", "node", "weight", "embedding"), cells, reach), threshold), "vector-links")
    groups = components(out.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = out.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("label", "h1", "h2", "node", "weight")
        .join(counts, "node", "left").join(groups, "node", "left")
        .select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = keyed.select("vec_id", "label", "h1", "h2").join(per_class, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.c FROM l JOIN r ON l.b = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""

"""Line dedup by overlapping three-line windows.

Each run of three consecutive lines of a document is hashed (128 bits).  Of equal
windows the one first in (id, hash of the text, position) order stays; every other one is
removed, and the removed windows of a document are merged into runs of covered
lines, which are cut out of its text.  A document is an id and a text: different texts
under one id, or without an id, are documents of their own.

All work is in DataFrame functions.  Windows are made inside the row, the first
place of each hash is found with a map-side combined aggregate, and the whole
text is shuffled once, to meet its removed runs; it is put together again from the
slices between them.

Edge cases: a null text stays null; a document of fewer than three lines has no
window and stays as it is; rows that repeat an id and its text are the same place in
the order, so neither removes the other, while a later text under the same id loses
windows to an earlier one as any other document does; a null id sorts first; extra columns
are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 3


def _mark(lines: Column, i: Column, width: int, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.element_at(lines, (i + k + 1).cast("int")) for k in range(width)])


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """id, mark (of the text), pos (from 0), h1, h2 of every window of ``width`` consecutive lines."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    at = F.sequence(F.lit(0), F.size("lines") - width)
    each = F.transform(at, lambda i: F.struct(_mark(F.col("lines"), i, width, "a").alias("h1"), _mark(F.col("lines"), i, width, "b").alias("h2")))
    return (
        lines.where(F.size("lines") >= width)
        .select("id", "mark", F.posexplode(each).alias("pos", "w"))
        .select("id", "mark", "pos", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    )


def repeated(wins: DataFrame) -> DataFrame:
    """id, mark, pos of the windows whose text stands at an earlier place too, each place once."""
    place = F.struct("id", "mark", "pos")
    first = (
        wins.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("h1", "h2", "first")
    )
    return wins.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "mark", "pos").distinct()


def covered_runs(places: DataFrame, width: int = WINDOW) -> DataFrame:
    """id, mark and the merged runs of covered lines in order, array<struct<s,e>> with e exclusive."""
    by_doc = Window.partitionBy("id", "mark").orderBy("pos")
    new = (F.col("pos") > F.coalesce(F.lag("pos").over(by_doc) + width, F.lit(-1))).cast("int")
    return (
        places.withColumn("new", new).withColumn("run", F.sum("new").over(by_doc))
        .groupBy("id", "mark", "run").agg(F.min("pos").alias("s"), (F.max("pos") + width).alias("e"))
        .groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` with the later copies of repeated windows cut out of the text, and ``n_removed`` lines.

    A column of ``docs`` named ``n_removed`` is replaced."""
    names = [c for c in docs.columns if c != "n_removed"]
    runs = covered_runs(repeated(windows(docs, id_col, text_col, width)), width).withColumnsRenamed({"id": "__id", "mark": "__mark", "runs": "__runs"})
    joined = docs.select(*names).join(runs, (F.xxhash64(text_col) == F.col("__mark")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    hit = F.col("__runs").isNotNull() & F.col(text_col).isNotNull()
    # the lines are a column of their own, so that they are split once and not for each slice
    joined = joined.withColumn("__lines", F.when(hit, F.split(F.col(text_col), "\n", -1)))
    n = F.size("__runs")

    def between(i: Column) -> Column:
        lo = F.when(i == 0, F.lit(0)).otherwise(F.get("__runs", i - 1)["e"])
        hi = F.when(i == n, F.size("__lines")).otherwise(F.get("__runs", i)["s"])
        return F.slice("__lines", lo + 1, F.greatest(hi - lo, F.lit(0)))

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")
    gone = F.aggregate("__runs", F.lit(0).cast("long"), lambda n, r: n + F.greatest(F.least(r["e"], F.size("__lines")) - r["s"], F.lit(0)))
    return joined.select(
        *[F.when(hit, kept).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(c) for c in names],
        F.when(hit, gone).otherwise(F.lit(0).cast("long")).alias("n_removed"),
    )


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i AS pos, lines[i+1] || chr(10) || lines[i+2] || chr(10) || lines[i+3] AS win
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM l WHERE len(lines) >= 3)),
r AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, rank() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
c AS (
  SELECT DISTINCT doc_id, pos + k AS line FROM r, (SELECT unnest([0, 1, 2]) AS k)),
x AS (
  SELECT l.doc_id, i AS line, lines[i+1] AS s
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM l) l),
kept AS (
  SELECT x.doc_id, string_agg(s, chr(10) ORDER BY x.line) FILTER (WHERE c.line IS NULL) AS text,
         CAST(count(c.line) AS BIGINT) AS n_removed
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.line = c.line GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

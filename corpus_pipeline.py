"""A corpus pipeline: quality, line dedup, near duplicates, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import line_dedup, mixing, ngram_join, pieces, quality
from corvid.storage import clear, durable, held, ship, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of three-line windows; a document that loses all its lines goes."""
    cut = line_dedup.dedup_lines(docs)
    return cut.where((F.col("n_removed") == 0) | (F.col("text") != "")).select(
        "doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate group (null ids last, then by a hash of the text).

    Documents without words are linked with nothing and all stay.  An id that stands for several texts is a document for
    each of them; of rows that repeat an id and its text, one stays."""
    ship(spark)
    groups = ngram_join.near_duplicates(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    kept = groups.where("label is not null").groupBy("label").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("k"), F.col("p.text_hash").alias("h"))
    kept = kept.unionByName(groups.where("label is null").select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"))).distinct()
    keyed = docs.withColumn("__h", F.xxhash64(F.col("text").cast("string")))
    found = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("__h") == F.col("h")), "left_semi")
    wordless = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    return found.where(~wordless).dropDuplicates(["doc_id", "__h"]).unionByName(found.where(wordless)).drop("__h")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix reads them: a row for each pass over a document, cut to the words read."""
    ship(spark)
    return mixing.mixed_texts(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids and round_trip of every row of the mix."""
    ship(spark)
    coded = pieces.encode(docs.select("doc_id", "text", "lang", "source"))
    return coded.select("doc_id", "lang", "source", "n_pieces", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mix),
    ("piece encoding", to_pieces),
]

#: No SQL: the classifier and the mix's permutations have none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Once a stage's rows are written, the tables it was made from are removed."""
    docs, since = table(spark, sf_dir, "documents"), held(spark)
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = durable(made, "pipeline-" + name.replace(" ", "-"))
        clear(spark, since, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)

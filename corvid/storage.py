"""Durable intermediate tables.

Lineage is cut by writing Parquet into the folder named by
``spark.checkpoint.dir``, which every executor shares.  Only where that setting
is absent and the session is local (tests, notebooks) is a local folder made; on a
cluster without it, writing raises an error.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one for a local session where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: a local one would lose rows")
    made = getattr(spark, "_corvid_dir", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="spark-corvid-", dir="/tmp")
        spark._corvid_dir = made
    return made


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark._corvid_tables = [*getattr(spark, "_corvid_tables", ()), path]
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back with its own schema; ``clear`` removes it."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df``, dealt by ``key`` into as many partitions as shuffles have, written in the shared folder as a table of so
    many buckets: joins on ``key`` read it without moving it; ``clear`` removes it."""
    spark = df.sparkSession
    path, table_name = table_path(spark, name), f"corvid_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets(spark), key).sortBy(key).option("path", path).saveAsTable(table_name)
    spark._corvid_named = [*getattr(spark, "_corvid_named", ()), (table_name, path)]
    return spark.table(table_name)


def buckets(spark: SparkSession) -> int:
    """Buckets of ``bucketed`` tables: the partitions of a shuffle, within what Spark allows."""
    return min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held(spark: SparkSession) -> int:
    """How many tables this session has written and not removed."""
    return len(getattr(spark, "_corvid_tables", ()))


def clear(spark: SparkSession, since: int = 0, but_last: bool = False) -> int:
    """Remove the tables that this session has written, once results made from them are stored; how many there were.

    ``since`` leaves the first ones (``held`` counts them), ``but_last`` the last one."""
    jvm, paths = spark.sparkContext._jvm, list(getattr(spark, "_corvid_tables", ()))
    gone = paths[since : len(paths) - 1 if but_last else None]
    for name, path in list(getattr(spark, "_corvid_named", ())):
        if path in gone:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            spark._corvid_named.remove((name, path))
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    spark._corvid_tables = [p for p in paths if p not in gone]
    return len(gone)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session's context: they need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_corvid_shipped", False):
        root = Path(__file__).resolve().parent
        packed = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-corvid-')}/corvid", "zip", root.parent, root.name)
        context.addPyFile(packed)
        context._corvid_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

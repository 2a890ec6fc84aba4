"""Running sums and ranks over frames of any size: sorted ranges number their own rows, only their totals meet in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.storage import durable


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over all rows up to this one, in ``order`` within ``keys``.

    Rows are dealt to sorted ranges of (keys, order) and written, so that the ranges stay as they are.  A key with a third
    of all rows spans many ranges.  The totals of ranges, at most one row a range and key, are summed by key.  Null keys
    are a key of their own; ``order`` should be total."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = df.withColumns({f"__v_{name}": c for name, c in sums.items()}).repartitionByRange(n, *keys, *order)
    cut = durable(cut.withColumn("__c", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("__c", *keys).agg(*[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    before = totals.select(
        F.col("__c").alias("__b"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__s_{name}") for name in sums]
    )
    same = F.col("__c") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    own = Window.partitionBy("__c", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumns({f"__o_{name}": F.sum(f"__v_{name}").over(own) for name in sums}).join(before, same)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *[(F.col(f"__o_{name}") + F.col(f"__s_{name}")).alias(name) for name in sums])


def ranked(df: DataFrame, order: list[Column], column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``column``: places from 1 in ``order`` within ``keys``."""
    return running(df, order, {column: F.lit(1).cast("long")}, keys)

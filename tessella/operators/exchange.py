"""Exchange to explicit destinations, bucket sort, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ticket


def distribute(df: DataFrame, dest: str, ranks: int) -> DataFrame:
    """Send every record to partition ``dest`` (0 to ranks - 1) of the result."""
    return df.repartitionById(ranks, F.col(dest).cast("int"))


def distribute_batches(df: DataFrame, dest: str, ranks: int, capacity: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a destination takes ``capacity`` records in ``order``."""
    placed = ticket(df, order, [dest], "exchange__at")
    keep = placed.where(F.col("exchange__at") < capacity).drop("exchange__at")
    return distribute(keep, dest, ranks), placed.where(F.col("exchange__at") >= capacity).drop("exchange__at")


def bucket_of(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def bucket_sort(df: DataFrame, value: str, width: float, ties: list[str], into: str = "pos") -> DataFrame:
    """``df`` with ``bucket`` and the global place from 1 in order of (value, ties): places are
    offsets of value ranges plus the place within one, so no single task sorts everything."""
    return ticket(df.withColumn("bucket", bucket_of(F.col(value), width)), [value, *ties], [], into).withColumn(into, F.col(into) + 1)


def global_sort(df: DataFrame, *order: str) -> DataFrame:
    """A range exchange and a sort within partitions."""
    return df.orderBy(*order)


def bucket_count(df: DataFrame, value: str, width: int, start: int, buckets: int) -> DataFrame:
    """Dense histogram: (bucket, n) for every bucket from ``start``, empty ones too."""
    hit = df.where(F.col(value).isNotNull()).groupBy(F.floor((F.col(value) - start) / width).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    every = df.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    return every.join(hit, every["bucket"] == hit["b"], "left").select("bucket", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def total_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(column).cast("long").alias("total"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))

"""Ranks and running totals that do not put one key's rows into one task.

A plain window over a hot key sorts all of its rows in a single task. These
helpers split each key by a coarse, deterministic bucket of the order column,
work inside (key, bucket), and add the totals of the earlier buckets. Those
totals are one row per (key, bucket), so the second window is small.

The bucket must be a monotone expression of the order column. It is computed
per row and needs no sampling, so both branches of the plan agree on it.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from itembank.session import checkpoint_dir

WIDTH = 1 << 14
#: Rows of a stored range, the most one task holds.
RANGE_ROWS = 200_000


def stored_ranges(df: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` written in ranges of ``order``: ``part_no`` ascends with the order, ``place_no`` inside a range.

    The cut goes through the whole order, so rows that share its first columns are still spread; only rows equal in all
    of them stay together. The stored copy makes every reader agree on the cut.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/rows")
    stored = spark.read.schema(df.schema).parquet(f"{folder}/rows")
    parts = max(1, -(-stored.count() // range_rows))
    placed = stored.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "*", F.monotonically_increasing_id().alias("place_no"), F.spark_partition_id().alias("part_no"))
    placed.write.partitionBy("part_no").parquet(f"{folder}/ranges")
    schema = StructType([*df.schema.fields]).add("place_no", LongType()).add("part_no", IntegerType())
    return spark.read.schema(schema).parquet(f"{folder}/ranges")


def _bucket(order: str, width: int, bucket: Column | None) -> Column:
    return bucket if bucket is not None else F.floor(F.col(order) / F.lit(width))


def _attach(local: DataFrame, totals: DataFrame, keys: list[str], outputs: list[str]) -> DataFrame:
    right = totals.select(*[F.col(k).alias(f"__r_{k}") for k in [*keys, "__b"]], *outputs)
    same = F.col("__b").eqNullSafe(F.col("__r___b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return local.join(right, same, "left").drop("__b", "__r___b", *[f"__r_{k}" for k in keys])


def row_numbers(
    df: DataFrame, keys: list[str], order: str, name: str = "rn", *,
    width: int = WIDTH, bucket: Column | None = None, tie: list[str] | None = None,
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row within its key, ascending in ``order`` then ``tie``."""
    df = df.withColumn("__b", _bucket(order, width, bucket))
    counts = df.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    outputs = ["__off"]
    if total:
        totals = totals.withColumn(total, F.sum("__n").over(W.partitionBy(*keys)))
        outputs.append(total)
    inner = W.partitionBy(*keys, "__b").orderBy(order, *(tie or []))
    local = df.withColumn("__rn", F.row_number().over(inner))
    out = _attach(local, totals, keys, outputs)
    return out.withColumn(name, F.col("__rn") + F.col("__off")).drop("__rn", "__off")


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, *,
    width: int = WIDTH, bucket: Column | None = None, tie: list[str] | None = None,
    total: str | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows strictly before each row of the same key."""
    df = df.withColumn("__b", _bucket(order, width, bucket))
    sums = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = sums.withColumn("__off", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    outputs = ["__off"]
    if total:
        totals = totals.withColumn(total, F.sum("__s").over(W.partitionBy(*keys)))
        outputs.append(total)
    inner = W.partitionBy(*keys, "__b").orderBy(order, *(tie or [])).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    out = _attach(local, totals, keys, outputs)
    return out.withColumn(name, F.col("__in") + F.col("__off")).drop("__in", "__off")


def last_before(
    df: DataFrame, keys: list[str], order: str, columns: list[str], *, tie: list[str] | None = None, width: int = WIDTH, bucket: Column | None = None,
) -> DataFrame:
    """``prev_<c>``: the last value of ``c`` that is not null in the rows of the same key strictly before, by ``order`` then ``tie``."""
    tie = tie or []
    df = df.withColumn("__b", _bucket(order, width, bucket))
    inner = W.partitionBy(*keys, "__b").orderBy(order, *tie).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumns({f"__in_{c}": F.last(c, ignorenulls=True).over(inner) for c in columns})
    place = F.struct(order, *tie)
    ends = df.groupBy(*keys, "__b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__end_{c}") for c in columns])
    outer = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select(*keys, "__b", *[F.last(f"__end_{c}", ignorenulls=True).over(outer).alias(f"__out_{c}") for c in columns])
    out = _attach(local, before, keys, [f"__out_{c}" for c in columns])
    return out.select(*[c for c in df.columns if c != "__b"], *[F.coalesce(f"__in_{c}", f"__out_{c}").alias(f"prev_{c}") for c in columns])


def first_per_key(df: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Smallest ``order`` of every key, with the size of the key: a combinable aggregate."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_pos"), F.count(F.lit(1)).alias("n"))

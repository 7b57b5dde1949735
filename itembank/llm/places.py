"""The place of every row in its group, for groups of any size, and a check value that SQL can express too."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.llm.common import stage

#: CRC-32 (reflected, polynomial EDB88320) as DuckDB expressions: ``crc_table`` is a view to add to WITH RECURSIVE, and
#: ``crc_sql`` an expression over it for the decimal form of an integer.
CRC_TABLE = """crc_bits(i, k, c) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS crc FROM crc_bits WHERE k = 8)"""


def crc_sql(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), {step}), 4294967295)"


def crc(number: Column) -> Column:
    """Unsigned CRC-32 of an integer's decimal form; null of null."""
    return F.crc32(number.cast("string").cast("binary"))


def sorted_rows(rows: DataFrame, order: list[Column | str], folder: str, name: str) -> DataFrame:
    """``rows`` in the order of ``order`` over all parts, written with ``part`` and ``seq``, the place of each in its part.

    Parts are ranges of the whole order, so one value never makes a large part as long as ``order`` ends in something that
    tells its rows apart. ``rows`` should be a written table: ranges come from a first look at it.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), folder, name)


def runs(placed: DataFrame, group: str) -> DataFrame:
    """Of ``sorted_rows``: one row per part and group, with ``before``, the rows of the group in earlier parts, ``first``, its
    first ``seq``, and ``total``, the rows of the group. Part and group hold no more than a part."""
    counts = placed.groupBy("part", group).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("held"))
    whole = W.partitionBy(group)
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return counts.select("part", group, "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(whole).alias("total"))


def placed_rows(placed: DataFrame, about: DataFrame, group: str) -> DataFrame:
    """``placed`` with ``pos``, the place in the group from 0, and the columns of ``about`` (``runs``, and what else is known
    of a group)."""
    extra = [c for c in about.columns if c not in ("part", group, "first", "before")]
    right = about.select(F.col("part").alias("__part"), F.col(group).alias("__group"), "first", "before", *extra)
    joined = placed.join(right, (F.col("part") == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn("pos", F.col("before") + F.col("seq") - F.col("first")).drop("__part", "__group", "first", "before", "part", "seq")

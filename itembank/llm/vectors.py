"""Vectors as rows fit for numpy: validity, and blocks of a bounded number of rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Not null, not empty, without null, NaN or infinite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, ok) & (F.size(vector) > 0), F.lit(False))


def in_blocks(rows: DataFrame, count: int, size: int, name: str = "block") -> DataFrame:
    """Deal ``rows`` (``count`` of them) evenly over blocks of about ``size`` rows, whatever their values are."""
    return rows.withColumn(name, F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-count // size)))))

"""Attaching per-key results to rows when a few keys hold much of the data."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
PER_PART = 2048


def _same(keys: list[str], side: str):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{side}_{k}"))
    return cond


def attach_per_key(
    rows: DataFrame, stats: DataFrame, keys: list[str], count: str | None = None, row_id: str = "pos",
    how: str = "left", hot_keys: int = HOT_KEYS, valid=None,
) -> DataFrame:
    """Join ``stats`` (one row per key) to ``rows``; null keys are keys like any other.

    ``count`` names the column of ``stats`` that holds the rows of each key. It may be given only if ``stats`` has every key that
    many rows share; keys to be treated as absent are then marked by ``valid`` being false, not left out. Without ``count`` the rows
    per key are counted here, a map-side combined aggregate, so keys that ``stats`` lacks (blank, null, any) are known too.

    The ``hot_keys`` largest keys go to every task as a broadcast of at most that many rows, with or without statistics, so
    their rows need no shuffle by key. Any other key holds at most 1/``hot_keys`` of the rows and
    takes the shuffled join; rows already served are spread over it by their id.
    """
    outputs = [c for c in stats.columns if c not in keys]
    there = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    # Always 0, but not a literal the optimizer could fold out of the join key.
    zero = F.pmod(F.hash(*keys), F.lit(1)).cast("long")
    if count is None:
        sizes = rows.groupBy(*[F.col(k).alias(f"__c_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__count"))
        top = sizes.orderBy(F.col("__count").desc(), *[f"__c_{k}" for k in keys]).limit(hot_keys)
        known = stats.join(F.broadcast(top.drop("__count")), _same(keys, "c")).select(
            *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__h_{c}") for c in outputs], F.lit(True).alias("__in"))
        both = F.lit(True)
        for k in keys:
            both = both & F.col(f"__c_{k}").eqNullSafe(F.col(f"__k_{k}"))
        hot = top.join(F.broadcast(known), both, "left").select(
            *[F.col(f"__c_{k}").alias(f"__h_{k}") for k in keys], *[f"__h_{c}" for c in outputs],
            F.lit(True).alias("__hot"), F.coalesce("__in", F.lit(False)).alias("__in"))
    else:
        hot = stats.orderBy(F.col(count).desc(), *keys).limit(hot_keys).select(
            *[F.col(k).alias(f"__h_{k}") for k in keys], *[F.col(c).alias(f"__h_{c}") for c in outputs],
            F.lit(True).alias("__hot"), there.alias("__in"))
    rest = stats.filter(there).select(
        *[F.col(k).alias(f"__s_{k}") for k in keys], *[F.col(c).alias(f"__s_{c}") for c in outputs],
        zero.alias("__s_spread"), F.lit(True).alias("__cold"),
    )
    spread = F.when(F.col("__hot"), F.xxhash64(row_id)).otherwise(F.lit(0)).cast("long")
    served = rows.join(F.broadcast(hot), _same(keys, "h"), "left").withColumn("__spread", spread)
    if how in ("inner", "semi"):
        # Served rows without statistics leave before the shuffle.
        served = served.filter(F.col("__hot").isNull() | F.col("__in"))
    joined = served.join(
        rest, _same(keys, "s") & (F.col("__spread") == F.col("__s_spread")) & F.col("__hot").isNull(), "left"
    )
    matched = F.coalesce(F.col("__in"), F.col("__cold"), F.lit(False))
    if how == "anti":
        return joined.filter(~matched).select(*rows.columns)
    if how in ("inner", "semi"):
        joined = joined.filter(matched)
    if how == "semi":
        return joined.select(*rows.columns)
    return joined.select(
        *rows.columns, *[F.when(F.col("__in"), F.col(f"__h_{c}")).when(F.col("__hot").isNull(), F.col(f"__s_{c}")).alias(c) for c in outputs],
    )


def split_join(
    left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str | None = None, *, partitions: int,
    per_part: int = PER_PART, hot_keys: int = HOT_KEYS, counted: DataFrame | None = None,
) -> DataFrame:
    """Inner join on ``key`` in which a hot key is a grid of parts instead of one task.

    The rows of a hot key are dealt by ``left_id`` into parts of about ``per_part`` rows, those of the other side by ``right_id``, and
    each part meets each part of the other side once, so every pair of rows meets exactly once. ``right_id`` None says that
    ``right`` holds a key once; such a row goes to all parts. The ``hot_keys`` largest keys are split, any other holds at
    most 1/``hot_keys`` of the rows. Only keys and numbers of parts are broadcast. Both sides are read twice: pass stored ones,
    or in ``counted`` a stored table with the keys of ``left``.
    """
    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / per_part).alias(name)).filter(F.col(name) > 1)

    # A key that is not large on a side has one part there; only the few large ones are matched.
    one, large = F.lit(1).cast("long"), parts(left if counted is None else counted, "__l")
    large = large.withColumn("__r", one) if right_id is None else large.join(parts(right, "__r"), key, "full")
    grid = large.select(key, F.coalesce("__l", one).alias("__l"), F.coalesce("__r", one).alias("__r")).orderBy(
        (F.col("__l") + F.col("__r")).desc(), key).limit(hot_keys)

    def dealt(df: DataFrame, own: str, row_id: str | None, other: str, cells: tuple[str, str]) -> DataFrame:
        known = df.join(F.broadcast(grid), key, "left")
        part = F.lit(0).cast("long") if row_id is None else F.pmod(F.xxhash64(row_id), F.coalesce(own, one))
        copies = F.sequence(F.lit(0).cast("long"), F.coalesce(other, one) - 1)
        return known.select(*df.columns, part.alias(cells[0]), F.explode(copies).alias(cells[1])).repartition(partitions, key, "__a", "__b")

    return dealt(left, "__l", left_id, "__r", ("__a", "__b")).join(
        dealt(right, "__r", right_id, "__l", ("__b", "__a")), [key, "__a", "__b"]).drop("__a", "__b")

"""Batches of consecutive rows for model calls.

A greedy batch ends when the next row would be one too many or make it too large. Where a batch ends follows from where it
begins and the next few rows, so a block of rows maps each of its possible first places to the place where the next block is
entered, and to the number of batches begun. These maps compose: within spans of blocks, then over the spans, one
row each. A task sees a block, a span's maps, or one row per span.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.operators.ordered import row_numbers

BLOCK = 4096
SPAN = 4096
MAP = "block long, exits array<int>, begun array<long>"


def batches_per_source(rows: DataFrame, source: str = "source_file", size: int = 6, order: str = "pos") -> DataFrame:
    """``batch`` of every row: ``size`` neighbouring rows of one source, numbered from 0 within it."""
    ranked = row_numbers(rows, [source], order, "nth_of_source")
    return ranked.withColumn("batch", F.floor((F.col("nth_of_source") - 1) / size)).drop("nth_of_source")


def _ends(sizes: list[int], max_rows: int, max_size: int) -> list[int]:
    """For every row, the row behind the batch that begins there."""
    out = []
    for first, size in enumerate(sizes):
        end = first + 1
        while end < len(sizes) and end - first < max_rows and size + sizes[end] <= max_size:
            size += sizes[end]
            end += 1
        out.append(end)
    return out


def _through(maps: pd.DataFrame, entry: int) -> tuple[list[int], list[int], int, int]:
    """Entries and batches begun before each of consecutive maps, and both behind the last."""
    entries, numbers, begun = [], [], 0
    for exits, counts in zip(maps["exits"], maps["begun"]):
        entries.append(entry)
        numbers.append(begun)
        begun, entry = begun + int(counts[entry]), int(exits[entry])
    return entries, numbers, entry, begun


def greedy_batches(rows: DataFrame, size: Column, max_rows: int = 12, max_size: int = 18_000, order: str = "pos") -> DataFrame:
    """``rows`` with ``batch``: numbered from 0 in the order of ``order`` (unique), at most ``max_rows`` rows and ``max_size`` in
    sum; a row that is larger stands alone. A null size counts as 0."""
    block_size, span_size = BLOCK, SPAN
    ranked = row_numbers(rows.select(order, F.coalesce(size, F.lit(0)).cast("long").alias("__size")), [], order, "nth")
    placed = ranked.select(F.col(order).alias("at"), "__size", (F.col("nth") - 1).alias("rn")).withColumn("block", F.floor(F.col("rn") / block_size))
    # The first rows of a block also close the batches of the one before.
    ahead = placed.filter((F.col("rn") % block_size < max_rows) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    seen = placed.union(ahead)

    def to_map(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn")
        own = int((part["rn"] // block_size == key[0]).sum())
        ends = _ends(part["__size"].tolist(), max_rows, max_size)
        exits, begun = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            inside = ends[i] < own
            exits[i], begun[i] = (exits[ends[i]], begun[ends[i]] + 1) if inside else (ends[i] - own, 1)
        # A place behind the block's last row passes through it.
        first = [(exits[i], begun[i]) if i < own else (i - own, 0) for i in range(max_rows)]
        return pd.DataFrame({"block": [key[0]], "exits": [[f[0] for f in first]], "begun": [[f[1] for f in first]]})

    def to_span(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        ways = [_through(part, entry)[2:] for entry in range(max_rows)]
        return pd.DataFrame({"block": [key[0]], "exits": [[w[0] for w in ways]], "begun": [[w[1] for w in ways]]})

    def entries(part: pd.DataFrame, entry: int, begun: int) -> pd.DataFrame:
        part = part.sort_values("block")
        places, numbers, _, _ = _through(part, entry)
        return pd.DataFrame({"block": part["block"].tolist(), "entry": places, "number": [begun + n for n in numbers]})

    maps = seen.groupBy("block").applyInPandas(to_map, MAP)
    spanned = maps.withColumn("span", F.floor(F.col("block") / span_size))
    spans = spanned.groupBy("span").applyInPandas(to_span, MAP)
    found = "block long, entry int, number long"
    span_entries = spans.groupBy((F.col("block") * 0).alias("all")).applyInPandas(lambda part: entries(part, 0, 0), found)
    joined = spanned.join(span_entries.select(F.col("block").alias("span"), "entry", "number"), "span")
    block_entries = joined.groupBy("span").applyInPandas(lambda part: entries(part, int(part["entry"].iloc[0]), int(part["number"].iloc[0])), found)

    def number(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn")
        own = int((part["rn"] // block_size == key[0]).sum())
        ends = _ends(part["__size"].tolist(), max_rows, max_size)
        at, now = int(part["entry"].iloc[0]), int(part["number"].iloc[0])
        numbers = [now - 1] * min(at, own)
        while at < own:
            numbers += [now] * (min(ends[at], own) - at)
            at, now = ends[at], now + 1
        return pd.DataFrame({"at": part["at"].tolist()[:own], "batch": numbers})

    numbered = seen.join(block_entries, "block").groupBy("block").applyInPandas(number, "at long, batch long")
    return rows.join(numbered, F.col(order) == F.col("at")).drop("at")

"""Runs of missing numbers as intervals, with the nearest numbers that are there on each side.

Rows exist for numbers that are there, never for those that are not, so the last expected number may be any. A document's
numbers are cut into stretches of ``WIDTH``; windows run inside a stretch, and over one row per stretch, so a document that
holds most of all rows is many tasks' work.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 1 << 16
KEY = ["source_file", "kind"]


def number_rows(numbered: DataFrame) -> DataFrame:
    """Rows per (file, kind, number): how many, the pages of all, and place and pages of the first two (``one``, ``two``).

    ``numbered``: ``source_file``, ``kind``, ``n``, ``pos``, ``lo``, ``hi`` (first and last page). Of a number that many rows share, two of a task are moved.
    """
    key = [*KEY, "n"]
    counts = numbered.groupBy(*key).agg(F.count(F.lit(1)).alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    row, place = F.struct("pos", "lo", "hi"), F.row_number().over(W.partitionBy(*key).orderBy("pos"))
    first = numbered.withColumn("place", place).where("place <= 2").groupBy(*key).agg(
        F.max(F.when(F.col("place") == 1, row)).alias("one"), F.max(F.when(F.col("place") == 2, row)).alias("two"))
    return counts.join(first, key)


def gaps(present: DataFrame, docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Missing numbers of every document as intervals ``from_n`` to ``to_n``, with ``below`` and ``above``, up to two rows of ``present``
    on each side, nearest first.

    ``present``: of ``number_rows``. ``docs``: ``source_file``, ``kind``, ``last`` (the last expected number), ``pages``; one row each; a document
    without any number is one interval. ``seen`` (``source_file``, ``kind``, ``n``, ``seen_lo``, ``seen_hi``): missing numbers of which something is known; each is an interval of its own.
    """
    row = F.struct("n", "cnt", "lo", "hi", "one", "two")
    shape = present.select(*KEY, "n", row.alias("here"))
    empty = F.lit(None).cast(shape.schema["here"].dataType)
    pages = F.lit(None).cast("int")
    events = shape.join(docs.select(*KEY), KEY, "left_semi").select("*", pages.alias("seen_lo"), pages.alias("seen_hi"))
    events = events.union(docs.select(*KEY, F.lit(0).cast("long"), empty, pages, pages))
    if seen is not None:
        unknown = seen.join(present, [*KEY, "n"], "left_anti").join(docs.select(*KEY), KEY, "left_semi").where("n > 0")
        events = events.union(unknown.select(*KEY, "n", empty, "seen_lo", "seen_hi"))
    events = events.withColumn("stretch", F.floor(F.col("n") / WIDTH))

    # What follows a row precedes it in the reverse order: a frame that only grows is passed once, one that shrinks once per row.
    # A document's own row and a number 0 of it are told apart by ``there``, so the two orders are reverse to each other.
    there = F.col("here").isNotNull()
    inner, reverse = W.partitionBy(*KEY, "stretch").orderBy("n", there), W.partitionBy(*KEY, "stretch").orderBy(F.desc("n"), there.desc())
    below, above = (w.rowsBetween(W.unboundedPreceding, -1) for w in (inner, reverse))
    near = events.select("*", F.last("here", ignorenulls=True).over(below).alias("b1"), F.last("here", ignorenulls=True).over(above).alias("a1"), F.lead("n").over(inner).alias("next"))
    # The second one is the first one's own neighbour, wrapped so that none counts as one, too.
    wrapped = lambda c: F.when(there, F.struct(F.col(c).alias("x")))
    near = near.select("*", F.last(wrapped("b1"), ignorenulls=True).over(below)["x"].alias("b2"), F.last(wrapped("a1"), ignorenulls=True).over(above)["x"].alias("a2"))

    edges = near.groupBy(*KEY, "stretch").agg(
        F.min("n").alias("start"), F.max("here").alias("l1"), F.max_by(F.when(there, F.col("b1")), F.when(there, F.col("n"))).alias("l2"),
        F.min("here").alias("f1"), F.min_by(F.when(there, F.col("a1")), F.when(there, F.col("n"))).alias("f2"))
    outer = W.partitionBy(*KEY).orderBy("stretch")
    before, after = (w.rowsBetween(W.unboundedPreceding, -1) for w in (outer, W.partitionBy(*KEY).orderBy(F.desc("stretch"))))
    edges = edges.select("*", F.last("l1", ignorenulls=True).over(before).alias("p1"), F.last("f1", ignorenulls=True).over(after).alias("n1"), F.lead("start").over(outer).alias("after"))
    second = lambda own, far, one: F.when(F.col(one).isNotNull(), F.struct(F.coalesce(own, far).alias("x")))
    edges = edges.select(
        *KEY, "stretch", "p1", "n1", "after", F.last(second("l2", "p1", "l1"), ignorenulls=True).over(before)["x"].alias("p2"),
        F.last(second("f2", "n1", "f1"), ignorenulls=True).over(after)["x"].alias("n2"))

    both = near.join(edges, [*KEY, "stretch"]).join(docs, KEY)
    lower = F.array_compact(F.array("b1", "b2", "p1", "p2"))
    upper = F.slice(F.array_compact(F.array("a1", "a2", "n1", "n2")), 1, 2)
    until = F.least(F.coalesce("next", "after", F.col("last") + 1) - 1, F.col("last"))
    columns = [*KEY, "last", "pages"]
    after_it = both.select(
        *columns, (F.col("n") + 1).cast("long").alias("from_n"), until.cast("long").alias("to_n"),
        F.slice(F.when(there, F.concat(F.array("here"), lower)).otherwise(lower), 1, 2).alias("below"), upper.alias("above"), pages.alias("seen_lo"), pages.alias("seen_hi"))
    out = after_it.where("from_n <= to_n")
    if seen is not None:
        itself = both.where("here IS NULL AND n > 0 AND n <= last")
        out = out.union(itself.select(*columns, "n", F.col("n"), F.slice(lower, 1, 2), upper, "seen_lo", "seen_hi"))
    return out


def nearest_two(n: Column) -> Column:
    """Of the rows of ``below`` and ``above``, the two nearest to number ``n``, by distance, then by place."""
    def rows(side: str) -> Column:
        return F.flatten(F.transform(side, lambda r: F.transform(
            F.filter(F.array(r["one"], r["two"]), lambda x: x.isNotNull()),
            lambda x: F.struct(F.abs(r["n"] - n).alias("d"), x["pos"].alias("pos"), x["lo"].alias("lo"), x["hi"].alias("hi")))))

    return F.slice(F.array_sort(F.concat(rows("below"), rows("above"))), 1, 2)


def by_nearest(intervals: DataFrame) -> DataFrame:
    """``intervals`` cut where the two nearest rows change: at the middle between a number below and one above. At most nine pieces."""
    sums = F.flatten(F.transform("below", lambda b: F.transform("above", lambda a: a["n"] + b["n"])))
    cuts = F.concat(F.transform(sums, lambda s: F.ceil(s / 2).cast("long")), F.transform(sums, lambda s: (F.floor(s / 2) + 1).cast("long")))
    inside = F.filter(cuts, lambda c: (c > F.col("from_n")) & (c <= F.col("to_n")))
    starts = F.array_sort(F.array_distinct(F.concat(F.array("from_n"), inside)))
    ends = F.concat(F.transform(F.filter(starts, lambda s: s > F.col("from_n")), lambda s: s - 1), F.array("to_n"))
    cut = intervals.withColumn("piece", F.explode(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    return cut.withColumns({"from_n": F.col("piece.a"), "to_n": F.col("piece.b")}).drop("piece")

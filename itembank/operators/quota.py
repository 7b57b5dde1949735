"""Greedy quotas over a global order: any number of groups, rows and seats.

All groups see the rows in one order, so "every group in turn takes its first rows that no earlier group took" is the
same as one pass over the rows in that order in which a row goes to its earliest group with a free seat. The only state of
that pass is the number of free seats of every group. The rows are cut into ranges of the order; while no group runs out
inside a range, what it takes from each group is a count, so whole stretches of ranges are passed by counts that combine
before the shuffle. A range in which a group runs out is walked row by row, and after it that group is closed: at most as
many ranges are walked on the way as there are groups. Then the free seats at the start of every range are known, and all
ranges are resolved at once, each in its own task.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.operators.ordered import RANGE_ROWS, stored_ranges


def walk(pos: np.ndarray, groups: list, free: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(row, group, seats left before) of the rows taken from a stretch in order, and the seats left after it."""
    size = np.array([len(g) for g in groups], dtype=np.int64)
    row, grp = np.repeat(np.arange(len(pos)), size), np.concatenate([np.asarray(g, dtype=np.int64) for g in groups]) if len(pos) else size
    used, left, out = np.zeros(len(pos), dtype=bool), free.copy(), []
    by_group = np.argsort(grp, kind="stable")
    row, grp = row[by_group], grp[by_group]
    edges = np.flatnonzero(np.diff(grp, prepend=-1))
    for start, end in zip(edges, [*edges[1:], len(grp)]):
        g = int(grp[start])
        mine = row[start:end]
        take = mine[~used[mine]][:left[g]]
        used[take] = True
        out += [(int(pos[i]), g, int(left[g]) - n) for n, i in enumerate(take)]
        left[g] -= len(take)
    return out, left


def _walked(pdf: pd.DataFrame, free: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    pdf = pdf.sort_values("place_no")
    return walk(pdf["pos"].to_numpy(), pdf["groups"].tolist(), free)


def _states(rows: DataFrame, counts: list[int]) -> dict[int, np.ndarray]:
    """Free seats at the start of every range in which a seat is free."""
    free, states, at = np.array(counts, dtype=np.int64), {}, 0
    last = rows.agg(F.max("part_no")).first()[0]
    while last is not None and at <= last and free.any():
        opened = F.array(*[F.lit(int(g)) for g in np.flatnonzero(free)])
        goes = F.filter("groups", lambda g: F.array_contains(opened, g))
        # One row per range and group, whatever the data's size.
        taken = rows.where((F.col("part_no") >= at) & (F.size(goes) > 0)).groupBy("part_no", F.element_at(goes, 1).alias("g")).count().collect()
        table = np.zeros((last + 1 - at, len(counts)), dtype=np.int64)
        for part, g, n in taken:
            table[part - at, g] = n
        sums = table.cumsum(axis=0)
        # A group runs out where its seats are reached; up to there the counts are what is taken.
        out = ((sums >= free) & (free > 0)).any(axis=1)
        whole = int(out.argmax()) if out.any() else len(out)
        for i in range(whole):
            states[at + i] = free - (sums[i - 1] if i else 0)
        if whole:
            free = free - sums[whole - 1]
        at += whole
        if at > last:
            break
        states[at] = free
        seats = free

        def left(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"g": np.arange(len(seats)), "n": _walked(pdf, seats)[1]})

        after = rows.where(F.col("part_no") == at).groupBy("part_no").applyInPandas(left, "g int, n long").collect()
        if after:
            free = np.zeros(len(counts), dtype=np.int64)
            for g, n in after:
                free[g] = n
        at += 1
    return states


def greedy_quotas(member: DataFrame, counts: list[int], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``pos``, ``sel_group``, ``sel_rank``: every group in turn takes its first ``counts[g]`` rows that no earlier one took.

    ``member``: ``pos`` (unique), ``groups`` (ascending, without repeats, null-free) and the columns of ``order``, which
    must tell all rows apart. Rows without a group are never taken. The result is computed from a stored copy.
    """
    rows = stored_ranges(member.where(F.size("groups") > 0), order, range_rows)
    states = _states(rows, counts)
    schema = "pos long, sel_group int, sel_rank int"
    if not states:
        return member.sparkSession.createDataFrame([], schema)
    seats = {part: free.tolist() for part, free in states.items()}

    def resolve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        taken, _ = _walked(pdf, np.array(seats[key[0]], dtype=np.int64))
        return pd.DataFrame([(p, g, counts[g] - n + 1) for p, g, n in taken], columns=["pos", "sel_group", "sel_rank"])

    reached = rows.where(F.col("part_no") <= max(states))
    return reached.groupBy("part_no").applyInPandas(resolve, schema)

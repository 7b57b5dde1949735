"""Exact top-k by inner product with Fagin's threshold algorithm over sorted lists per dimension.

Rows are dealt into blocks of bounded size; a block has, for every dimension, its rows sorted by that component. A query
reads all lists from their good ends at once (the large end where its own component is positive, else the small end).
After depth t every row that stands among the first t of any list has been seen, and scores of the others are at most
the query's product with the components at depth t. The search of a block stops when this bound is below the k-th score.
The best of the blocks meet in one window per query. Queries come in blocks too, and each meets each block of rows once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.llm.common import query, run_folder, stage, table
from itembank.llm.vectors import finite, in_blocks

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
FIRST_DEPTH = 32


class SortedLists:
    """The lists of one block: ``ids`` ascending with their rows ``values`` (integers below 2**53 in every sum)."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n, dims = values.shape
        order = np.argsort(values, axis=0, kind="stable")
        self.n, self.sorted = n, np.take_along_axis(values, order, 0)
        place = np.empty((n, dims), np.int32)
        np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None], 0)
        #: Depth of each row in each list, read from the small end, then from the large end.
        self.depth = np.ascontiguousarray(np.concatenate([place, n - 1 - place], axis=1).T.astype(np.int16 if n < 1 << 15 else np.int32))

    def search(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the rows that can be among the k best, row ``own`` (or -1) left out."""
        dims = np.flatnonzero(q)
        if not len(dims):
            return self.best(np.delete(np.arange(self.n), own) if own >= 0 else np.arange(self.n), np.zeros(self.n - (own >= 0), q.dtype), k)
        up = q > 0
        first = self.depth[dims + up[dims] * len(q)].min(axis=0)
        if own >= 0:
            first[own] = np.iinfo(first.dtype).max
        found, scores = np.empty(0, np.int64), np.empty(0, q.dtype)
        low, depth, every = 0, FIRST_DEPTH, None
        while True:
            new = np.flatnonzero((first >= low) & (first < depth))
            # Past a quarter of the rows, one product with all of them costs less than collecting the rows; it serves all depths.
            if every is None and 4 * len(new) >= self.n:
                every = self.values @ q
            some = self.values[new] @ q if every is None else every[new]
            found, scores = self.best(np.concatenate([found, new]), np.concatenate([scores, some]), k)
            if depth >= self.n:
                return found, scores
            at = np.where(up, self.sorted[self.n - 1 - depth], self.sorted[depth])
            # An unseen row that ties with the k-th may have the smaller id, so ties go on.
            if len(scores) >= k and scores[-1] > at @ q:
                return found, scores
            low, depth = depth, min(depth * 4, self.n)

    @staticmethod
    def best(found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > 4 * k > 0:  # only rows that reach the k-th score are sorted, its ties with them
            few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            found, scores = found[few], scores[few]
        order = np.lexsort((found, -scores))[:k]
        return found[order], scores[order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, asks = batch.column("rows")[i].values, batch.column("asks")[i].values
                ids, rids = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "rid"))
                order = np.lexsort((rids, ids))
                ids, rids = ids[order], rids[order]
                lists = SortedLists(_matrix(rows.field("ints"))[order])
                where = {rid: j for j, rid in enumerate(rids.tolist())}
                out = [[], [], [], []]
                for rid, q in zip(asks.field("rid").to_pylist(), _matrix(asks.field("ints"))):
                    found, scores = lists.search(q, k, where.get(rid, -1))
                    for column, values in zip(out, (np.full(len(found), rid), ids[found], rids[found], scores.astype(np.int64))):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["ask", "vec_id", "rid", "score"])

    return run


def top_k(vectors: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product for every row of ``asks``: ``query_id``,
    ``rank``, ``vec_id``, ``score``; ties go to the smaller id.

    Both tables have ``vec_id``, ``rid`` (unique; a row is never its own answer) and ``ints`` (array of long, all of one
    length, products below 2**53). Rows that repeat an id are rows of their own; equal vectors are ties.
    """
    folder = run_folder(vectors.sparkSession, "topk")
    rows, asks = stage(vectors, folder, "rows"), stage(asks, folder, "asks")
    n_rows, n_asks = rows.count(), asks.count()
    held = in_blocks(rows, n_rows, ROWS_PER_BLOCK).groupBy("block").agg(F.collect_list(F.struct("vec_id", "rid", "ints")).alias("rows"))
    asked = in_blocks(asks, n_asks, QUERIES_PER_BLOCK, "ask_block").groupBy("ask_block").agg(F.collect_list(F.struct("rid", "ints")).alias("asks"))
    n_blocks = max(1, -(-n_rows // ROWS_PER_BLOCK))
    # Every block of queries goes to every block of rows by an equi-join on the block's number. A copy of the queries for each
    # block of rows is far larger than the file that Spark takes its size from, so the join is held to a shuffle: a broadcast would
    # bring all copies to the driver.
    spread = asked.select("asks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    pairs = held.join(spread.hint("merge"), "block").select("rows", "asks")
    best = pairs.mapInArrow(_search(k), "ask long, vec_id long, rid long, score long")
    order = W.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "rid")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asks.select(F.col("rid").alias("ask"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "ask").select("query_id", "rank", "vec_id", "score")


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``rid``, ``ints``: floor(scale * x) of every component. Rows whose vector is null, empty or holds
    null or non-finite components are left out."""
    rows = vectors.where(finite(F.col("embedding"))).select("vec_id", F.monotonically_increasing_id().alias("rid"), F.transform(
        "embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("ints"))
    return rows


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.ints::DOUBLE[], c.ints::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query(ORACLE_SQL)
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every fiftieth vector."""
    rows = stage(integers(table(spark, sf_dir, "embeddings")), run_folder(spark, "ints"), "rows")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)

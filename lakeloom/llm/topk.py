"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are held by the driver and sent to every executor at a time, in bytes of vectors.
BLOCK_BYTES = 16_000_000


def segment_bounds(dim: int, parts: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(parts, dim) + 1).astype(int))[:-1]


def segment_stats(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of every segment, both scaled by the root of its length."""
    size = np.diff(np.append(at, x.shape[1]))
    mean = np.add.reduceat(x, at, axis=1) / size
    square = np.add.reduceat(x * x, at, axis=1)
    return mean * np.sqrt(size), np.sqrt(np.maximum(0, square - size * mean * mean))


class QueryBlock:
    """Queries of one dimension with their statistics at every resolution."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: tuple[int, ...]):
        self.ids, self.vectors = ids, vectors
        self.at = [segment_bounds(vectors.shape[1], n) for n in levels] if vectors.shape[1] else []
        self.stats = [np.hstack(segment_stats(vectors, at)) for at in self.at]
        self.norm = (vectors * vectors).sum(axis=1)

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], chunk: int = 2048) -> None:
        """Fold candidates into ``best``: scores and ids of the k best so far for each query.

        With the segments' means m and deviations s, the squared distance of q and x is at least
        the sum of (m_q - m_x)^2 + (s_q - s_x)^2, each weighted by the segment's length. A
        candidate stays while that lower bound is within the distance of the query's k-th best;
        bounds go from coarse to fine segments, and only survivors get an exact product. As
        distance^2 = |q|^2 + |x|^2 - 2 q.x, the same test reads: an upper bound of q.x, the sum of
        m_q m_x + s_q s_x, is at least the k-th best product.
        """
        a, step = 0, 128
        while a < len(ids):
            x, x_ids = vectors[a : a + step], ids[a : a + step]
            theirs = [np.hstack(segment_stats(x, at)) for at in self.at]
            for b in range(0, len(self.ids), chunk):
                self._block(slice(b, b + chunk), x, x_ids, theirs, k, best)
            a, step = a + step, min(chunk, 2 * step)

    def _block(self, own: slice, x: np.ndarray, x_ids: np.ndarray, theirs: list[np.ndarray], k: int, best: tuple[np.ndarray, np.ndarray]) -> None:
        scores, found = best[0][own], best[1][own]
        floor = scores[:, -1]
        alive = self.ids[own][:, None] != x_ids
        for mine, stats in zip(self.stats, theirs, strict=True):
            bound = mine[own] @ stats.T
            alive &= bound + 1e-6 * (1 + np.abs(bound)) >= floor[:, None]
        left = np.count_nonzero(alive)
        if left * 16 > alive.size:  # one matrix product is cheaper than so many single ones
            exact = self.vectors[own] @ x.T
            rows, cols = np.nonzero(alive & (exact >= floor[:, None]))
            exact = exact[rows, cols]
        else:
            rows, cols = np.nonzero(alive)
            exact = np.einsum("ij,ij->i", self.vectors[own][rows], x[cols])
            keep = exact >= floor[rows]
            rows, cols, exact = rows[keep], cols[keep], exact[keep]
        if not len(rows):
            return
        touched = np.unique(rows)
        rows = np.concatenate((rows, np.repeat(touched, k)))
        exact = np.concatenate((exact, scores[touched].ravel()))
        their = np.concatenate((x_ids[cols], found[touched].ravel()))
        order = np.lexsort((their, -exact, rows))
        rows, exact, their = rows[order], exact[order], their[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        scores[rows[keep], rank[keep]], found[rows[keep], rank[keep]] = exact[keep], their[keep]


def int_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, x array<double>``: the floor of ``scale`` times each component.

    Rows without an id or a vector, and vectors with null or non-finite components, are left out.
    """
    v = F.col(vector_col)
    usable = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("x"))


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of the vectors of each length."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    size = np.diff(lists.offsets.to_numpy())
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield ids[rows], flat[(at[rows][:, None] + np.arange(d))].reshape(len(rows), d)


def top_k(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, levels: tuple[int, ...] = (8, 32), scope: str = "lakeloom") -> DataFrame:
    """The k highest integer inner products of every query with all other rows, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``. Returns ``query_id, rank, vec_id, score``. Components
    become ``floor(scale * x)``. Vectors that are null or hold null or non-finite components take
    no part, as query or as candidate; a query meets only vectors of its own length; rows with the
    query's id are its own; repeated query rows give one answer; fewer than k candidates give all of
    them; an empty table gives no rows. Scores are exact while components stay under 2^24 in size
    and are rounded as doubles beyond.

    Queries go out in blocks of a fixed number of bytes, each against one scan of all candidates; a block is
    answered, written and forgotten before the next one is collected, so neither driver nor executors hold
    more than one. A task returns k rows a query at most.
    """
    from .common import materialize

    spark = df.sparkSession
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    vectors = int_vectors(df, id_col, vector_col, scale)
    queries = vectors.where(is_query)
    rows, dims = queries.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = max(1, -(-rows * max(1, dims) * 8 // (BLOCK_BYTES // 2)))
    parts = []
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        held = {}
        for batch in mine.combine_chunks().to_batches():
            for ids, x in by_dim(batch):
                ids, first = np.unique(ids, return_index=True)
                held[x.shape[1]] = (ids, x[first])
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = {d: QueryBlock(ids, x, levels) for d, (ids, x) in sent.value.items()}
            best = {d: (np.full((len(q.ids), k), -np.inf), np.full((len(q.ids), k), np.iinfo(np.int64).max)) for d, q in own.items()}
            for batch in batches:
                for ids, x in by_dim(batch):
                    if x.shape[1] in own:
                        own[x.shape[1]].search(ids, x, k, best[x.shape[1]])
            for d, q in own.items():
                scores, found = best[d]
                row, col = np.nonzero(scores > -np.inf)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q.ids[row]), "vec_id": pa.array(found[row, col]), "score": pa.array(scores[row, col].astype(np.int64))})

        found = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return found
        # a query's candidates are all in its own block's run, so each block is answered and written by itself
        parts.append(materialize(found, scope))
        sent.destroy()
    return functools.reduce(DataFrame.unionAll, parts)


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    """The 20 best matches of every vector whose id is divisible by 20."""
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
